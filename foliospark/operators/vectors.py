"""Exact and cell-pruned vector search for tables of questions.

No join ever produces question-chunk pairs, and chunks stay where they are stored: each
task multiplies its Arrow batches with a block of questions and keeps the best k of every
question, so a task emits at most questions x k rows whatever its input.

A block holds ``BLOCK_BYTES`` of question vectors, which are sent out; more questions are
more blocks, each a scan of its own that reads what its questions may see. Questions with
the same filters share a block, so filters and cells reach the scan for any number of
questions. Ranks are cut twice: within a question and salt, then within the question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.filings import citation_label
from foliospark.session import stored

FILTERS = ("symbol", "doc_type", "period")
BLOCK_BYTES = 32 << 20
SALTS = 32
#: Ranked rows (ids and scores) up to which they are sent to the chunks, not joined by a shuffle.
SENT_ROWS = 100_000
PRECISION = 9  # decimals that count for ranking; ties go to the smaller chunk id


class _Best:
    """The best k candidates of one question so far, ties by id."""

    __slots__ = ("k", "scores", "ids", "floor")

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.floor = k, [], [], -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(~(scores < self.floor))
        if keep.size > 4 * self.k:
            cut = np.partition(scores[keep], keep.size - self.k)[keep.size - self.k]
            keep = keep[scores[keep] >= cut]
        self.scores.extend(scores[keep].tolist())
        self.ids.extend(ids[keep].tolist())
        if len(self.ids) > self.k:
            order = sorted(range(len(self.ids)), key=lambda i: (-self.scores[i], self.ids[i]))
            self.scores = [self.scores[i] for i in order[:self.k]]
            self.ids = [self.ids[i] for i in order[:self.k]]
            self.floor = self.scores[-1]


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms


class _Questions:
    """Question vectors grouped by what they may see (cell and filters). With ``keep_cell``
    ids are pairs (chunk_id, cell) until the results are given out."""

    def __init__(self, rows: list, k: int, keep_cell: bool = False):
        self.keep_cell = keep_cell
        self.ids = [r["query_id"] for r in rows]
        self.unit = _unit_rows(np.array([r["embedding"] for r in rows], dtype="float64"))
        self.k = [int(r["k"]) if r["k"] is not None else k for r in rows]
        self.groups: dict[tuple, list[int]] = {}
        for at, r in enumerate(rows):
            wanted = tuple(r[f"filter_{f}"] for f in FILTERS)
            for cell in r["cells"] if r["cells"] is not None else [None]:
                self.groups.setdefault((cell, wanted), []).append(at)

    def score(self, chunks: dict[str, np.ndarray], best: dict[int, _Best]) -> None:
        unit = _unit_rows(chunks["embedding"])
        all_ids = chunks["chunk_id"]
        if self.keep_cell:
            all_ids = np.empty(len(unit), dtype=object)
            all_ids[:] = list(zip(chunks["chunk_id"].tolist(), chunks["cell"].tolist()))
        for (cell, wanted), members in self.groups.items():
            visible = np.ones(len(unit), dtype=bool)
            if cell is not None:
                visible &= chunks["cell"] == cell
            for name, value in zip(FILTERS, wanted):
                if value is not None:
                    visible &= chunks[name] == value
            rows = np.flatnonzero(visible)
            step = max(1, 4_000_000 // len(members))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                scores = np.round(self.unit[members] @ unit[part].T, PRECISION)
                # A zero vector has no direction: it ranks behind everything.
                scores = np.where(np.isnan(scores), -2.0, scores)
                ids = all_ids[part]
                for row, q in enumerate(members):
                    best.setdefault(q, _Best(self.k[q])).add(scores[row], ids)

    def results(self, best: dict[int, _Best]) -> dict[str, list]:
        out: dict[str, list] = {"query_id": [], "chunk_id": [], "score": [], "k": []}
        if self.keep_cell:
            out["cell"] = []
        for q, found in best.items():
            out["query_id"] += [self.ids[q]] * len(found.ids)
            if self.keep_cell:
                out["chunk_id"] += [i for i, _ in found.ids]
                out["cell"] += [c for _, c in found.ids]
            else:
                out["chunk_id"] += found.ids
            out["score"] += [None if s == -2.0 else s for s in found.scores]
            out["k"] += [self.k[q]] * len(found.ids)
        return out


def _from_arrow(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    columns = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if name == "embedding":
            values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
            columns[name] = values.reshape(len(column), -1)
        else:
            columns[name] = column.to_numpy(zero_copy_only=False)
    return columns


def _question_columns(questions: DataFrame) -> DataFrame:
    have = set(questions.columns)

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    return questions.filter("embedding IS NOT NULL").select(
        "query_id", "embedding", optional("k", "int"),
        *(optional(f"filter_{f}", "string") for f in FILTERS),
        optional("cells", "array<int>"),
    )


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    have = set(chunks.columns)
    extra = [c for c in (*FILTERS, "cell") if c in have]
    missing = [F.lit(None).cast("string").alias(f) for f in FILTERS if f not in have]
    return chunks.filter("embedding IS NOT NULL").select(
        "chunk_id", "embedding", *extra, *missing)


def _ranked(scored: DataFrame, max_k: int) -> DataFrame:
    """Final ranks, from at most k rows of a task and question: those of some tasks together
    first, so that a question's rows of all tasks never meet in one. The literal bound lets
    Spark cut groups before the shuffle; the exact per-question k is applied after it."""
    best = [F.desc_nulls_last("score"), F.col("chunk_id")]
    salted = Window.partitionBy("query_id", "_salt").orderBy(*best)
    some = (
        scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= max_k)
    )
    order = Window.partitionBy("query_id").orderBy(*best)
    return (
        some.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max_k)
        .filter(F.col("rank") <= F.col("k")).drop("k", "_salt")
    )


def _blocks(asked: DataFrame, block_bytes: int) -> Iterator[list]:
    """The questions in lists of bounded size, those with equal filters together; only one
    list is in the driver at a time."""
    n, dims = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return
    rows = max(1, block_bytes // (8 * dims + 200))
    if n <= rows:
        yield asked.collect()
        return
    by = [f"filter_{f}" for f in FILTERS]
    ranged = asked.repartitionByRange(math.ceil(n / rows), *by, "query_id").withColumn(
        "_block", F.spark_partition_id())
    ranged = stored(ranged, "questions")
    for block, size in sorted(tuple(r) for r in ranged.groupBy("_block").count().collect()):
        parts = math.ceil(size / rows)
        for part in range(parts):
            yield ranged.filter((F.col("_block") == block) & (
                F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).drop("_block").collect()


def rank_chunks(questions: DataFrame, chunks: DataFrame, k: int = 8,
                block_bytes: int = BLOCK_BYTES, keep_cell: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank), with ``keep_cell`` also the chunk's cell: the k chunks of highest cosine similarity.

    ``questions`` has query_id and embedding, and optionally k, filter_symbol,
    filter_doc_type, filter_period (null: no filter) and cells (the cells to look in).
    ``chunks`` has chunk_id, embedding and the filtered columns. Filters act before the
    top k. Chunks or questions without a vector do not take part. The result of each of
    several blocks is written before the next one is read.
    """
    spark = chunks.sparkSession
    asked = _question_columns(questions)
    pool = _chunk_columns(chunks)
    kinds = dict(asked.dtypes) | dict(pool.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, k int, _salt int"
    if keep_cell:
        schema += ", cell int"
    done: DataFrame | None = None
    held: DataFrame | None = None
    for rows in _blocks(asked, block_bytes):
        if not rows:
            continue
        if held is not None:
            kept = stored(held, "ranked")
            done = kept if done is None else done.unionByName(kept)
        held = _scan(spark, _Questions(rows, k, keep_cell), rows, pool, schema)
    if held is None:
        held = _ranked(spark.createDataFrame([], schema), k)
    return held if done is None else done.unionByName(stored(held, "ranked"))


def _scan(spark: SparkSession, plan: _Questions, rows: list, pool: DataFrame,
          schema: str) -> DataFrame:
    """Ranks of one block of questions."""
    for f in FILTERS:  # filters that all questions of the block have reach the scan
        wanted = {r[f"filter_{f}"] for r in rows}
        if None not in wanted:
            pool = pool.filter(F.col(f).isin(sorted(wanted)))
    if all(r["cells"] is not None for r in rows):
        pool = pool.filter(F.col("cell").isin(sorted({c for r in rows for c in r["cells"]})))
    max_k = max(plan.k)
    sent = spark.sparkContext.broadcast(plan)
    arrow_schema = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            if batch.num_rows:
                sent.value.score(_from_arrow(batch), best)
        if best:
            found = sent.value.results(best)
            # Told by the task, not by Spark's function for it, which would keep a plan with this
            # ranking from pruning partitions at run time.
            found["_salt"] = [TaskContext.get().partitionId() % SALTS] * len(found["k"])
            yield pa.RecordBatch.from_pydict({c: found[c] for c in arrow_schema.names}).cast(
                arrow_schema)

    return _ranked(pool.mapInArrow(scan, schema), max_k)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
             "double": pa.float64()}
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(", ")])


def with_details(ranked: DataFrame, chunks: DataFrame, *columns: str,
                 rows: int | None = None) -> DataFrame:
    """Adds chunk columns to ranked rows. Only ids and scores travel through the ranking;
    content is read for the winners. ``rows`` bounds the winners: up to ``SENT_ROWS`` they
    are sent to the chunk table, which then need not be shuffled, and of which only the
    winners' partitions are read when it is stored by ``store_chunks``."""
    side, keys = ranked, ["chunk_id"]
    if PREFIX in chunks.columns:
        side, keys = side.withColumn(PREFIX, prefix_of("chunk_id")), ["chunk_id", PREFIX]
    if rows is not None and rows <= SENT_ROWS:
        # The filter is always true; it tells Spark that this side selects.
        side = F.broadcast(side.filter("rank >= 1"))
    return chunks.select(*keys, *columns).join(side, keys).drop(PREFIX)


PREFIX, PREFIXES = "id_prefix", 256


def prefix_of(chunk_id: str, prefixes: int = PREFIXES) -> Column:
    """The part of a stored chunk table that a chunk is in."""
    return F.pmod(F.xxhash64(F.col(chunk_id).cast("string")), F.lit(prefixes)).cast("int")


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Writes chunks in partitions by a prefix of their hashed id; the winners of a search
    then prune partitions at run time."""
    chunks.withColumn(PREFIX, prefix_of("chunk_id")).repartition(PREFIX) \
        .write.partitionBy(PREFIX).parquet(path)


def _winners(questions: DataFrame, k: int) -> int:
    """How many rows a ranking of the questions has at most."""
    if "k" not in questions.columns:
        return k * questions.count()
    return questions.agg(F.sum(F.coalesce("k", F.lit(k)))).first()[0] or 0


def vector_search(questions: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """Ranked chunks with content and a ready citation label."""
    asked = stored(questions, "questions")
    label = citation_label(F.col("symbol"), F.col("doc_type"), F.col("period"),
                           F.col("source_url"))
    return with_details(
        rank_chunks(asked, chunks, k), chunks, "content", "page", "section", "symbol",
        "doc_type", "period", "source_url", rows=_winners(asked, k),
    ).select("query_id", "rank", "chunk_id", "content", "page", "section",
             label.alias("source"), "symbol", F.col("score").alias("similarity"))


def vector_search_filtered(questions: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Ranked chunks with raw fields; filters act before the top k."""
    asked = stored(questions, "questions")
    return with_details(
        rank_chunks(asked, chunks, k), chunks, "content", "symbol", "doc_type", "period", "page",
        "source_url", rows=_winners(asked, k),
    ).select("query_id", "rank", "chunk_id", "content", "symbol", "doc_type", "period", "page",
             "source_url", "score")


# --- approximate search ----------------------------------------------------------


#: Vectors for each cell that centres are fitted on, most vectors in all, and passes.
FIT_ROWS, MOST_FIT_ROWS, FIT_PASSES = 64, 200_000, 8


def fit_cells(chunks: DataFrame, cells: int | None = None) -> np.ndarray:
    """Unit cell centres by k-means of directions: by default as many as the square root of
    the number of vectors. They are fitted on a sample, the ``FIT_ROWS`` vectors for each cell
    (``MOST_FIT_ROWS`` in all) whose ids have the least hashes; fewer cells where that gives
    fewer vectors than cells. Every vector gets a cell."""
    with_vector = chunks.filter("embedding IS NOT NULL")
    if cells is None:
        cells = max(1, math.isqrt(with_vector.count()))
    sample = with_vector.select("embedding", F.xxhash64("chunk_id").alias("_h")).orderBy("_h") \
        .limit(min(FIT_ROWS * cells, MOST_FIT_ROWS)).select("embedding").toArrow()
    if not sample.num_rows:
        return np.zeros((1, 1))
    unit = np.nan_to_num(_unit_rows(_from_arrow(sample.combine_chunks().to_batches()[0])["embedding"]))
    centres = unit[:cells].copy()
    for _ in range(FIT_PASSES):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved = np.nan_to_num(_unit_rows(sums))
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def _with_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Rows with a vector, and ``cells``: the n cells nearest to it, best first."""
    columns = [f.name for f in df.schema.fields]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _from_arrow(batch.select(["embedding"]))["embedding"]
            if not batch.num_rows:
                continue
            unit = np.nan_to_num(_unit_rows(vectors))
            order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :n]
            cells = pa.array(order.astype("int32").tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*columns, "cells"])

    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return df.filter("embedding IS NOT NULL").mapInArrow(assign, schema)


def assign_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """A vector table (chunk_id, embedding, filter columns; no content) with ``cell``."""
    celled = _with_cells(vectors, centres, 1)
    return celled.withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def code_of(vector: Column) -> Column:
    """A vector in 8 bits a component: its direction, on a scale of its own."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.when(largest > 0, F.transform(vector, lambda x: F.round(
        x.cast("double") * 127 / largest).cast("tinyint"))).otherwise(
        F.transform(vector, lambda x: F.lit(0).cast("tinyint")))


def store_cells(celled: DataFrame, path: str, splits: int = 8) -> None:
    """Writes vectors and their codes partitioned by cell, so that a search reads only the
    cells it probes, codes first. A crowded cell is spread over several files and tasks."""
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(splits))
    (
        celled.withColumn("code", code_of(F.col("embedding"))).withColumn("_part", part)
        .repartition("cell", "_part").drop("_part").sortWithinPartitions("cell", "chunk_id")
        .write.partitionBy("cell").parquet(path)
    )


def cell_reach(celled: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """How far stored cells go: the least cosine between each centre and the vectors of its cell
    (2 for a cell without vectors), and the largest angle between a vector and its code (0
    without codes). Two numbers a cell come to the driver."""
    kept = [c for c in ("embedding", "code", "cell") if c in celled.columns]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest, coded = np.full(len(centres), 2.0), np.ones(len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _from_arrow(batch.drop_columns(["code"]) if "code" in kept else batch)
            unit = np.nan_to_num(_unit_rows(rows["embedding"]))
            np.minimum.at(lowest, rows["cell"], np.einsum("ij,ij->i", unit, centres[rows["cell"]]))
            if "code" in kept:
                code = _from_arrow(batch.select(["code"]).rename_columns(["embedding"]))["embedding"]
                same = np.einsum("ij,ij->i", unit, np.nan_to_num(_unit_rows(code)))
                np.minimum.at(coded, rows["cell"], np.where(unit.any(axis=1), same, 1.0))
        there = np.flatnonzero(lowest < 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype("int32")), pa.array(lowest[there]), pa.array(coded[there])],
            names=["cell", "least", "coded"])

    found = celled.select(*kept).mapInArrow(least, "cell int, least double, coded double") \
        .groupBy("cell").agg(F.min("least"), F.min("coded")).collect()
    reach, slack = np.full(len(centres), 2.0), 0.0
    for cell, least_cosine, least_coded in found:
        reach[cell] = least_cosine
        slack = max(slack, math.acos(max(-1.0, min(1.0, least_coded))))
    return reach, slack


def approx_rank_chunks(questions: DataFrame, celled: DataFrame, centres: np.ndarray,
                       k: int = 8, probes: int = 4, oversample: int = 4,
                       reach: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """Nearest neighbours among the chunks of each question's ``probes`` nearest cells.

    A cell is read once, by the questions that probe it. Where the table has codes, these are
    ranked first, and ``oversample`` times k survivors of each question are scored exactly
    from their vectors; without codes all of the probed cells are. Questions that bring a k
    of their own keep it. With ``reach`` (``cell_reach``) a question goes on to every cell
    that can still hold a better chunk than its k-th, so no cell is left out by chance.
    """
    asked = stored(_with_cells(questions, centres, probes), "questions")
    own = F.coalesce("k", F.lit(k)) if "k" in asked.columns else F.lit(k)
    asked = asked.withColumn("_k", own)
    coded = "code" in celled.columns
    times = oversample if coded else 1
    kept = (F.col("_k") * times).cast("int")
    pool = celled.drop("embedding").withColumnRenamed("code", "embedding") if coded else celled

    def ranked(some: DataFrame) -> DataFrame:
        return rank_chunks(some.withColumn("k", kept), pool, k * times, keep_cell=True)

    rough = stored(ranked(asked), "survivors")
    if reach is not None:
        limits = asked.select("query_id", "_k")
        reached = rough.join(limits, "query_id").filter(F.col("rank") == F.col("_k")).select(
            "query_id", F.col("score").alias("_reached"))
        rest = _with_open_cells(asked.join(reached, "query_id", "left"), centres, *reach)
        rest = stored(rest.drop("_reached").filter(F.size("cells") > 0), "questions")
        both = rough.drop("rank").unionByName(ranked(rest).drop("rank"))
        best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
        rough = stored(
            both.join(limits, "query_id").withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= kept).drop("_k"), "survivors")
    if not coded:
        return rough.select("query_id", "chunk_id", "score", "rank")
    # Survivors are few: sent to the vectors, of which only their cells are read.
    survivors = rough.filter("rank >= 1").select("query_id", "chunk_id", "cell")
    if rough.count() <= SENT_ROWS:
        survivors = F.broadcast(survivors)
    probed = asked.select("query_id", F.col("embedding").alias("_asked"), "_k")
    near = celled.select("chunk_id", "cell", "embedding").join(
        survivors, ["chunk_id", "cell"]).join(probed, "query_id")
    score = F.round(cosine(F.col("_asked"), F.col("embedding")), PRECISION)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    return (
        near.withColumn("score", score).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("_k")).select("query_id", "chunk_id", "score", "rank")
    )


def _with_open_cells(asked: DataFrame, centres: np.ndarray, reach: np.ndarray,
                     slack: float) -> DataFrame:
    """Questions with the cells, beside those they have probed, whose vectors can have a cosine
    of ``_reached``, known but for an angle of ``slack``; without that all the others."""
    names = [f.name for f in asked.schema.fields]
    radius = np.arccos(np.clip(reach, -1, 1))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.nan_to_num(_unit_rows(_from_arrow(batch.select(["embedding"]))["embedding"]))
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1)) - radius
            upper = np.cos(np.maximum(angle, 0))
            cells = []
            for row, probed, least in zip(upper, batch.column(names.index("cells")).to_pylist(),
                                          batch.column(names.index("_reached")).to_pylist()):
                open_ = reach < 2
                if least is not None:
                    sure = math.cos(min(math.pi, math.acos(max(-1, min(1, least))) + slack))
                    open_ = open_ & (row + 1e-7 >= sure)     # scores count to 9 decimals
                cells.append(np.setdiff1d(np.flatnonzero(open_), probed).tolist())
            columns = list(batch.columns)
            columns[names.index("cells")] = pa.array(cells, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return asked.mapInArrow(opened, asked.schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; null where one has no direction."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


#: Stored vectors that stand in as questions when the number of probes is measured.
TRIAL_ROWS = 64


def tune_probes(celled: DataFrame, centres: np.ndarray, k: int = 10, target: float = 0.95,
                trials: int = TRIAL_ROWS) -> int:
    """The least number of probes that finds ``target`` of the exact k nearest of ``trials``
    stored vectors, those whose ids have the least hashes. One exact search tells: a neighbour
    is found by as many probes as its cell's place among the question's nearest cells."""
    asked = celled.select(F.col("chunk_id").alias("query_id"), "embedding").orderBy(
        F.xxhash64("query_id")).limit(trials)
    asked = stored(_with_cells(asked, centres, len(centres)), "trials")
    exact = rank_chunks(asked, celled, k, keep_cell=True)
    needed = exact.join(asked.select("query_id", F.col("cells").alias("_cells")), "query_id") \
        .select(F.array_position("_cells", F.col("cell")).cast("double").alias("place"))
    place = needed.agg(F.percentile("place", F.lit(target))).first()[0]
    return min(len(centres), math.ceil(place)) if place else 1


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours that the approximate search found."""
    hits = exact.join(approx.select("query_id", "chunk_id", F.lit(1).alias("found")),
                      ["query_id", "chunk_id"], "left")
    return hits.agg(F.round(F.avg(F.coalesce("found", F.lit(0))), 4).alias("recall"),
                    F.count("*").alias("neighbours"))
