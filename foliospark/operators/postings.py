"""Keyword search over a postings table.

Postings carry the filtered columns of their chunk, so a filter acts where a term is met, before
anything is grouped. A stored index (``store_index``) is partitioned by term and by chunk length;
for each term and block of lengths it knows the most that the term can add to a score. A search
reads the most promising block of each query first and then only blocks that can still reach the
k-th score found there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import STOP_WORDS, one_of, stem, terms, word_set
from foliospark.functions.filings import citation_label
from foliospark.operators.filings import matches_filters
from foliospark.operators.vectors import with_details
from foliospark.session import PINNED_ROWS, broadcast_if_small, pin_small, stored

MAX_QUERY_TERMS = 200_000
UNIT_PATTERN = r'-?"[^"]*"|\S+'
CARRIED = ("symbol", "doc_type", "period")


def token_rows(chunks: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, carried columns, pos, term): stemmed terms with their word position, stop
    words out."""
    # The outer form saves the size filter Spark would infer, a second tokenising.
    words = chunks.select("chunk_id", *carried, F.posexplode_outer(terms(F.col("content")))
                          .alias("_at", "_raw"))
    return words.filter(~one_of("_raw", STOP_WORDS)).select(
        "chunk_id", *carried, (F.col("_at") + 1).alias("pos"), stem(F.col("_raw")).alias("term"))


def _group(tokens: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    positions = F.sort_array(F.collect_list("pos"))
    return tokens.groupBy("chunk_id", "term").agg(
        positions.alias("positions"), *(F.first(c).alias(c) for c in carried)).select(
        "chunk_id", "term", F.size("positions").alias("tf"), "positions", *carried)


def _carried(table: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in CARRIED if c in table.columns)


#: Rows whose words are grouped at once.
WORD_ROWS = 500


def _grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (carried columns, words) as a row for each distinct word that is not null, with its
    places in the row from 1 on."""
    words = batch.column(batch.num_columns - 1)
    row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    first = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    place = np.arange(len(row)) - first[row] + 1
    codes = words.flatten().dictionary_encode()
    there = np.flatnonzero(~np.asarray(codes.is_null()))
    code = codes.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[there]
    key = row[there].astype(np.int64) * max(1, len(codes.dictionary)) + code
    order = np.argsort(key, kind="stable")
    there, key = there[order], key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    heads = there[starts]
    tf = np.diff(np.append(starts, len(key))).astype(np.int32)
    positions = pa.ListArray.from_arrays(
        pa.array(np.append(starts, len(key)).astype(np.int32)),
        pa.array(place[there].astype(np.int32)))
    of_row = pa.array(row[heads])
    kept = [batch.column(i).take(of_row) for i in range(batch.num_columns - 1)]
    term = codes.dictionary.take(codes.indices.take(pa.array(heads)))
    return pa.RecordBatch.from_arrays(
        [kept[0], term, pa.array(tf), positions, *kept[1:]],
        names=[batch.schema.names[0], "term", "tf", "positions", *batch.schema.names[1:-1]])


def _postings_of_rows(chunks: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """A row for each distinct term of each row of the table, grouped within the row: nothing
    is shuffled or sorted."""
    kept = chunks.select("chunk_id", *carried, F.transform(
        terms(F.col("content")), lambda w: F.when(~w.isin(STOP_WORDS), stem(w)))
        .alias("_words"))
    kinds = {f.name: f for f in kept.schema.fields}
    schema = T.StructType([
        kinds["chunk_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())), *(kinds[c] for c in carried)])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WORD_ROWS):
                yield _grouped(batch.slice(at, WORD_ROWS))

    return kept.mapInArrow(group, schema)


def build_postings(chunks: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, term, tf, positions, carried columns). A group is one term in one chunk, which
    a chunk's own row gives; only chunks whose id stands in several rows are put together by a
    shuffle. Store it clustered by term for repeated searches; with ``CARRIED`` columns,
    searches can be filtered by them."""
    ids = chunks.select("chunk_id")
    repeated = stored(ids.groupBy("chunk_id").count().filter("count > 1").select("chunk_id"), "repeated")
    if repeated.isEmpty():
        return _postings_of_rows(chunks, carried)
    once = _postings_of_rows(chunks.join(repeated, chunks["chunk_id"].eqNullSafe(
        repeated["chunk_id"]), "left_anti"), carried)
    again = chunks.join(repeated, chunks["chunk_id"].eqNullSafe(repeated["chunk_id"]), "left_semi")
    return once.unionByName(_group(token_rows(again, carried), carried))


def refresh_postings(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with the rows of changed chunks replaced; only those are tokenised."""
    kept = postings.join(changed.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(build_postings(changed, _carried(postings)))


def postings_for(queries: DataFrame, chunks: DataFrame, small: bool | None = None) -> DataFrame:
    """Postings of just the queried terms, straight from chunks, filtered against the query
    vocabulary where they are made. ``small`` tells that the queries are known to be few; None
    has them counted."""
    vocabulary = query_terms(queries).select("term").distinct()
    carried = _carried(chunks) if _filtered(queries) else ()
    return build_postings(chunks, carried).join(
        broadcast_if_small(vocabulary, MAX_QUERY_TERMS, small), "term", "left_semi")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


#: Characters of text whose postings one task sorts or matches.
PART_CHARS = 8 << 20
#: Postings that stand for as much text.
PART_POSTINGS = 1_000_000


def task_parts(chunks: DataFrame) -> int:
    """Into how many tasks postings of the chunks are dealt: the session's number, and more
    where a task would get those of more than ``PART_CHARS``."""
    return _parts(chunks.sparkSession, chunks.agg(F.sum(F.length("content"))).first()[0], PART_CHARS)


def _parts(spark: SparkSession, size: int | None, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / each))


def store_postings(postings: DataFrame, path: str, buckets: int = 256, splits: int = 8,
                   parts: int | None = None) -> None:
    """Writes postings in term buckets, sorted by term. A bucket is spread over several
    files by chunk, so that a term in every chunk does not end up in one task; ``parts``
    (``task_parts``) keeps what a task sorts the same for larger tables."""
    splits = max(splits, math.ceil(2 * (parts or 0) / buckets))
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(splits))
    dealt = (parts,) if parts else ()
    (
        postings.withColumn("bucket", _bucket(buckets)).withColumn("_part", part)
        .repartition(*dealt, "bucket", "_part").drop("_part").sortWithinPartitions("bucket", "term")
        .write.partitionBy("bucket").parquet(path)
    )


def stored_postings(spark: SparkSession, path: str, queries: DataFrame,
                    buckets: int = 256) -> DataFrame:
    """Stored postings with the scan pruned to the buckets the queries need. There are
    at most ``buckets`` of those to bring to the driver."""
    needed = query_terms(queries).select(_bucket(buckets).alias("bucket")).distinct().collect()
    return spark.read.parquet(path).filter(
        F.col("bucket").isin([r["bucket"] for r in needed])).drop("bucket")


def query_terms(queries: DataFrame) -> DataFrame:
    """Search text to (query_id, alt, unit, off, term, negated) and the counts to match.

    Plain words must all occur; OR separates alternatives; a quoted or hyphenated unit
    must occur as adjacent words (stop words keep their place as gaps); a leading minus
    excludes. A unit of stop words only says nothing and is dropped.
    """
    texts = F.regexp_extract_all("text", F.lit(UNIT_PATTERN), F.lit(0))

    def describe(text: Column, at: Column) -> Column:
        words = F.transform(terms(text), lambda w, off: F.struct(off.alias("off"), w.alias("raw")))
        kept = F.filter(words, lambda w: ~F.array_contains(word_set(STOP_WORDS), w["raw"]))
        return F.struct(
            F.size(F.filter(F.slice("_texts", F.lit(1), at), lambda u: F.lower(u) == "or"))
            .alias("alt"),
            at.alias("unit"),
            text.rlike(r'^-["\p{L}\p{N}]').alias("negated"),
            (F.lower(text) == "or").alias("is_or"),
            F.transform(kept, lambda w: F.struct(
                w["off"].alias("off"), stem(w["raw"]).alias("term"))).alias("words"),
        )

    def one_row(unit: Column) -> Column:
        return F.transform(unit["words"], lambda w: F.struct(
            unit["alt"].alias("alt"), unit["unit"].alias("unit"),
            unit["negated"].alias("negated"), F.size(unit["words"]).alias("unit_terms"),
            w["off"].alias("off"), w["term"].alias("term")))

    # Search texts are short, so all of this stays inside the query's row.
    units = (
        queries.select("query_id", texts.alias("_texts"))
        .select("query_id", F.transform("_texts", describe).alias("_units"))
        .select("query_id", F.filter(
            "_units", lambda u: ~u["is_or"] & (F.size(u["words"]) > 0)).alias("_units"))
    )
    flat = units.select(
        "query_id", "_units", F.flatten(F.transform("_units", one_row)).alias("_rows"))
    listed = flat.select(
        "query_id", "_units", F.inline_outer("_rows"),
        F.transform(F.filter("_rows", lambda r: ~r["negated"]), lambda r: r["term"])
        .alias("_terms"),
        F.transform(F.filter("_rows", lambda r: ~r["negated"]), lambda r: F.struct(
            r["unit"].alias("unit"), r["off"].alias("off"))).alias("_places"),
    )
    first_place = F.get("_places", F.array_position("_terms", F.col("term")).cast("int") - 1)
    in_alt = F.filter("_units", lambda u: (u["alt"] == F.col("alt")) & ~u["negated"])
    return listed.select(
        "query_id", "alt", "unit", "off", "negated", "unit_terms", "term",
        F.size(in_alt).alias("alt_units"),
        F.size(F.array_distinct("_terms")).alias("n_terms"),
        (~F.col("negated") & (first_place["unit"] == F.col("unit"))
         & (first_place["off"] == F.col("off"))).alias("scores"),
    ).filter("alt_units > 0")


def matching_chunks(queries: DataFrame, postings: DataFrame,
                    small: bool | None = None, parts: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that satisfies its query.

    score = sum of tf / (tf + 1) over the matched query terms, divided by the number of
    terms in the query. The query side is broadcast when a count proves it small;
    otherwise the join shuffles by term, where AQE splits the frequent terms. Filters of the
    queries act on the joined rows when the postings carry the columns. ``parts``
    (``task_parts``) is the number of tasks that matches are put together in.
    """
    wanted = _with_filters(query_terms(queries), queries, small)
    hits = postings.join(broadcast_if_small(wanted, MAX_QUERY_TERMS, small), "term")
    return _matches(_visible(hits, queries), _shape(wanted) if small else None, parts)


def _filtered(queries: DataFrame) -> bool:
    return any(f"filter_{c}" in queries.columns for c in CARRIED)


def _with_filters(wanted: DataFrame, queries: DataFrame, small: bool | None) -> DataFrame:
    """Query terms with the filters of their query, null for those it lacks."""
    if not _filtered(queries):
        return wanted
    filters = queries.select("query_id", *(
        F.col(f"filter_{c}") if f"filter_{c}" in queries.columns
        else F.lit(None).cast("string").alias(f"filter_{c}") for c in CARRIED))
    return wanted.join(broadcast_if_small(filters, MAX_QUERY_TERMS, small), "query_id")


def _visible(hits: DataFrame, queries: DataFrame) -> DataFrame:
    carries = len(_carried(hits)) == len(CARRIED)
    return hits.filter(matches_filters()) if carries and _filtered(queries) else hits


def _matches(hits: DataFrame, shape: str | None, parts: int | None = None) -> DataFrame:
    """Scores of the chunks whose hits satisfy their query."""
    hits = hits.withColumn("_gain", F.when(F.col("scores"), F.col("tf") / (F.col("tf") + 1)))
    score = (F.coalesce(F.sum("gain"), F.lit(0.0)) / F.first("n_terms")).alias("score")
    dealt = (*((parts,) if parts else ()), "query_id", "chunk_id")
    if shape == "any word":
        local = hits.select("query_id", "chunk_id", "n_terms", F.col("_gain").alias("gain"))
        return (local.repartition(*dealt) if parts else local).groupBy("query_id", "chunk_id").agg(score)

    keys = ["query_id", "chunk_id", "alt", "unit", "negated"]
    carried = ("alt_units", "n_terms")
    if shape == "words":
        per_unit = hits.select(*keys, *carried, F.col("_gain").alias("gain"),
                               F.lit(True).alias("met")).repartition(*dealt)
    else:
        # Where a unit's first word would stand; all words of a phrase have to agree on it.
        starts = F.when(F.col("unit_terms") == 1, F.array(F.lit(0))).otherwise(
            F.transform("positions", lambda p: p - F.col("off")))
        rows = hits.select(*keys, *carried, "unit_terms", "_gain",
                           F.posexplode(starts).alias("_nth", "_start"))
        # One shuffle; every grouping below is local to it.
        local = rows.withColumn("gain", F.when(F.col("_nth") == 0, F.col("_gain"))).repartition(
            *dealt)
        per_start = local.groupBy(*keys, "_start").agg(
            F.count("*").alias("_n"), F.sum("gain").alias("gain"),
            *(F.first(c).alias(c) for c in (*carried, "unit_terms")))
        per_unit = per_start.groupBy(*keys).agg(
            F.bool_or(F.col("_n") == F.col("unit_terms")).alias("met"),
            F.sum("gain").alias("gain"), *(F.first(c).alias(c) for c in carried))
    per_alt = per_unit.groupBy("query_id", "chunk_id", "alt").agg(
        F.sum("gain").alias("gain"),
        (F.count_if(F.col("met") & ~F.col("negated")) == F.first("alt_units")).alias("full"),
        F.bool_or(F.col("met") & F.col("negated")).alias("barred"),
        F.first("n_terms").alias("n_terms"))
    return (
        per_alt.groupBy("query_id", "chunk_id")
        .agg(score, F.bool_or(F.col("full") & ~F.col("barred")).alias("_matched"))
        .filter("_matched").drop("_matched")
    )


def _shape(wanted: DataFrame) -> str:
    """What a small set of queries asks for at most: 'any word' (single words joined by
    OR), 'words' (also all of several, or none of some), or 'phrases'. Simpler shapes
    need fewer groupings."""
    most = wanted.agg(F.max("unit_terms"), F.max("alt_units"), F.bool_or("negated")).first()
    if (most[0] or 1) > 1:
        return "phrases"
    return "words" if (most[1] or 1) > 1 or most[2] else "any word"


def rank_text(queries: DataFrame, postings: DataFrame, k: int = 8,
              documents: DataFrame | None = None, precision: int = 9,
              small: bool | None = None, parts: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): best keyword matches, ties by chunk id.

    Filters of the queries act before the top k: on the postings' own columns, or else on
    ``documents`` (chunk_id, symbol, doc_type, period), which then has to be met by all
    matches. An optional column k overrides ``k`` per query.
    """
    found = matching_chunks(queries, postings, small, parts)
    if documents is not None and _filtered(queries) and len(_carried(postings)) < len(CARRIED):
        asked = _with_filters(queries.select("query_id"), queries, small)
        found = (
            found.join(broadcast_if_small(asked, MAX_QUERY_TERMS, small), "query_id")
            .join(documents.select("chunk_id", *CARRIED), "chunk_id").filter(matches_filters())
            .select("query_id", "chunk_id", "score")
        )
    return _best(queries, found, k, precision, small)


def _best(queries: DataFrame, found: DataFrame, k: int, precision: int = 9,
          small: bool | None = None) -> DataFrame:
    max_k = k
    if "k" in queries.columns:
        max_k = max(k, queries.agg(F.max("k")).first()[0] or k)
        limits = queries.select("query_id", F.coalesce("k", F.lit(k)).alias("_k"))
        found = found.join(broadcast_if_small(limits, MAX_QUERY_TERMS, small), "query_id")
    else:
        found = found.withColumn("_k", F.lit(k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        found.withColumn("score", F.round("score", precision))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max_k).filter(F.col("rank") <= F.col("_k"))
        .select("query_id", "chunk_id", "score", "rank")
    )


# --- stored index -----------------------------------------------------------------


def store_index(chunks: DataFrame, path: str, buckets: int = 64, blocks: int = 16) -> None:
    """Writes postings with their chunk's symbol, doc_type and period below ``path``, in
    partitions by term bucket and by block of chunk lengths, and for each term and block the
    most that the term adds to a score. Long chunks hold the high counts, so blocks differ.
    """
    length = F.length("content")
    cuts = chunks.select(length.alias("n")).approxQuantile(
        "n", [i / blocks for i in range(1, blocks)], 0.01)
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= length)) if cuts \
        else F.lit(0)
    carried = (*CARRIED, "block")
    texts = chunks.select("chunk_id", "content", *CARRIED, F.coalesce(block, F.lit(0)).alias("block"))
    # Texts are dealt, which are far smaller than their postings: a task then writes the postings
    # of its own chunks, all of one or a few blocks.
    sizes = dict(texts.groupBy("block").agg(F.sum(length)).collect())
    slices = [max(1, math.ceil((sizes.get(b) or 0) / PART_CHARS)) for b in range(blocks)]
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(slices))
    slice_ = F.pmod(F.xxhash64("chunk_id"), F.get(F.array(*map(F.lit, slices)), F.col("block")))
    posts = build_postings(texts.repartition(parts, "block", slice_), carried)
    (
        posts.withColumn("bucket", _bucket(buckets))
        .sortWithinPartitions("bucket", "block", "term")
        .write.partitionBy("bucket", "block").parquet(f"{path}/postings")
    )
    written = chunks.sparkSession.read.schema(
        posts.withColumn("bucket", F.lit(0)).schema).parquet(f"{path}/postings")
    (
        written.groupBy("bucket", "block", "term").agg(F.max(F.col("tf") / (F.col("tf") + 1)).alias("most"))
        .repartition("bucket").sortWithinPartitions("bucket", "term")
        .write.partitionBy("bucket").parquet(f"{path}/bounds")
    )


class StoredIndex:
    """A stored index and how many term buckets it has."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.bounds = spark.read.parquet(f"{path}/bounds")
        self.buckets = buckets


def _buckets(wanted: DataFrame, index: StoredIndex) -> list[int]:
    """Term buckets that the queries need, of those that the index has."""
    return [r[0] for r in wanted.select(_bucket(index.buckets)).distinct().collect()]


def block_bounds(wanted: DataFrame, index: StoredIndex, buckets: list[int]) -> DataFrame:
    """(query_id, block, upper): the most a chunk of the block can score for the query."""
    terms_of = wanted.filter("scores").select("query_id", "term", "n_terms")
    return index.bounds.filter(F.col("bucket").isin(buckets)).join(terms_of, "term").groupBy(
        "query_id", "block").agg((F.sum("most") / F.first("n_terms")).alias("upper"))


def rank_stored(queries: DataFrame, index: StoredIndex, k: int = 8, precision: int = 9,
                small: bool | None = None) -> DataFrame:
    """``rank_text`` over a stored index; ``small`` as there. Only the partitions of the
    queries' terms are read, and of those the blocks that can still reach the top k: a query's
    most promising block sets its k-th score, and a block whose bound is under that is left
    out. Filters lower scores and no bounds, so the result is exact."""
    wanted = stored(_with_filters(query_terms(queries), queries, small), "terms")
    shape = _shape(wanted) if small else None
    buckets = _buckets(wanted, index)
    parts = _parts(index.postings.sparkSession, index.postings.count(), PART_POSTINGS)
    uppers = stored(block_bounds(wanted, index, buckets).withColumn("nth", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("upper"), "block"))), "bounds")

    def read(pairs: DataFrame) -> DataFrame:
        # At most as many numbers as the index has partitions.
        blocks = [r[0] for r in pairs.select("block").distinct().collect()]
        terms_there = wanted.join(pairs.select("query_id", "block"), "query_id")
        hits = index.postings.filter(F.col("bucket").isin(buckets) & F.col("block").isin(blocks)) \
            .join(broadcast_if_small(terms_there, MAX_QUERY_TERMS, small), ["term", "block"])
        return _matches(_visible(hits, queries), shape, parts)

    first = stored(_best(queries, read(uppers.filter("nth = 1")), k, precision, small), "ranked")
    limits = queries.select("query_id", (F.coalesce("k", F.lit(k)) if "k" in queries.columns
                                         else F.lit(k)).alias("_k"))
    reached = first.join(limits, "query_id").filter(F.col("rank") == F.col("_k")).select(
        "query_id", F.col("score").alias("reached"))
    # A bound is a sum in another order than a score, and scores count to ``precision`` places.
    left = uppers.filter("nth > 1").join(reached, "query_id", "left").filter(
        "reached IS NULL OR upper + 1e-8 >= reached")
    rest = read(stored(left.select("query_id", "block"), "blocks"))
    both = first.select("query_id", "chunk_id", "score").unionByName(
        _best(queries, rest, k, precision, small).select("query_id", "chunk_id", "score"))
    return _best(queries, both, k, precision, small)


def text_search(queries: DataFrame, chunks: DataFrame, postings: DataFrame | None = None,
                k: int = 8, index: StoredIndex | None = None) -> DataFrame:
    """Ranked keyword matches with content and citation label, from a stored index or postings;
    without either, postings are made for the queried terms."""
    asked, small = pin_small(queries, PINNED_ROWS)
    if index is not None:
        ranked = rank_stored(asked, index, k, small=small)
    else:
        made = postings if postings is not None else postings_for(asked, chunks, small)
        ranked = rank_text(asked, made, k, documents=chunks if _filtered(asked) else None, small=small,
                           parts=task_parts(chunks))
    label = citation_label(F.col("symbol"), F.col("doc_type"), F.col("period"),
                           F.col("source_url"))
    return with_details(
        ranked, chunks, "content", "page", "section", "symbol", "doc_type", "period", "source_url",
        rows=k * asked.count() if small and "k" not in asked.columns else None,
    ).select("query_id", "rank", "chunk_id", "content", "page", "section",
             label.alias("source"), "symbol", "score")
