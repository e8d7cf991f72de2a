"""Hard negatives by walking shared candidate lists with certified ends.

Anchors are clustered by direction. No vector of a cluster is further than the radius from the
cluster's centroid, so the inner product of a candidate and any member is at most

    |member| * |candidate| * cos(max(0, angle(candidate, centroid) - radius)).

Without the member's length that is one number for the whole cluster: each block of candidates is
sorted by it once for a cluster, and every member walks that list, in slabs that are one matrix
product for all who still walk, until the bound of what is left is under what it still needs. What
a member needs starts from its own cluster: the k-th best among its cluster mates is a floor.

The work goes two times over all vectors, for the positives and then for the negatives in the
score bands that the positives fix. Anchors go out in rounds of bounded size, whole groups of
cluster mates together; candidates stay where they are stored. A task gives the best k of each
need, and these are merged by need. Scores are inner products of whole numbers and exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.texts import bounded_batches
from foliospark.session import stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in per cent of the positive's.
LEAST, MOST = 50, 95
EVERY = 50

#: Anchors of a cluster, of a group that walks together, and clusters at most. More anchors make
#: larger clusters, which are dealt into groups; results do not depend on any of this.
CLUSTER, GROUP, CLUSTERS = 512, 1024, 4096
#: Rows for each cluster that the centroids are fitted on, and passes over them.
FIT_ROWS, FIT_PASSES = 16, 4
#: Bytes of anchor vectors sent out at a time.
ROUND_BYTES = 32 << 20
#: Candidates sorted together, and candidates of the first slab; slabs double up to SLAB_MOST.
BLOCK, SLAB, SLAB_MOST = 32768, 512, 4096
#: Components beyond this are taken as this; products of such vectors still fit a long.
FARTHEST = 1 << 27

_LAST = np.iinfo(np.int64).max       # stands for a null id
_NONE = np.iinfo(np.int64).min // 2


def whole_vector(vector: str, scale: int) -> Column:
    """floor(scale * component) of a vector without null, NaN or infinite components, else null."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c)
                     & (F.abs(c) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double"))))


def _hundredths(value: Column, per_cent: int, add: int) -> Column:
    """(per_cent * value + add) / 100 rounded down, in whole numbers without overflow."""
    left = F.pmod(value, F.lit(100))
    whole = F.call_function("div", value - left, F.lit(100))
    return whole * per_cent + F.call_function("div", left * per_cent + add, F.lit(100))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column without nulls, cut or filled with zeros to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[at < dims], at[at < dims]] = flat[at < dims]
    return out


def _ids(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt(np.square(x.astype(float)).sum(axis=1))
    return x / np.where(lengths > 0, lengths, 1.0)[:, None], lengths


def _exact(x: np.ndarray, longest: float) -> np.ndarray:
    """The matrix in the narrowest type in which all products with vectors of at most ``longest``
    are exact: every partial sum is a whole number of at most the product of the lengths."""
    return x.astype(np.float32 if longest < 2 ** 24 else
                    np.float64 if longest < 2 ** 53 else np.int64)


def fit_centroids(anchors: DataFrame, n: int, dims: int) -> np.ndarray:
    """Unit centroids by k-means of directions, fitted on the ``FIT_ROWS`` rows for each cluster
    of least hash: one cluster for ``CLUSTER`` anchors, ``CLUSTERS`` at most."""
    k = max(1, min(CLUSTERS, n // CLUSTER))
    sample = anchors.select("x", F.xxhash64("vec_id", "x").alias("h")).orderBy("h") \
        .limit(FIT_ROWS * k).select("x").toArrow()
    units, _ = _units(_matrix(sample.column("x"), dims))
    centroids = units[:k].copy()
    for _ in range(FIT_PASSES):
        nearest = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        moved, lengths = _units(sums)
        centroids = np.where(lengths[:, None] > 0, moved, centroids)
    return centroids


def _with_clusters(anchors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The anchors with the cluster of the nearest centroid."""
    dims = centroids.shape[1]
    sent = anchors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            units, _ = _units(_matrix(batch.column(2), dims))
            near = (units @ sent.value.T).argmax(axis=1).astype(np.int32) if len(units) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32())],
                names=["vec_id", "label", "x", "mark", "cluster"])

    return bounded_batches(anchors).mapInArrow(
        run, "vec_id bigint, label bigint, x array<int>, mark bigint, cluster int")


class Needs:
    """The best ``k`` (score, id) found for each need of a group's anchors. A need has a band of
    scores and a floor, the worst (score, id) that can still be among its k; the arrays have a
    row for each anchor and a column for each of its needs."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray, floor: np.ndarray,
                 floor_id: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.floor, self.floor_id = floor.copy(), floor_id.copy()
        self.key = np.zeros(0, np.int64)
        self.score, self.id = self.key, self.key

    def least(self) -> np.ndarray:
        """For each anchor the least score that any of its needs has use for."""
        return np.where(self.low <= self.high, self.floor, -_NONE).min(axis=1)

    def most(self) -> np.ndarray:
        return self.high.max(axis=1)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes candidates of anchors; what a need has no use for is left out."""
        key = (anchor[:, None] * self.low.shape[1] + np.arange(self.low.shape[1])).ravel()
        score, ids = (np.repeat(v, self.low.shape[1]) for v in (score, ids))
        floor = self.floor.ravel()[key]
        fits = (score <= self.high.ravel()[key]) & (
            (score > floor) | ((score == floor) & (ids <= self.floor_id.ravel()[key])))
        if not fits.any():
            return
        touched = np.unique(key[fits])
        old = np.isin(self.key, touched)
        new = [np.concatenate(p) for p in ((self.key[old], key[fits]),
                                           (self.score[old], score[fits]),
                                           (self.id[old], ids[fits]))]
        order = np.lexsort((new[2], -new[1], new[0]))
        new = [v[order] for v in new]
        begin = np.searchsorted(new[0], new[0], "left")
        place = np.arange(len(order)) - begin
        last = place == self.k - 1
        self.floor.ravel()[new[0][last]] = new[1][last]
        self.floor_id.ravel()[new[0][last]] = new[2][last]
        keep = place < self.k
        self.key, self.score, self.id = (np.concatenate([v[~old], w[keep]]) for v, w in zip(
            (self.key, self.score, self.id), new))


class Walkers:
    """A round's anchors in groups of cluster mates, as arrays."""

    def __init__(self, table: pa.Table, dims: int, same: bool, k: int):
        order = np.lexsort([table.column(c).to_numpy() for c in ("part", "cluster")])
        table = table.take(pa.array(order))
        self.ids, self.labels = _ids(table.column("vec_id")), _ids(table.column("label"))
        self.marks = _ids(table.column("mark"))
        self.x = _matrix(table.column("x"), dims)
        self.same = same
        units, self.lengths = _units(self.x)
        group = np.stack([table.column(c).to_numpy() for c in ("cluster", "part")])
        edge = np.flatnonzero((np.diff(group, axis=1) != 0).any(axis=0)) + 1
        bounds = [0, *edge.tolist(), len(self.x)] if len(self.x) else [0]
        self.groups = list(zip(bounds, bounds[1:]))
        count = table.column("low").combine_chunks().value_lengths()[0].as_py() if len(table) else 1
        bands = [_matrix(table.column(c), count) for c in ("low", "high", "floor", "floor_id")]
        self.needs = [Needs(k, *(b[lo:hi] for b in bands)) for lo, hi in self.groups]
        self.centres = np.zeros((len(self.groups), dims))
        self.radii = np.zeros(len(self.groups))
        for g, (lo, hi) in enumerate(self.groups):
            self.centres[g] = _units(units[lo:hi].sum(axis=0)[None, :])[0][0]
            self.radii[g] = np.arccos(np.clip(units[lo:hi] @ self.centres[g], -1, 1)).max()


def walk(walkers: Walkers, x: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> int:
    """Every anchor's walk over one block of candidates; the number of products worked out."""
    units, lengths = _units(x)
    angles = np.arccos(np.clip(units @ walkers.centres.T, -1.0, 1.0))
    longest = lengths.max(initial=0.0) * walkers.lengths.max(initial=0.0) * (1 + 1e-9)
    candidates, members = _exact(x, longest), _exact(walkers.x, longest)
    done = 0
    for g, (lo, hi) in enumerate(walkers.groups):
        needs = walkers.needs[g]
        # The slack covers the rounding of angles and lengths.
        gap = np.maximum(0.0, angles[:, g] - walkers.radii[g] - 1e-6)
        bound = lengths * np.minimum(1.0, np.cos(np.minimum(gap, math.pi)) + 1e-9)
        order = np.lexsort((ids, -bound))
        at, size = 0, SLAB
        while at < len(order):
            least, most = needs.least(), needs.most()
            left = walkers.lengths[lo:hi] * bound[order[at]] * (1 + 1e-9) + 1e-6
            active = np.flatnonzero((left >= least) & (least <= most)) + lo
            if not len(active):
                break
            slab = order[at:at + size]
            score = members[active] @ candidates[slab].T
            equal = labels[slab][None, :] == walkers.labels[active][:, None]
            if walkers.same:
                fits = equal & (ids[slab][None, :] != walkers.ids[active][:, None])
            else:
                fits = ~equal
            fits &= (score >= least[active - lo][:, None]) & (score <= most[active - lo][:, None])
            who, what = np.nonzero(fits)
            if len(who):
                needs.add(active[who] - lo, score[who, what].astype(np.int64), ids[slab[what]])
            done += score.size
            at, size = at + len(slab), min(2 * size, SLAB_MOST)
    return done


def _floors(anchors: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """The anchors with floors from the walk over their own group."""
    def run(table: pa.Table) -> pa.Table:
        walkers = Walkers(table, dims, same, k)       # one group, so the rows keep their order
        walk(walkers, walkers.x, walkers.labels, walkers.ids)
        needs = walkers.needs[0]
        found = {"floor": needs.floor, "floor_id": needs.floor_id}
        columns = {c: pa.array(found[c].tolist(), pa.list_(pa.int64())) if c in found
                   else table.column(c) for c in table.column_names}
        return pa.table({c: v.cast(pa.list_(v.type.value_type)) if pa.types.is_list(v.type) else v
                         for c, v in columns.items()})

    schema = ", ".join(f"{c} {kind}" for c, kind in anchors.dtypes)
    return bounded_batches(anchors).groupBy("cluster", "part").applyInArrow(run, schema)


FOUND = "anchor_id bigint, mark bigint, need int, score bigint, vec_id bigint"


def _search(vectors: DataFrame, anchors: DataFrame, rounds: int, dims: int, same: bool,
            k: int, name: str) -> DataFrame:
    """FOUND: the k best of each need over all vectors. Only one round's anchors, which is
    ``ROUND_BYTES`` of vectors by the number of rounds, are in the driver at a time."""
    spark = vectors.sparkSession
    seeded = stored(_floors(anchors, dims, same, k), "floors")
    results = []
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(seeded.filter(
            F.pmod(F.xxhash64("cluster", "part"), F.lit(rounds)) == r).toArrow())

        def run(batches, sent=sent):
            walkers = Walkers(sent.value, dims, same, k)
            held, rows = [], 0

            def go():
                walk(walkers, *(np.concatenate(c) for c in zip(*held)))

            for batch in batches:
                held.append((_matrix(batch.column(2), dims), _ids(batch.column(1)),
                             _ids(batch.column(0))))
                rows += batch.num_rows
                if rows >= BLOCK:
                    go()
                    held, rows = [], 0
            if rows:
                go()
            for (lo, _), needs in zip(walkers.groups, walkers.needs):
                anchor, need = np.divmod(needs.key, needs.low.shape[1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(walkers.ids[anchor + lo]), pa.array(walkers.marks[anchor + lo]),
                    pa.array(need.astype(np.int32)), pa.array(needs.score),
                    pa.array(needs.id, mask=needs.id == _LAST)],
                    names=["anchor_id", "mark", "need", "score", "vec_id"])

        found = bounded_batches(vectors).select("vec_id", "label", "x").mapInArrow(run, FOUND)
        order = Window.partitionBy("anchor_id", "mark", "need").orderBy(
            F.desc("score"), F.asc_nulls_last("vec_id"))
        results.append(stored(found.withColumn("rank", F.row_number().over(order))
                              .filter(F.col("rank") <= k), name))
        sent.unpersist()
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES,
         negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is (vec_id, label, x) with x an array of whole numbers; rows with a null label,
    vector or component take no part. Anchors are the rows whose vec_id is divisible by
    ``every``; a row of the anchor's vec_id is no positive of it. Rows that repeat an anchor
    in all three columns are one anchor; repeated candidates count as often as they stand there,
    and a candidate without vec_id comes last among equal scores. A shorter vector counts as
    followed by zeros. Anchors without positives, and positives without negatives in their band
    of ``least`` to ``most`` per cent of the score, give no rows; no anchors, no rows.
    """
    spark = vectors.sparkSession
    none = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
            "positive_score bigint, negative_score bigint")
    sound = F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", F.isnull)
    vectors = stored(vectors.filter(sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform("x", lambda c: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), c))
                    .cast("int")).alias("x")), "vectors")
    anchors = stored(vectors.filter(F.col("vec_id") % every == 0).distinct()
                     .withColumn("mark", F.xxhash64("label", "x")), "anchors")
    n, dims = anchors.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], none)
    dims = max(1, dims)
    clustered = stored(_with_clusters(anchors, fit_centroids(anchors, n, dims)), "clustered")
    # A cluster of many anchors, such as copies, is dealt into groups of about GROUP.
    sizes = clustered.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = clustered.join(F.broadcast(sizes), "cluster").select(
        "vec_id", "label", "x", "mark", "cluster",
        F.pmod(F.xxhash64("vec_id", "mark"), "parts").cast("int").alias("part"))
    rounds = max(1, math.ceil(n * dims * 4 / ROUND_BYTES))

    def needs(low, high, floor):
        return {"low": low, "high": high, "floor": floor,
                "floor_id": F.transform(floor, lambda _: F.lit(int(_LAST)))}

    def longs(value):
        return F.array(F.lit(int(value)).cast("bigint"))

    ready = dealt.withColumns(needs(longs(_NONE), longs(-_NONE), longs(_NONE)))
    found = _search(vectors, ready, rounds, dims, True, positives, "positives") \
        .select(F.col("anchor_id"), "mark", F.col("rank").alias("nth"),
                F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # One band for each positive; a missing one has an empty band.
    bands = found.groupBy("anchor_id", "mark").agg(F.map_from_entries(F.collect_list(
        F.struct("nth", "positive_score"))).alias("p"))
    nth = F.sequence(F.lit(1), F.lit(positives))
    ready = dealt.join(bands, (dealt.vec_id == bands.anchor_id) & (dealt.mark == bands.mark)) \
        .select(dealt["*"], F.transform(nth, lambda i: F.try_element_at("p", i)).alias("ps"))
    # A missing positive's band is 1 to 0.
    low = F.transform("ps", lambda p: F.coalesce(_hundredths(p, least, 99), F.lit(1)))
    high = F.transform("ps", lambda p: F.coalesce(_hundredths(p, most, 0), F.lit(0)))
    ready = ready.withColumns({"low": low, "high": high}).drop("ps")
    ready = ready.withColumns(needs(F.col("low"), F.col("high"), F.col("low")))
    worst = _search(vectors, ready, rounds, dims, False, negatives, "negatives")
    out = worst.withColumn("nth", F.col("need") + 1).join(found, ["anchor_id", "mark", "nth"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                      F.col("vec_id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))


def labelled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, x) of a table of vec_id, label and embedding: components on a grid of
    1 / ``scale``, and every seventh vec_id's label moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", moved.alias("label"),
                             whole_vector("embedding", scale).alias("x"))


#: The same over all pairs, for tables of one machine.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (
  SELECT p.anchor_id, positive_id,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
                                 ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
         n.vec_id AS negative_id, positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
WHERE rank <= 3
"""
