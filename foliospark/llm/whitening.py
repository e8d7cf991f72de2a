"""Whitening components by shifted CholeskyQR.

The centred rows A of a table are never in one place. Each pass sends out one small triangular
matrix T and sums up the Gram matrix of the rows of A T over the partitions; the Cholesky factor R
of that sum orthogonalises the rows further (T becomes T R^-1, by triangular solves), and the
product of all factors is the R of A = Q R. The first factor is that of the Gram matrix plus a
shift, which exists however badly the columns are conditioned; two more passes then bring Q to
working precision, and more follow where that is not reached. Columns that depend on others show
by their pivots after the shifted pass and leave Q, but not R. Singular values and right vectors
of R are those of A, whose squares are never formed in the result: small components keep their
digits.

Entries are put on a grid, ``x = floor(scale * c) + offset`` as whole numbers, so that means and
distances from the mean are exact whatever the order in which partitions are summed.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import bounded_batches

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Whole numbers beyond this (entries beyond 10 ** 9 at the default scale) are taken as this.
FARTHEST = 1 << 40
#: Gram passes at most, the shifted one included, and how far from 1 and 0 a Gram matrix of
#: orthogonal columns may be.
PASSES, NEAR = 6, 1e-13

_LONG_MAX = (1 << 63) - 1


@dataclasses.dataclass
class Whitening:
    """What a fit knows: ``n`` rows, exact sums of the dimensions, unit vectors as columns in
    falling order of ``variances``, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = float("nan")

    @property
    def dims(self) -> int:
        return len(self.sums)


def grid_rows(column: pa.Array, scale: int, offset: int) -> tuple[np.ndarray, list]:
    """The rows of a list column that can take part, as (row numbers, [(dims, places, matrix)]):
    not null, not empty, every entry finite. Rows of one length share a matrix of whole numbers;
    ``places`` are places in the row numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64())      # null lists hold no entries here
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = sizes > 0
    good[owner[~np.isfinite(values)]] = False
    rows = np.flatnonzero(good)
    kept = values[good[owner]]
    lengths = sizes[rows]
    begin = np.cumsum(lengths) - lengths
    out = []
    for dims in np.unique(lengths):
        places = np.flatnonzero(lengths == dims)
        whole = kept.reshape(-1, dims) if len(places) == len(rows) else \
            kept[begin[places][:, None] + np.arange(dims)]
        whole = np.clip(np.floor(whole * scale), -FARTHEST, FARTHEST).astype(np.int64) + offset
        out.append((int(dims), places, whole))
    return rows, out


def _sum_up(parts: DataFrame, name: str, merge) -> list:
    """One merged value of all partitions' small binary rows: first within as many buckets as
    the square root of the partitions, then in the driver, which gets one row for each."""
    buckets = max(1, math.isqrt(parts.rdd.getNumPartitions()))

    def merged(table: pa.Table) -> pa.Table:
        values = [np.load(pa.BufferReader(v), allow_pickle=False)
                  for v in table.column(name).to_pylist()]
        return pa.table({name: pa.array([_packed(merge(values))], pa.binary())})

    rows = parts.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(buckets))) \
        .groupBy("_bucket").applyInArrow(merged, f"{name} binary").collect()
    return [np.load(pa.BufferReader(bytes(r[0])), allow_pickle=False) for r in rows]


def _packed(value: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    np.save(sink, value, allow_pickle=False)
    return sink.getvalue().to_pybytes()


def _partial(df: DataFrame, add, scale: int, offset: int, dims: int):
    """A binary row of each partition that has rows: ``add`` over its matrices."""
    def run(batches):
        state = None
        for batch in batches:
            for size, _, x in grid_rows(batch.column(0), scale, offset)[1]:
                if size == dims:
                    state = add(state, x)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([_packed(state)], pa.binary())})
    return df.mapInArrow(run, "part binary")


def _sums(df: DataFrame, scale: int, offset: int) -> tuple[int, np.ndarray] | None:
    """(rows, sums of the dimensions) of the length that most rows have, of equals the largest.
    Sums travel as columns of the aggregate, since lengths may differ between rows."""
    def run(batches):
        state: dict[int, list] = {}
        for batch in batches:
            for size, _, x in grid_rows(batch.column(0), scale, offset)[1]:
                known = state.setdefault(size, [0, np.zeros(size, np.int64)])
                known[0] += len(x)
                known[1] += x.sum(axis=0)
        if state:
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array(list(state), pa.int32()),
                "n": pa.array([n for n, _ in state.values()], pa.int64()),
                "sums": pa.array([s.tolist() for _, s in state.values()], pa.list_(pa.int64()))})

    parts = df.mapInArrow(run, "dims int, n bigint, sums array<bigint>")
    total = parts.select("dims", "n", F.posexplode("sums").alias("at", "s")) \
        .groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = total.groupBy("dims").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(
        F.struct("at", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("dims")).first()
    return best and (best.n, np.array([s for _, s in best.sums], np.int64))


def _factor(g: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(R, kept): the upper Cholesky factor of a Gram matrix, with zero rows for columns that
    depend on earlier ones, which are those whose pivot is under ``least``."""
    g, d = g.copy(), len(g)
    r, kept = np.zeros((d, d)), np.zeros(d, bool)
    for j in range(d):
        if g[j, j] > least:
            kept[j] = True
            r[j, j:] = g[j, j:] / math.sqrt(g[j, j])
            g[j:, j:] -= np.outer(r[j, j:], r[j, j:])
    return r, kept


def _inverse(r: np.ndarray) -> np.ndarray:
    """The inverse of an upper triangular matrix by back substitution."""
    d = len(r)
    out = np.zeros((d, d))
    for i in range(d - 1, -1, -1):
        out[i] = -(r[i, i + 1:] @ out[i + 1:])
        out[i, i] += 1.0
        out[i] /= r[i, i]
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding, from the exact n * x - sums where that fits."""
    if n * (np.abs(x).max(initial=0) + 1) < 1 << 62:
        return (n * x - sums) / n
    return (x - sums // n) - (sums % n) / n


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
        scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """Whitening components of the rows that can take part; None when there are none.

    Rows whose vector is null or empty, or has a null or non-finite entry, take no part, nor do
    rows of another length than most. Components without variance (to double precision) are
    left out, so there may be fewer than ``components``, and none when all rows are equal.
    """
    df = bounded_batches(vectors.select(vector))
    known = _sums(df, scale, offset)
    if known is None:
        return None
    n, sums = known
    dims = len(sums)

    def gram(t: np.ndarray) -> np.ndarray:
        def add(state, x):
            q = _centred(x, n, sums) @ t
            q = q.T @ q
            return q if state is None else state + q
        parts = _partial(df, add, scale, offset, dims)
        return sum(_sum_up(parts, "part", lambda found: sum(found)))

    t, r = np.eye(dims), np.eye(dims)
    g = gram(t)
    trace = float(np.trace(g)) / n
    eps = np.finfo(float).eps
    shift = 11 * (n * dims + dims * (dims + 1)) * eps * np.linalg.norm(g, 2)
    if trace == 0:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0)
    # After the shifted pass a direction keeps 1 / (11 n) of its length squared where its variance
    # is just above rounding; what dependent columns keep is rounding of that again.
    least = 1e-4 / (11 * (n + dims))
    for done in range(1, PASSES):
        step, kept = _factor(g + shift * np.eye(dims), 0.0) if done == 1 else _factor(g, least)
        solved = np.zeros((dims, dims))
        solved[np.ix_(kept, kept)] = _inverse(step[np.ix_(kept, kept)])
        r, t = step @ r, t @ solved
        g = gram(t)
        if np.abs(g - np.diag(kept.astype(float))).max() < NEAR:
            break
    _, sigma, wt = np.linalg.svd(r)
    variances = sigma ** 2 / n
    keep = min(components, int((variances > dims * eps * variances[0]).sum()))
    model = Whitening(n, sums, wt[:keep].T.copy(), variances[:keep], trace)
    return dataclasses.replace(model, identity_error=_identity_error(
        df, model, scale, offset))


def whitened_of(model: Whitening, x: np.ndarray) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.variances)


def _identity_error(df: DataFrame, model: Whitening, scale: int, offset: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity. A partition's rows
    are centred on their own mean, and partitions are merged by their means."""
    k = model.vectors.shape[1]
    if k == 0:
        return 0.0

    def both(a, b):
        if a is None:
            return b
        n, gap = a[0, 0] + b[0, 0], b[1] - a[1]
        out = np.empty_like(a)
        out[0] = n
        out[1] = a[1] + gap * (b[0, 0] / n)
        out[2:] = a[2:] + b[2:] + np.outer(gap, gap) * (a[0, 0] * b[0, 0] / n)
        return out

    def add(state, x):
        w = whitened_of(model, x)
        mean = w.mean(axis=0)
        w = w - mean
        return both(state, np.vstack([np.full(k, float(len(w))), mean, w.T @ w]))

    def merge(values):
        out = None
        for v in values:
            out = both(out, v)
        return out

    parts = _sum_up(_partial(df, add, scale, offset, model.dims), "part", merge)
    moments = merge(parts)
    return float(np.abs(moments[2:] / moments[0, 0] - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over the dimensions of (n * x - sums) ** 2 of each row, exactly; None where that
    is beyond a long."""
    rough = (np.square(x.astype(float) - sums / n)).sum(axis=1) * (1.0 + 1e-6) * float(n) * n
    if len(x) and rough.max() < 2.0 ** 62 and n * (np.abs(x).max() + 1) < 1 << 62:
        return np.square(n * x - sums).sum(axis=1).tolist()
    whole = [[int(v) for v in row] for row in x]
    s = [int(v) for v in sums]
    exact = (sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in whole)
    return [e if e <= _LONG_MAX else None for e in exact]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           model: Whitening | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    vector that takes part (see ``fit``) and each component, numbered from 1.

    ``model`` is a fit of other rows; by default the table is fitted to itself. A null vec_id is
    kept, rows that repeat one are rows of their own, and columns of other names do not matter.
    No rows that take part, or no component with variance, give no rows. ``deviation`` is null
    where the exact sum is beyond a long.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    model = model or fit(vectors, vector, components, scale, offset)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.variances)
    explained = model.variances / model.trace

    def run(batches):
        for batch in batches:
            rows, found = grid_rows(batch.column(1), scale, offset)
            for size, places, x in found:
                if size != model.dims:
                    continue
                m = len(x)
                far = deviations(x, model.n, model.sums)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows[places], k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(whitened_of(model, x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error))], names=[
                        "vec_id", "component", "n", "deviation", "whitened", "explained",
                        "identity_error"])

    return bounded_batches(vectors.select(vec_id, vector)).mapInArrow(run, schema)
