"""Keyed tables on plain Parquet: upserts and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, combined map-side."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(key).agg(row).select(key, "_row.*").select(*df.columns)


def upsert(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Target rows whose key is not in the source, and the source rows. ``order`` says
    which of several source rows of one key wins."""
    fresh = latest_per_key(source, key, order) if order else source.dropDuplicates([key])
    kept = target.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


# --- versions ---------------------------------------------------------------------
#
# A versioned table is Parquet in partitions (run, version) and a log of commits beside it. A
# commit gives its version the next number over all runs; readers take committed versions only,
# and where rows compete, the newest commit wins. A compaction is a commit that stands for all
# before it. One writer at a time: numbers are read before they are given.

COMMIT = "seq bigint, replaces bigint"
ORIGIN = "of_run string, of_version bigint, of_seq bigint"
_COMPACTED = "compacted"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or none of its rows before the first write."""
    folder, files = _folder(spark, path)
    if files.exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str):
    """A path and the file system that it is in, as Hadoop sees them."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(seq, replaces, run, version) of every commit."""
    return _read(spark, f"{path}/_commits", f"{COMMIT}, run string, version bigint")


def append_version(df: DataFrame, path: str, version: int, run: str = "0",
                   by: tuple[str, ...] = ()) -> int:
    """Adds rows as one version of a run, partitioned further by the columns ``by``, and
    commits them; the commit's number. Writing a version again replaces its rows and keeps its
    number, so a retried batch leaves the same table; readers see a version once it is committed.
    """
    spark = df.sparkSession
    known, last = commits(spark, path).agg(
        F.max(F.when((F.col("run") == run) & (F.col("version") == version), F.col("seq"))),
        F.max("seq")).first()
    if known is not None and known <= _replaced(spark, path):
        return known                      # folded by a compaction since
    seq = known if known is not None else (0 if last is None else last + 1)
    _write(df, path, run, version, by)
    if known is None:
        _commit(spark, path, run, version, seq, None)
    return seq


def _write(df: DataFrame, path: str, run: str, version: int, by: tuple[str, ...]) -> None:
    (
        df.withColumns({"run": F.lit(run), "version": F.lit(version).cast("bigint")})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "version", *by).parquet(path)
    )


def _commit(spark: SparkSession, path: str, run: str, version: int, seq: int,
            replaces: int | None) -> None:
    entry = spark.createDataFrame([(seq, replaces)], COMMIT)
    _write(entry.coalesce(1), f"{path}/_commits", run, version, ())


def _replaced(spark: SparkSession, path: str) -> int:
    """The last commit that a compaction stands for; -1 without one."""
    last = commits(spark, path).agg(F.max("replaces")).first()[0]
    return -1 if last is None else last


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint: the same after a restart, another
    one with a new checkpoint, whose batches are counted from 0 again."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed versions with the run, version and commit that brought them;
    none before the first write."""
    rows = _read(spark, path, f"{schema}, {ORIGIN}, run string, version bigint")
    live = commits(spark, path).filter(F.col("seq") > _replaced(spark, path)).select(
        "run", "version", "seq")
    joined = rows.join(live, ["run", "version"])
    return joined.withColumns({
        "run": F.coalesce("of_run", "run"), "version": F.coalesce("of_version", "version"),
        "seq": F.coalesce("of_seq", "seq")}).drop("of_run", "of_version", "of_seq")


def earlier_versions(spark: SparkSession, path: str, schema: str, run: str,
                     version: int) -> DataFrame:
    """All that other runs have written, and this one before the given version."""
    return read_versions(spark, path, schema).filter(
        (F.col("run") != run) | (F.col("version") < version))


def read_current(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The row of each key that the newest commit brought, whichever run made it."""
    return latest_per_key(read_versions(spark, path, schema), key, "seq") \
        .drop("run", "version", "seq")


def compact(spark: SparkSession, path: str, schema: str, key: str | None = None,
            by: tuple[str, ...] = ()) -> int | None:
    """Folds all committed versions into one: the current row of each key, or without a key
    every row. Rows keep run, version and commit they came from, so retries and later commits
    are judged as before. The commit's number; None when there is nothing to fold."""
    last = commits(spark, path).agg(F.max("seq")).first()[0]
    if last is None:
        return None
    rows = read_versions(spark, path, schema)
    rows = latest_per_key(rows, key, "seq") if key else rows
    rows = rows.withColumnsRenamed({"run": "of_run", "version": "of_version", "seq": "of_seq"})
    _write(rows, path, _COMPACTED, last + 1, by)
    _commit(spark, path, _COMPACTED, last + 1, last + 1, last)
    return last + 1


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the files of versions that a compaction stands for; how many versions those
    were. Their commits stay, so that a late retry is known. No reader may be at work on them."""
    old = commits(spark, path).filter(F.col("seq") <= _replaced(spark, path)).select(
        "run", "version").collect()
    gone = 0
    for run, version in old:
        folder, files = _folder(spark, f"{path}/run={run}/version={version}")
        gone += bool(files.delete(folder, True))
    return gone
