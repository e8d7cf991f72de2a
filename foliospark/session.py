"""Session settings and the two places where job sizing is decided."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "foliospark", cores: int | str = "*",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = shuffle_partitions or (cores if isinstance(cores, int) else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A new folder under ``base``, or else under ``spark.checkpoint.dir``, for one written
    table or checkpoint.

    A folder of its own is made up only for local masters (tests); on a cluster the setting
    has to name storage that every executor can reach.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _local_folders[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fits(df: DataFrame, max_rows: int) -> bool:
    """Size check that reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


#: Questions that are pinned in the plan rather than read again.
PINNED_ROWS = 4096


def pin_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> tuple[DataFrame, bool]:
    """(table, is_small). A question-sized table is read once and continues as a local
    relation, so the branches of a plan do not work it out again and again. A larger
    one is handed back untouched."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return df, False
    return df.sparkSession.createDataFrame(table, schema=df.schema), True


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out evenly. Text jobs are bound by CPU,
    and a small table in one row group would keep a single core busy; tables of many
    files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back: later branches start
    from the files, which also outlive lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int, small: bool | None = None) -> DataFrame:
    """Broadcast a narrow table when a count (or the caller, who has counted already)
    proves it small; otherwise leave the join to Spark: sort-merge, with AQE splitting
    skewed partitions."""
    known = fits(df, max_rows) if small is None else small
    return F.broadcast(df) if known else df
