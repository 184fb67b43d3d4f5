"""Session helpers: shared storage, checkpoints and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one task takes where it makes many rows of them.
PART_BYTES = 4 << 20
_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir``; a local master may go without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="corpusloom-"))
    return _local_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder once and cut the lineage there.

    Used where two readers must see the very same rows even if executors are lost.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Size check before a broadcast: reads at most ``rows`` + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def is_light(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> bool:
    """Size check before a broadcast of rows that may be long: whether all of them together have at most so many bytes."""
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def parts_of(df: DataFrame, size: Column, most: int = PART_BYTES) -> int:
    """Number of partitions that hold about ``most`` bytes each; at least one a core if the rows are worth it.

    Given to ``repartition``, a number is kept, so that a task's rows don't grow with the input.
    """
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // most), min(cores, total >> 14))


def dealt_join(many: DataFrame, few: DataFrame, on: str, how: str = "inner", salts: int = 16,
               rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join where one key may hold a large part of ``many`` and ``few`` has few rows a key (inner and left joins).

    A ``few`` of at most ``rows`` rows is broadcast, so ``many`` stays where it is; else each of its rows goes to
    ``salts`` tasks and the rows of ``many`` are dealt to them in turn.
    """
    if is_small(few, rows):
        return many.join(F.broadcast(few), on, how)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", turn).join(copies, [on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give an input with fewer splits than cores one partition per core, by key.

    Row-local text work is heavy, and a small file is a single split. An input that
    already has enough splits is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def with_global_rank(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Number all rows 1..n in the given total order without a single-task window.

    Rows are range-partitioned and sorted; each partition's offset is the size of
    the partitions before it. Only one row per partition takes part in the offset
    window, and the sorted rows are settled first so that both readers agree.
    """
    marked = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = marked.groupBy(part).agg(F.count("*").alias("_n"))
    ends = sizes.select("_part", F.expr("sum(_n) over (order by _part) - _n").alias("_off"))
    row = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(ends), "_part")
        .withColumn(name, F.col("_off") + row + 1)
        .drop("_part", "_off", "_id")
    )


def local_session(cores: int = 8, app: str = "corpusloom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="corpusloom-wh-"))
        .getOrCreate()
    )
