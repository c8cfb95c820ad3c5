"""Size checks, hot-key handling and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A side is broadcast only when it was measured to be below both bounds.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# A key is hot when it holds at least this share and this many of the rows.
HOT_SHARE = 0.002
HOT_ROWS = 100_000
HOT_KEYS = 200
SALTS = 64

# Rows of a large join or grouping that meet in one task.
TASK_ROWS = 1_000_000

# Up to this many rows in all, an ordered group is numbered by one window task.
WINDOW_ROWS = 1_000_000


def measure(df: DataFrame, *text: str) -> tuple[int, int]:
    """Rows and approximate bytes of ``df`` from one aggregate job.

    ``text`` names the columns whose width varies (strings or arrays).
    """
    types = dict(df.dtypes)
    widths = [
        F.coalesce(F.size(c) * 8 if types[c].startswith("array") else F.octet_length(c), F.lit(0))
        for c in text
    ]
    width = sum(widths, F.lit(48).cast("bigint"))
    row = df.agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return row["n"], row["b"] or 0


def is_small(df: DataFrame, *text: str) -> bool:
    rows, size = measure(df, *text)
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def parts_of(spark: SparkSession, size: int, most: int) -> int:
    """Partitions that hold at most about ``most`` of ``size`` each, and no fewer than the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash-partition a plain table scan that has fewer splits than the session has cores.

    Meant for wide text in front of expensive expressions.  A scan of a large
    table has splits enough and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores, key) if scan.rdd.getNumPartitions() < cores else scan


def key_profile(df: DataFrame, *keys: Sequence[str]) -> tuple[int, list[list[int]]]:
    """Rows of ``df``, and the hashes of the keys that hold a large share of them.

    One job for any number of key column lists.  The sketch returns at most
    ``HOT_KEYS`` hashes per list whatever the data size.  Only the speed of a
    later join depends on the answer, never its result.
    """
    sketches = [
        F.expr(f"approx_top_k(xxhash64({', '.join(cols)}), {HOT_KEYS}, {HOT_KEYS * 10})").alias(f"k{i}")
        for i, cols in enumerate(keys)
    ]
    row = df.agg(F.count("*").alias("n"), *sketches).first()
    bar = max(HOT_ROWS, HOT_SHARE * row["n"])
    return row["n"], [[e["item"] for e in row[f"k{i}"] if e["count"] >= bar] for i in range(len(keys))]


def hot_keys(df: DataFrame, *keys: Sequence[str]) -> list[list[int]]:
    return key_profile(df, *keys)[1]


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread: Column, hot: list[int], rows: int = 0
) -> DataFrame:
    """Equi-join whose left side may have hot keys and whose right side has few rows per key.

    Left rows of a hot key are spread over ``SALTS`` groups by ``spread`` (a
    deterministic column, so a retried task repeats it); the right rows of the
    same keys are repeated once per group.  Other keys are untouched.  Valid
    for inner, left, left_semi and left_anti joins.  ``rows`` is the measured
    size of the left side, if known: a large one is dealt to more tasks.
    """
    on = list(on)
    if not hot:
        return dealt(left, rows, *on).join(right, on, how)
    key = F.xxhash64(*on)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salted_left = left.withColumn("_salt", F.when(key.isin(*hot), salt).otherwise(0))
    copies = F.when(key.isin(*hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return dealt(salted_left, rows, *on, "_salt").join(salted_right, [*on, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """``df`` of so many rows by ``on``, if the session's number of partitions is too small for them."""
    parts = parts_of(df.sparkSession, rows, TASK_ROWS)
    return df.repartition(parts, *on) if rows > TASK_ROWS and parts > parts_of(df.sparkSession, 0, 1) else df


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread: Column, *text: str
) -> DataFrame:
    """Join to a side that is broadcast if it was measured small, else shuffled with hot keys spread."""
    if is_small(right, *text):
        return left.join(F.broadcast(right), list(on), how)
    [hot] = hot_keys(left, on)
    return skew_join(left, right, on, how, spread, hot)


def fetch(results: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows of ``results`` with the columns of ``wide``, which has one row per ``id``.

    The results are settled first.  If they were measured small they go to the
    wide rows, so text and vectors stay where they are.
    """
    settled = cut(results)
    return wide.join(F.broadcast(settled), "id") if is_small(settled) else settled.join(wide, "id")


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``.  Only a
    local session, whose one machine is the whole cluster, gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="unitquarry-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint_folder(spark: SparkSession) -> str:
    """Where checkpoints of this session lie."""
    checkpoint_ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write many rows as Parquet to the checkpoint folder and continue from the files; they are smaller than a checkpoint."""
    at = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group with their position; each task first keeps its own ``k``."""
    ranked = df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("pos") <= k)


def number_rows(df: DataFrame, group: str, order: Sequence[str], rows: int, into: str = "pos") -> DataFrame:
    """Dense 1-based positions per group in the order of unique ascending columns.

    ``rows`` is the measured size of ``df``.  A small frame takes a plain
    window.  A large one is range-partitioned by group and order, written to
    the checkpoint folder with its partition number, and numbered from the row
    counts of the partitions before it, so no task ever holds a whole group.
    """
    if rows <= WINDOW_ROWS:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // WINDOW_ROWS))
    placed = cut(df.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()))
    before = (
        placed.groupBy(group, "_part").count()
        .withColumn("_before", F.sum("count").over(
            Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select(group, "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(before, [group, "_part"])
        .withColumn(into, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before")
    )
