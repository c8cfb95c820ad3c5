"""Words, texts and null-safe joins shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from unitquarry.runtime import BROADCAST_BYTES, BROADCAST_ROWS, checkpoint_ready, measure

# Fixed pattern of a word: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# Fixed letters that lower-casing touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unit(*parts: Column) -> Column:
    """A repeatable number in [0, 1) drawn from the hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, *text: str) -> DataFrame:
    """Null-safe equi-join to a table with one row per key.

    The right side is broadcast only when it was measured to be below the
    bounds of ``runtime``; otherwise both sides are shuffled, and hot keys of
    the left side are split by adaptive execution.
    """
    rows, size = measure(right, *text)
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    joined = left.join(F.broadcast(renamed) if small else renamed, same, how)
    return joined.drop(*[f"_right_{c}" for c in on])


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    at = f"{folder}/llm-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows, so a task holds few texts and sends few back at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
