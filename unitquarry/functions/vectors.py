"""Vector expressions, the stand-in embedder and the hook for a real one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .text import embedding_text, tokenize

HASHED_DIM = 384

# Given once per Python worker; returns a function from a batch of texts to a
# (batch, dim) matrix.
EmbedderFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def squared_norm(vector: Column) -> Column:
    return F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in element order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def normalize(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Scale a vector column to unit length; a zero vector stays zero.

    The norm is bound through a one-element array.  As a column of its own it
    would be merged into the inner function and worked out again per element.
    """
    def scale(norm: Column) -> Column:
        return F.transform(column, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))

    norms = F.array(F.sqrt(squared_norm(F.col(column))))
    return df.withColumn(into or column, F.element_at(F.transform(norms, scale), 1))


def hashed_embeddings(df: DataFrame, key: str, text: Column, dim: int = HASHED_DIM) -> DataFrame:
    """``(key, embedding)`` from signed hashed token counts, unit length.

    A deterministic stand-in for a language model: it says how many hashed
    tokens two texts share and nothing about meaning.
    """
    # A text without tokens leaves one row without a token and weight 0.
    hashed = F.md5(F.coalesce("token", F.lit("")).cast("binary"))
    counts = (
        df.select(key, text.alias("_text"))
        .repartition(key)
        .select(key, F.explode_outer(tokenize(F.col("_text"))).alias("token"))
        .select(
            key,
            # The first eight hex digits name the slot, the next one the sign.
            F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int").alias("slot"),
            F.when(F.substring(hashed, 9, 1) < "8", 1).otherwise(-1).alias("sign"),
            F.col("token").isNotNull().alias("has"))
        .groupBy(key, "slot").agg(F.sum(F.when(F.col("has"), F.col("sign")).otherwise(0)).alias("weight"))
    )
    slots = F.map_from_entries(F.collect_list(F.struct("slot", "weight")))
    dense = counts.groupBy(key).agg(slots.alias("_slots")).select(
        key,
        F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.coalesce(F.try_element_at("_slots", i), F.lit(0)).cast("double")).alias("embedding"))
    return normalize(dense, "embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))


def model_embeddings(
    df: DataFrame, key: str, text: Column, make_embedder: EmbedderFactory, batch_size: int = 256
) -> DataFrame:
    """``(key, embedding)`` from a plugged-in model, one call per Arrow batch."""

    def make_predict():
        embed = make_embedder()
        return lambda texts: np.asarray(embed(np.asarray(texts).reshape(-1)), dtype=np.float32)

    encode = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    encoded = df.select(key, encode(text).alias("embedding"))
    return normalize(encoded, "embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))


def embed_units(units: DataFrame, make_embedder: EmbedderFactory | None = None, dim: int = HASHED_DIM) -> DataFrame:
    """``(id, embedding)`` of every unit."""
    text = embedding_text(F.col("class_name"), F.col("name"), F.col("code"))
    if make_embedder is None:
        return hashed_embeddings(units, "id", text, dim)
    return model_embeddings(units, "id", text, make_embedder)


def embedder_name(make_embedder: EmbedderFactory | None) -> str | None:
    """Name that the vectors of an embedder are stored under.

    None for closures, lambdas and objects, whose name does not tell which
    model they hold.
    """
    if make_embedder is None:
        return f"hashed-{HASHED_DIM}"
    name = getattr(make_embedder, "__qualname__", "<object>")
    return None if "<" in name or hasattr(make_embedder, "__self__") else f"{make_embedder.__module__}.{name}"


def vector_keys(units: DataFrame, name: str) -> DataFrame:
    """``(id, key)``: units of one key hand the same text to the embedder of that name."""
    text = embedding_text(F.col("class_name"), F.col("name"), F.col("code"))
    return units.select("id", F.sha2(F.concat(F.lit(name + "\0"), text).cast("binary"), 256).alias("key"))


def embed_queries(queries: DataFrame, make_embedder: EmbedderFactory | None = None, dim: int = HASHED_DIM) -> DataFrame:
    """``queries`` with an ``embedding`` column from the same embedder as the units."""
    text = F.col("text")
    vectors = (
        hashed_embeddings(queries, "query_id", text, dim) if make_embedder is None
        else model_embeddings(queries, "query_id", text, make_embedder))
    return queries.drop("embedding").join(vectors, "query_id")
