"""Turn results back into source text and listings, one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import runtime
from ..functions.text import qualified_name, unit_label

# Separators of the assembled text.
CHUNK_SEPARATOR = "\n\n// " + "-" * 40 + "\n\n"
LISTING_SEPARATOR = "\n" + "-" * 20 + "\n"


def _two_decimals(score: Column) -> Column:
    return F.format_string("%.2f", score)


def _provenance() -> Column:
    """``(score: 0.00)`` for a match, ``(calls, depth 1)`` for an expanded unit."""
    return F.when(
        F.col("relationship").isNotNull(),
        F.concat(F.lit("("), "relationship", F.lit(", depth "), F.col("expansion_depth").cast("string"), F.lit(")")),
    ).otherwise(F.concat(F.lit("(score: "), _two_decimals(F.col("score")), F.lit(")")))


def _with_expansion_columns(results: DataFrame) -> DataFrame:
    if "relationship" in results.columns:
        return results
    return results.withColumns({
        "relationship": F.lit(None).cast("string"), "expansion_depth": F.lit(None).cast("int")})


def chunks(results: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, pos, chunk``: label, location, provenance and source of every result."""
    source = units.select("id", "name", "class_name", "file_path", "start_line", "end_line", "code")
    located = runtime.fetch(_with_expansion_columns(results), source)
    chunk = F.concat(
        F.lit("// "), unit_label(F.col("class_name"), F.col("name")),
        F.lit("\n// "), "file_path", F.lit(":"), "start_line", F.lit("-"), "end_line",
        F.lit(" "), _provenance(), F.lit("\n"), "code")
    return located.select("query_id", "pos", chunk.alias("chunk"))


def _joined(df: DataFrame, column: str, separator: str) -> DataFrame:
    """``query_id, _text``: the column of a query's rows in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", column)))
    return df.groupBy("query_id").agg(
        F.array_join(F.transform(rows, lambda row: row[column]), separator).alias("_text"))


def build_context(results: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, context``: the source of all results in rank order.

    Size follows from the number of results; there is no token budget.  A query
    without results gets a message.
    """
    empty = F.concat(
        F.lit('// No relevant functions found for query: "'), F.col("text"),
        F.lit('"\n// Build the index first, or rephrase the query.'))
    joined = _joined(chunks(results, units), "chunk", CHUNK_SEPARATOR)
    return queries.select("query_id", "text").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("_text", empty).alias("context"))


def result_lines(results: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, pos, line``: one line per result, ``Class.name() — file:line (…)``."""
    shown = units.select("id", "name", "class_name", "file_path", "start_line")
    line = F.concat(
        qualified_name(F.col("class_name"), F.col("name")), F.lit("() — "),
        "file_path", F.lit(":"), "start_line", F.lit(" "), _provenance())
    return runtime.fetch(_with_expansion_columns(results), shown).select("query_id", "pos", line.alias("line"))


def result_summary(results: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, summary``: the lines of a query, or a message."""
    empty = F.concat(F.lit('No matches found for "'), F.col("text"), F.lit('". Has the index been built?'))
    joined = _joined(result_lines(results, units), "line", "\n")
    return queries.select("query_id", "text").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("_text", empty).alias("summary"))


def result_listing(results: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, listing``: label, location and score or relationship on lines of their own."""
    shown = units.select("id", "name", "class_name", "file_path", "start_line", "end_line")
    last = F.when(
        F.col("relationship").isNotNull(),
        F.concat(F.lit("Relationship: "), "relationship", F.lit(" (depth "),
                 F.col("expansion_depth").cast("string"), F.lit(")")),
    ).otherwise(F.concat(F.lit("Score: "), _two_decimals(F.col("score"))))
    entry = F.concat(
        unit_label(F.col("class_name"), F.col("name")), F.lit("\n"),
        "file_path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("\n"), last)
    entries = runtime.fetch(_with_expansion_columns(results), shown).select("query_id", "pos", entry.alias("entry"))
    empty = F.concat(F.lit('No matches found for "'), F.col("text"), F.lit('". Has the index been built?'))
    joined = _joined(entries, "entry", LISTING_SEPARATOR)
    return queries.select("query_id", "text").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("_text", empty).alias("listing"))
