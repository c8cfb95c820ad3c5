"""Units, queries, vectors, calls and files seen in the driver tables.

The tables hold no source code, so the operators run on views of them:
documents and pages act as units, benchmark items as queries, consecutive parts
of an order as calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import runtime

TITLE = r"^\s*([^.\n]*)"


def table(spark: SparkSession, sf_dir: str, name: str, text_key: str | None = None) -> DataFrame:
    """A driver table; ``text_key`` marks one whose text is costly to work on."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return runtime.spread(scan, text_key) if text_key else scan


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a unit: its title names it, its language is the class."""
    lines = F.size(F.split("text", "\n"))
    return table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("text", TITLE, 1).alias("name"),
        F.lit("function").alias("kind"),
        F.col("lang").alias("class_name"),
        F.col("source").alias("file_path"),
        F.lit(1).alias("start_line"),
        lines.alias("end_line"),
        F.lit(0).alias("start_offset"),
        F.length("text").alias("end_offset"),
        F.col("text").alias("code"))


def embedded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of the same number, where there is one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return document_units(spark, sf_dir).join(vectors, "id", "left")


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a unit: its title names it, its host is the class."""
    return table(spark, sf_dir, "pages", "page_id").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"),
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("class_name"),
        F.col("url").alias("file_path"),
        F.col("html").alias("code"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return text_queries(spark, sf_dir).join(vectors, "query_id", "left")


def next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_id, caller_id, callee_id``: each part of an order and the part after it."""
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", F.lead("l_partkey").over(in_order).alias("callee_id"))
        .filter(F.col("callee_id").isNotNull())
        .select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("caller_id"), "callee_id"))


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles as queries."""
    return page_units(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("name").alias("text"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own."""
    return table(spark, sf_dir, "documents", "doc_id").select(
        F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content"))


def shared_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels ``query_id, key``: units that repeat a sentence of the query word for word.

    The label rule asks for 20 characters, as shorter pieces are no statements.
    """
    def sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
        cut = df.select(*keep, F.explode(F.split(text, "[.\n]")).alias("sentence"))
        return cut.withColumn("sentence", F.trim("sentence")).filter(F.length("sentence") >= 20)

    # Repeats of the units go once they met the queries: most of their sentences meet none.
    wanted = sentences(text_queries(spark, sf_dir), "text", "query_id").distinct()
    units = document_units(spark, sf_dir).withColumn("key", F.concat_ws(":", "file_path", "name"))
    told = sentences(units, "code", "key")
    return runtime.lookup_join(told, wanted, ["sentence"], "inner", F.col("key"), "sentence").select(
        "query_id", "key").distinct()


def _days_ms(date: str) -> Column:
    return (F.datediff(date, F.lit("1970-01-01")) * F.lit(86_400_000).cast("bigint")).cast("bigint")


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders not marked urgent as the files of an earlier scan."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'")
    return orders.select(
        F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"),
        _days_ms("o_orderdate").alias("mtime_ms"),
        F.floor("o_totalprice").cast("bigint").alias("size"))


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as files now: status P grew, 2-HIGH was touched, 5-LOW with status F is gone."""
    orders = table(spark, sf_dir, "orders").filter("NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')")
    return orders.select(
        F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"),
        (_days_ms("o_orderdate") + F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)).alias("mtime_ms"),
        (F.floor("o_totalprice") + F.when(F.col("o_orderstatus") == "P", 10).otherwise(0)).cast("bigint").alias("size"))


def touched_paths(units: DataFrame) -> DataFrame:
    """Paths that end in an odd digit."""
    return units.filter(F.col("file_path").rlike("[13579]$")).select(F.col("file_path").alias("path")).distinct()


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as file paths: hosts become folders, languages become extensions."""
    below = F.regexp_replace("url", "^https?://", "")
    below = F.regexp_replace(below, "^m\\.", "build/")
    below = F.regexp_replace(below, "^www\\.", ".www/")
    ending = (
        F.when(F.col("url").contains("/en/"), ".ts").when(F.col("url").contains("/fr/"), ".jsx")
        .when(F.col("url").contains("/de/"), ".d.ts").otherwise(".min.js"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("file:/srv/project/"), below, ending).alias("path"))


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of every page, one after the other."""
    return table(spark, sf_dir, "pages", "page_id").select(
        F.col("page_id").cast("string").alias("path"),
        F.array_join(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1)), "\n").alias("content"))


def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a unit: a quarter of the names is made unique, a third has no class."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 4 == 0, F.concat_ws("_", "p_name", key)).otherwise(F.col("p_name")).alias("name"),
        F.when(key % 3 != 0, F.col("p_brand")).alias("class_name"),
        F.concat_ws("/", "p_type", (key % 40).cast("string")).alias("file_path"),
        F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("code"))


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part calls the next part of its order by name, with three kinds of receiver."""
    callee = part_units(spark, sf_dir).select(F.col("id").alias("callee_id"), "name", "class_name")
    kind = F.col("order_id") % 3
    named = runtime.lookup_join(
        next_parts(spark, sf_dir), callee, ["callee_id"], "inner", F.col("order_id"), "name", "class_name")
    return named.select(
        "caller_id", "name", F.when(kind == 0, F.col("class_name")).when(kind == 1, "this").alias("receiver"))


def edited_parts(units: DataFrame) -> DataFrame:
    """``part_units`` after files that end in an odd digit changed: new ids, and every second unit has a new name."""
    touched = F.col("file_path").rlike("[13579]$")
    return units.select(
        F.when(touched, -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        F.when(touched & (F.col("end_line") % 2 == 0), F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"),
        "class_name", "file_path")


def edited_calls(units: DataFrame, calls: DataFrame) -> DataFrame:
    """``part_calls`` after the same change; what is called keeps its name."""
    touched = units.filter(F.col("file_path").rlike("[13579]$")).select(F.col("id").alias("caller_id"), F.lit(True).alias("touched"))
    marked = runtime.lookup_join(calls, touched, ["caller_id"], "left", F.xxhash64("name", "receiver"))
    return marked.select(F.when(F.col("touched"), -F.col("caller_id") - 1).otherwise(F.col("caller_id")).alias("caller_id"), "name", "receiver")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_parts(spark, sf_dir).filter("caller_id <> callee_id").select("caller_id", "callee_id").distinct()


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per brand."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select(
        F.regexp_extract("p_brand", "(\\d+)", 1).cast("bigint").alias("query_id"), F.col("p_brand").alias("text"))


def part_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of a brand as its ranked matches."""
    ranked = table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", "(\\d+)", 1).cast("bigint").alias("query_id"),
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10000).alias("score"))
    return runtime.top_k(ranked, "query_id", [F.desc("score"), F.asc("id")], 3)


# Source text of a part, by p_partkey modulo the number of forms.  {k} is the part's key, {s} its size.
SOURCE_FORMS = (
    "function fn_{k}(value) {\n  return helper_{s}(value);\n}",
    "export const arrow_{k} = async (value) => {\n  // not a brace: {\n  return this.step_{s}(value);\n};",
    "class Part{k} extends Base {\n  @trace()\n  private async run_{k}(value: number): Promise<void> {\n"
    "    if (value > {s}) { log.write(\"}\"); }\n  }\n}",
    "export const pick_{k} = (value) => load_{s}(value) + {s};",
    "const table_{k} = {\n  get size() { return {s}; },\n  on_{k}: function (value) { return fn_{k}(value); }\n};",
    "export function over_{k}(done: () => void): () => void {\n  watch_{s}(done);\n  return stop;\n}",
    "function scan_{k}(text) {\n  if (text) /[{]/.test(text);\n  return text / {s} / 2;\n}",
    "const nest_{k} = {\n  [key_{s}]: (value) => deep_{s}(`${`${inner_{k}(value)}`}}`),\n};",
    "export default async function (value) {\n  return await boot_{s}(value);\n}",
    "Store_{k}.prototype.save = function (value) { this.put_{s}(value); };",
    "const Box{k} = class {\n  constructor(private size = start_{s}()) { this.size = size; }\n  get area() { return this.size * {s}; }\n"
    "  set area(value) { check_{k}(value); }\n  [Symbol.iterator]() { return each_{k}(this); }\n  'quoted name'() { return 1; }\n"
    "  #hidden() { return 2; }\n};",
    "function pair_{k}(a: string): string;\nfunction pair_{k}(a: number): number;\n"
    "function pair_{k}(a: any) { return join_{s}(a, new Thing_{k}(a)); }",
    "function outer_{k}(list) {\n  function inner_{s}(item) { return item?.touch_{k}(); }\n  return list.map((item) => inner_{s}(item));\n}",
    "const tag_{k} = async (value) => {\n  await html`<p>${value}</p>`;\n  api?.load_{s}?.(value);\n  super_{k}.a.b.run(value);\n};",
    "type Fn{k} = (value: number) => void;\ninterface Shape{k} { area(value: string): void; pick: (x: number) => string }\n"
    "const typed_{k}: (x: number) => string = (x: number): string => fmt_{s}(x);",
    "const view_{k} = {\n  async *items() { yield* list_{s}<Map<string, () => void>>(this); },\n  done: value => close_{k}(value),\n};",
)
SOURCE_SEPARATOR = "\n\n"


def damaged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated files without their last character; odd files also lose the brace before it."""
    number = F.regexp_extract("path", "(\\d+)", 1).cast("int")
    length = F.length("content") - 1 - number % 2
    return generated_sources(spark, sf_dir).select("path", F.substring(F.col("content"), F.lit(1), length).alias("content"))


def generated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: source files written from the parts, forty parts to a file."""
    form = F.element_at(F.array(*map(F.lit, SOURCE_FORMS)), (F.col("p_partkey") % len(SOURCE_FORMS) + 1).cast("int"))
    filled = F.replace(
        F.replace(form, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("src/"), F.floor(F.col("p_partkey") / 40).cast("string"), F.lit(".ts")).alias("path"),
        "p_partkey", filled.alias("chunk"))
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", "chunk")))
    return parts.groupBy("path").agg(
        F.array_join(F.transform(ordered, lambda c: c["chunk"]), SOURCE_SEPARATOR).alias("content"))
