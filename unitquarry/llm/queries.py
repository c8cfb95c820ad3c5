"""Queries of the operators over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitquarry.llm import ann, capfilter, html, langid, lexical, mixing, packing, ppm, ppm_text, quality, simhash, trie, urlfilter, winnow

# Fixed rules of the URL query: (action, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in length buckets with the least padding, batched by token budget."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the tries of those that are not held out."""
    return ppm_text.score(table(spark, sf_dir, "documents"), ppm.bucket_of(F.col("doc_id"), 7) == 2)


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash and component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op5_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op6_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents and all pages; a row has either a doc_id or a page_id."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.train(docs.select("text", "lang"))
    return langid.identify(langid.document_evidence(docs).unionByName(langid.page_evidence(pages)), model)


# Score from which a document counts as good.
GOOD = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Model of ``labels.quality`` learned from the documents whose bucket of five is not 0."""
    return quality.train(docs, table(spark, sf_dir, "labels"), F.coalesce(ppm.bucket_of(F.col("doc_id"), 5) != 0, F.lit(False)))


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality_model(spark, docs, sf_dir))
    held = F.coalesce(ppm.bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links and components."""
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    return mixing.mixed_words(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op10_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with host, path, rule and verdict."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the fingerprints of their texts and of their edited texts."""
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op12_geometric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_euler_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_length_buckets, op2_ppm_score, op3_simhash_golay, op4_collision_neighbours, op5_block_text, op6_evidence_fusion, op7_crf_quality, op8_cap_filters, op9_pivotal_mix, op10_url_ratio,
                                op11_winnowing, op12_geometric_search, op13_euler_trie)
}

# Fixed pattern of a search term, for DuckDB.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op13_euler_trie": """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(flatten(list_prepend([4294967295], list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda k: [CAST(ascii(k) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, e: xor(xor(s, e) >> 1, 3988292384 * (xor(s, e) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)),
taken AS (
  SELECT v.c, v.h, count(o.c) AS n FROM convs v LEFT JOIN own o ON o.c = v.base AND o.at <= v.h GROUP BY v.c, v.h),
turns AS (
  SELECT v.c, o.at AS d, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.at <= v.h
  UNION ALL
  SELECT t.c, o.at - t.h + t.n, o.role, o.text FROM taken t JOIN own o ON o.c = t.c AND o.at > t.h),
steps AS (
  SELECT c, d, octet_length(encode(text)) AS bytes,
    list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS path
  FROM turns),
every AS (
  SELECT c, d, bytes, array_to_string(path, '/') AS key, array_to_string(path[:-2], '/') AS up FROM steps
  UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
lengths AS (SELECT c, max(d) AS d FROM every GROUP BY c),
nodes AS (
  SELECT e.d, e.key, min(e.up) AS up, min(e.c) AS conv_id, count(*) AS n_convs, max(e.bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(l.c AS VARCHAR), ',' ORDER BY l.c), '')) AS ends_sha256
  FROM every e LEFT JOIN lengths l ON l.c = e.c AND l.d = e.d GROUP BY e.d, e.key),
family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.key = n.up AND p.d = n.d - 1
  LEFT JOIN (SELECT d - 1 AS d, up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL) k ON k.up = n.key AND k.d = n.d),
sums AS (
  SELECT a.d, a.key, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens
  FROM family a JOIN family b ON b.d >= a.d AND (a.d = 0 OR b.key = a.key OR starts_with(b.key, a.key || '/')) GROUP BY a.d, a.key)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN sums USING (d, key)
""",
    "op12_geometric_search": f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
held AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
reps AS (SELECT item_id, term, count(*) AS reps FROM asked GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(
    reps * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM reps JOIN tf USING (term) JOIN df USING (term) CROSS JOIN counted GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
""",
    "op8_cap_filters": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.u = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
""",
}
