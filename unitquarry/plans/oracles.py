"""The registered queries again, as SQL over the same tables.

Written another way where that gives an independent check: tokens by
replacement and splitting, call resolution by ranking joined candidates,
expansion unrolled per level, extraction from the rule the sources are
generated by.
"""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.evaluate import FULL, HYBRID, KEYWORD
from ..sources import report
from .views import SOURCE_FORMS, SOURCE_SEPARATOR

ORACLES: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WHITE = (
    "[\\x09-\\x0d\\x20\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+")


def _camel(text: str) -> str:
    return f"regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


def _tokens(text: str) -> str:
    words = f"string_split(lower(regexp_replace({_camel(text)}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')"
    return f"list_filter({words}, lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


def _pieces(name: str) -> str:
    words = f"regexp_split_to_array(lower(regexp_replace({_camel(name)}, '[_.-]', ' ', 'g')), '{_WHITE}')"
    return f"list_filter({words}, lambda t: t <> '')"


_TITLE = r"^\s*([^.\n]*)"
_DOCS = f"""docs AS (
  SELECT doc_id AS id, regexp_extract(text, '{_TITLE}', 1) AS name, lang AS class_name, source AS file_path,
         text AS code, 1 AS start_line, len(string_split(text, chr(10)))::INTEGER AS end_line
  FROM documents)"""
_PAGES = """pgs AS (
  SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name,
         regexp_extract(url, '^https?://([^/]*)', 1) AS class_name, url AS file_path, html AS code
  FROM pages)"""
_ITEMS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"


def _terms(units: str, cap: int | None) -> str:
    body = _tokens("code")
    if cap is not None:
        body = f"({body})[1:{cap}]"
    return f"""terms AS (
  SELECT id, token, sum(w) AS fixed, sum(b) AS tf FROM (
    SELECT id, unnest(list_distinct({_pieces('name')})) AS token, 15 AS w, 0 AS b FROM {units}
    UNION ALL SELECT id, unnest(list_distinct({_pieces('class_name')})), 10, 0 FROM {units}
    UNION ALL SELECT id, unnest({body}), 0, 1 FROM {units})
  GROUP BY id, token)"""


def _keyword(units: str, queries: str, cap: int | None = None) -> str:
    """CTEs ``terms``, ``asked`` and ``kw`` (query_id, id, score)."""
    return f"""{_terms(units, cap)},
asked AS (
  SELECT query_id, len(toks) AS n, unnest(toks) AS token
  FROM (SELECT query_id, list_distinct({_tokens('text')}) AS toks FROM {queries})),
kw AS (
  SELECT query_id, id, least(0.99::DOUBLE,
    (sum(fixed + least(5, tf))::DOUBLE / 5.0::DOUBLE) / ((3 * any_value(n))::DOUBLE + 0.01::DOUBLE)) AS score
  FROM terms JOIN asked USING (token) GROUP BY query_id, id)"""


def _top(scored: str, k: int, into: str) -> str:
    return f"""{into} AS (
  SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS pos, id, score
    FROM {scored} WHERE score > 0.1::DOUBLE) WHERE pos <= {k})"""


_HYBRID = """vec AS (
  SELECT query_id, id, list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS sem
  FROM (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id) q
  CROSS JOIN (SELECT doc_id AS id, embedding FROM documents JOIN embeddings ON vec_id = doc_id) u),
hy AS (
  SELECT query_id, id, CASE WHEN query_id IN (SELECT vec_id FROM embeddings)
    THEN 0.6::DOUBLE * coalesce(sem, 0) + 0.4::DOUBLE * coalesce(score, 0) ELSE score END AS score
  FROM kw FULL JOIN vec USING (query_id, id))"""

ORACLES["q_tokenize"] = f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token"
ORACLES["q_split_identifier"] = f"""WITH {_DOCS}
SELECT id, (nth - 1)::INTEGER AS nth, p[nth] AS piece
FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS nth FROM (SELECT id, {_pieces('name')} AS p FROM docs))"""
ORACLES["q_body_tf"] = f"""SELECT id, token, count(*) AS tf
FROM (SELECT doc_id AS id, unnest(({_tokens('text')})[1:500]) AS token FROM documents) GROUP BY id, token"""
ORACLES["q_postings"] = f"""WITH {_PAGES}, {_terms('pgs', None)}
SELECT token, id, fixed IN (15, 25) AS in_name, fixed IN (10, 25) AS in_class, tf::BIGINT AS tf FROM terms"""
ORACLES["q_token_estimate"] = f"""WITH {_DOCS}
SELECT id, file_path || ':' || name AS key,
  CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || name || '()' AS label,
  ceil(length(code) / 4.0)::BIGINT AS tokens FROM docs"""
ORACLES["q_keyword_topk"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 5, 'best')}
SELECT query_id, pos, id, round(score, 6) AS score FROM best"""
ORACLES["q_keyword_pages"] = f"""WITH {_PAGES}, titles AS (SELECT id AS query_id, name AS text FROM pgs),
{_keyword('pgs', 'titles', None)}, {_top('kw', 3, 'best')}
SELECT query_id, pos, id, round(score, 6) AS score FROM best"""
ORACLES["q_keyword_index"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 5, 'best')}
SELECT query_id, pos, id, round(score, 6) AS score, name, file_path, start_line, end_line, class_name
FROM best JOIN docs USING (id)"""
ORACLES["q_semantic_topk"] = f"""WITH vec AS (
  SELECT q.item_id AS query_id, u.vec_id AS id, list_dot_product(v.embedding::DOUBLE[], u.embedding::DOUBLE[]) AS score
  FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id CROSS JOIN embeddings u), {_top('vec', 5, 'best')}
SELECT query_id, pos, id, round(score, 6) AS score FROM best"""
ORACLES["q_semantic_clusters"] = ORACLES["q_semantic_topk"]
ORACLES["q_hybrid_topk"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_HYBRID}, {_top('hy', 5, 'best')}
SELECT query_id, pos, id, round(score, 6) AS score FROM best"""
ORACLES["q_similarity"] = """SELECT u.vec_id, round(list_dot_product(v.embedding::DOUBLE[], u.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings u JOIN benchmark q ON q.item_id = u.label JOIN embeddings v ON v.vec_id = q.item_id"""
ORACLES["q_normalize"] = """WITH scaled AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS v FROM embeddings),
normed AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM scaled)
SELECT vec_id, (nth - 1)::INTEGER AS nth, round(CASE WHEN norm > 0 THEN v[nth] / norm ELSE 0 END, 6) AS x
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS nth FROM normed)"""
ORACLES["q_embed_text"] = f"""WITH {_DOCS}
SELECT id, CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || name || chr(10) || code AS embedded FROM docs"""



def _embedded(rows: str, key: str) -> str:
    """The stand-in embedder over ``rows`` (key, embedded), 64 slots."""
    return f"""hashed AS (SELECT {key}, md5(token) AS h FROM (SELECT {key}, unnest({_tokens('embedded')}) AS token FROM {rows})),
weights AS (
  SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS w
  FROM hashed GROUP BY ALL),
norms AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM weights GROUP BY {key})
SELECT r.{key}, s.nth::INTEGER AS nth, round(CASE WHEN norm > 0 THEN coalesce((w / norm)::FLOAT::DOUBLE, 0) ELSE 0 END, 6) AS x
FROM {rows} r CROSS JOIN (SELECT unnest(range(0, 64)) AS nth) s
LEFT JOIN weights w ON w.{key} = r.{key} AND w.slot = s.nth LEFT JOIN norms n ON n.{key} = r.{key}"""


ORACLES["q_embed_units"] = f"""WITH {_DOCS}, texts AS (
  SELECT id, CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || name || chr(10) || code AS embedded FROM docs),
{_embedded('texts', 'id')}"""
ORACLES["q_embed_queries"] = f"""WITH {_ITEMS}, texts AS (SELECT query_id, text AS embedded FROM items),
{_embedded('texts', 'query_id')}"""

# --- index maintenance ----------------------------------------------------

_FILES = """cur AS (
  SELECT 'src/' || o_orderkey || '.ts' AS path,
    (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::BIGINT AS mtime_ms,
    (floor(o_totalprice) + CASE WHEN o_orderstatus = 'P' THEN 10 ELSE 0 END)::BIGINT AS size
  FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')),
old AS (
  SELECT 'src/' || o_orderkey || '.ts' AS path,
    (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000)::BIGINT AS mtime_ms, floor(o_totalprice)::BIGINT AS size
  FROM orders WHERE o_orderpriority <> '1-URGENT'),
diff AS (
  SELECT c.path, c.mtime_ms, c.size, CASE WHEN o.path IS NULL THEN 'new'
    WHEN c.mtime_ms = o.mtime_ms AND c.size = o.size THEN 'unchanged' ELSE 'changed' END AS status
  FROM cur c LEFT JOIN old o ON o.path = c.path)"""
ORACLES["q_changed_files"] = f"WITH {_FILES} SELECT *, status <> 'unchanged' AS reindex FROM diff"
ORACLES["q_forced_files"] = f"WITH {_FILES} SELECT *, TRUE AS reindex FROM diff"
ORACLES["q_stale_files"] = f"""WITH {_FILES}
SELECT *, status <> 'unchanged' OR EXISTS (SELECT 1 FROM documents WHERE lang = 'fr') AS reindex FROM diff"""
ORACLES["q_upsert_files"] = f"""WITH {_FILES}
SELECT * FROM old WHERE path NOT IN (SELECT path FROM diff WHERE status <> 'unchanged')
UNION ALL SELECT path, mtime_ms, size FROM diff WHERE status <> 'unchanged'"""
ORACLES["q_prune_missing"] = f"WITH {_FILES} SELECT * FROM old WHERE path NOT IN (SELECT path FROM cur)"
ORACLES["q_replace_by_file"] = f"""WITH {_DOCS}
SELECT CASE WHEN regexp_matches(file_path, '[13579]$') THEN -id - 1 ELSE id END AS id, name, file_path, code FROM docs"""
ORACLES["q_scan_filter"] = """WITH paths AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^m\\.', 'build/'), '^www\\.', '.www/')
    || CASE WHEN contains(url, '/en/') THEN '.ts' WHEN contains(url, '/fr/') THEN '.jsx'
            WHEN contains(url, '/de/') THEN '.d.ts' ELSE '.min.js' END AS path FROM pages),
clean AS (SELECT page_id, regexp_replace(path, '/{2,}', '/', 'g') AS path FROM paths)
SELECT page_id, path FROM clean WHERE path NOT LIKE '.%' AND path NOT LIKE '%/.%'
  AND list_contains(['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'], string_split(path, '.')[-1])
  AND path NOT LIKE '%.d.ts' AND path NOT LIKE '%.min.js'
  AND len(list_filter(string_split(path, '/')[:-2],
    lambda d: d IN ('node_modules', 'dist', 'build', '.git', 'coverage') OR starts_with(d, 'spam-'))) = 0"""
_PARTS = """units AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_name || '_' || p_partkey ELSE p_name END AS name,
    CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS class_name, p_type || '/' || (p_partkey % 40) AS file_path,
    1 AS start_line, p_size AS end_line, p_type || ' ' || p_brand AS code FROM part),
nexts AS (
  SELECT l_orderkey AS order_id, l_partkey AS caller_id,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee_id FROM lineitem),
edges AS (SELECT DISTINCT caller_id, callee_id FROM nexts WHERE callee_id IS NOT NULL AND caller_id <> callee_id)"""
ORACLES["q_delete_edges"] = f"""WITH {_PARTS},
gone AS (SELECT id FROM units WHERE file_path IN (SELECT file_path FROM units WHERE class_name = 'Brand#7'))
SELECT caller_id, callee_id FROM edges
WHERE caller_id NOT IN (SELECT id FROM gone) AND callee_id NOT IN (SELECT id FROM gone)"""
ORACLES["q_index_stats"] = f"""WITH {_FILES}
SELECT count(*) FILTER (status <> 'unchanged') AS files_scanned, (SELECT count(*) FROM documents) AS functions_indexed,
  (SELECT count(*) FROM old) AS files FROM diff"""

# --- extraction -----------------------------------------------------------

ORACLES["q_segment_lines"] = """WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, nth::INTEGER AS line, p[nth] AS code FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS nth FROM cut)),
ranged AS (SELECT *, coalesce(sum(length(code) + 1) OVER (PARTITION BY doc_id ORDER BY line
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start_offset FROM lines)
SELECT doc_id, line, start_offset, (start_offset + length(code))::INTEGER AS end_offset, code FROM ranged"""
ORACLES["q_call_sites"] = """WITH scripts AS (
  SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS s FROM pages),
masked AS (SELECT page_id, regexp_replace(s, '"[^"]*"', '""', 'g') AS m, s FROM scripts)
SELECT page_id::VARCHAR AS path, regexp_extract(m, '(\\w+)\\(', 1) AS name, NULL::VARCHAR AS receiver,
  (strpos(s, regexp_extract(m, '(\\w+\\()', 1)) + length(regexp_extract(m, '(\\w+\\()', 1)) - 2)::INTEGER AS at
FROM masked WHERE regexp_matches(m, '\\w+\\(')"""


def _form(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# What each source form holds: name, kind, class and exact text of its functions, and the calls in each as (name, receiver).
_FORM_UNITS = (
    (0, "fn_{k}", "function", None, "function fn_{k}(value) {\n  return helper_{s}(value);\n}", [("helper_{s}", None)]),
    (1, "arrow_{k}", "arrow", None, "async (value) => {\n  // not a brace: {\n  return this.step_{s}(value);\n}", [("step_{s}", "this")]),
    (2, "run_{k}", "method", "Part{k}",
     "@trace()\n  private async run_{k}(value: number): Promise<void> {\n    if (value > {s}) { log.write(\"}\"); }\n  }", [("trace", None), ("write", "log")]),
    (3, "pick_{k}", "arrow", None, "(value) => load_{s}(value) + {s}", [("load_{s}", None)]),
    (4, "size", "method", None, "get size() { return {s}; }", []),
    (4, "on_{k}", "function", None, "function (value) { return fn_{k}(value); }", [("fn_{k}", None)]),
    (5, "over_{k}", "function", None, "export function over_{k}(done: () => void): () => void {\n  watch_{s}(done);\n  return stop;\n}", [("watch_{s}", None)]),
    (6, "scan_{k}", "function", None, "function scan_{k}(text) {\n  if (text) /[{]/.test(text);\n  return text / {s} / 2;\n}", [("test", None)]),
    (7, "[key_{s}]", "arrow", None, "(value) => deep_{s}(`${`${inner_{k}(value)}`}}`)", [("deep_{s}", None), ("inner_{k}", None)]),
    (8, "default", "function", None, "export default async function (value) {\n  return await boot_{s}(value);\n}", [("boot_{s}", None)]),
    (9, "Store_{k}.prototype.save", "function", None, "function (value) { this.put_{s}(value); }", [("put_{s}", "this")]),
    (10, "constructor", "method", "<anonymous class>", "constructor(private size = start_{s}()) { this.size = size; }", [("start_{s}", None)]),
    (10, "area", "method", "<anonymous class>", "get area() { return this.size * {s}; }", []),
    (10, "area", "method", "<anonymous class>", "set area(value) { check_{k}(value); }", [("check_{k}", None)]),
    (10, "[Symbol.iterator]", "method", "<anonymous class>", "[Symbol.iterator]() { return each_{k}(this); }", [("each_{k}", None)]),
    (10, "quoted name", "method", "<anonymous class>", "'quoted name'() { return 1; }", []),
    (10, "#hidden", "method", "<anonymous class>", "#hidden() { return 2; }", []),
    (11, "pair_{k}", "function", None, "function pair_{k}(a: any) { return join_{s}(a, new Thing_{k}(a)); }", [("join_{s}", None)]),
    (12, "outer_{k}", "function", None,
     "function outer_{k}(list) {\n  function inner_{s}(item) { return item?.touch_{k}(); }\n  return list.map((item) => inner_{s}(item));\n}",
     [("touch_{k}", "item"), ("map", "list"), ("inner_{s}", None)]),
    (12, "inner_{s}", "function", None, "function inner_{s}(item) { return item?.touch_{k}(); }", [("touch_{k}", "item")]),
    (12, "<anonymous>", "arrow", None, "(item) => inner_{s}(item)", [("inner_{s}", None)]),
    (13, "tag_{k}", "arrow", None,
     "async (value) => {\n  await html`<p>${value}</p>`;\n  api?.load_{s}?.(value);\n  super_{k}.a.b.run(value);\n}", [("load_{s}", "api"), ("run", None)]),
    (14, "typed_{k}", "arrow", None, "(x: number): string => fmt_{s}(x)", [("fmt_{s}", None)]),
    (15, "items", "method", None, "async *items() { yield* list_{s}<Map<string, () => void>>(this); }", [("list_{s}", None)]),
    (15, "done", "arrow", None, "value => close_{k}(value)", [("close_{k}", None)]),
)


def _filled(text: str) -> str:
    return f"replace(replace({_form(text)}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)"


_FORMS = f"CASE p_partkey % {len(SOURCE_FORMS)} " + " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(SOURCE_FORMS)) + " END"
_CHUNKS = f"""chunks AS (
  SELECT p_partkey, p_size, p_partkey % {len(SOURCE_FORMS)} AS form, 'src/' || (p_partkey // 40) || '.ts' AS file_path, {_FORMS} AS chunk FROM part),
placed AS (
  SELECT *, coalesce(sum(length(chunk) + {len(SOURCE_SEPARATOR)}) OVER w, 0) AS base,
    coalesce(sum(length(chunk) - length(replace(chunk, chr(10), '')) + 2) OVER w, 0) AS base_line
  FROM chunks WINDOW w AS (PARTITION BY file_path ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _form_units() -> str:
    """Functions by the place of their text in the chunk."""
    return " UNION ALL ".join(
        f"SELECT *, {n} AS unit, {_filled(name)} AS name, '{kind}' AS kind, {_filled(owner) if owner else 'NULL'} AS class_name, "
        f"strpos(chunk, {_filled(code)}) - 1 AS s, {_filled(code)} AS code FROM placed WHERE form = {form}"
        for n, (form, name, kind, owner, code, _) in enumerate(_FORM_UNITS))


_UNITS = f"""{_CHUNKS},
marked AS ({_form_units()}),
found AS (SELECT *, s + length(code) AS e FROM marked),
fns AS (SELECT file_path, name, kind, class_name, (base + s)::INTEGER AS start_offset, (base + e)::INTEGER AS end_offset,
  (base_line + 1 + length(substr(chunk, 1, s)) - length(replace(substr(chunk, 1, s), chr(10), '')))::INTEGER AS start_line,
  (base_line + 1 + length(substr(chunk, 1, e)) - length(replace(substr(chunk, 1, e), chr(10), '')))::INTEGER AS end_line,
  code, p_partkey, p_size, unit FROM found)"""
ORACLES["q_extract_functions"] = f"""WITH {_UNITS}
SELECT file_path, name, kind, class_name, start_offset, end_offset, start_line, end_line, code FROM fns"""
ORACLES["q_extract_calls"] = f"WITH {_UNITS} " + " UNION ALL ".join(
    f"SELECT file_path, start_offset, {_filled(name)} AS name, {_form(receiver) if receiver else 'NULL'} AS receiver FROM fns WHERE unit = {n}"
    for n, (*_, calls) in enumerate(_FORM_UNITS) for name, receiver in calls)

ORACLES["q_rejected_sources"] = """SELECT DISTINCT 'src/' || (p_partkey // 40) || '.ts' AS path, 1 AS open_brackets, 0 AS lowest
FROM part WHERE (p_partkey // 40) % 2 = 1"""

# --- call graph -----------------------------------------------------------

_CALLS = f"""{_PARTS},
asked AS (
  SELECT caller_id, name, CASE order_id % 3 WHEN 0 THEN class_name WHEN 1 THEN 'this' END AS receiver
  FROM nexts JOIN units ON id = callee_id),
kinds AS (SELECT caller_id, name, receiver, count(*) AS n FROM asked GROUP BY ALL),
candidates AS (
  SELECT k.*, c.id AS cid, CASE WHEN receiver <> 'this' AND c.class_name = receiver THEN 1
      WHEN c.file_path = u.file_path AND c.class_name IS NOT DISTINCT FROM u.class_name THEN 2
      WHEN c.file_path = u.file_path THEN 3 ELSE 4 END AS fit,
    c.file_path = u.file_path AS near, c.class_name IS NOT DISTINCT FROM u.class_name AS kin
  FROM kinds k JOIN units u ON u.id = k.caller_id JOIN units c ON c.name = k.name),
counted AS (
  SELECT *, count(*) FILTER (fit = 1) OVER call AS owners, count(*) OVER call AS named
  FROM candidates WINDOW call AS (PARTITION BY caller_id, name, receiver)),
options AS (
  SELECT caller_id, name, receiver, cid, 1 AS rule FROM counted WHERE fit = 1 AND owners = 1
  UNION ALL SELECT caller_id, name, receiver, cid, 2 FROM counted WHERE near AND kin
  UNION ALL SELECT caller_id, name, receiver, cid, 3 FROM counted WHERE near
  UNION ALL SELECT caller_id, name, receiver, cid, 4 FROM counted WHERE named = 1),
chosen AS (
  SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY caller_id, name, receiver ORDER BY rule, cid) = 1),
resolved AS (
  SELECT k.caller_id, k.name, k.receiver, c.cid AS callee_id, c.rule, k.n FROM kinds k LEFT JOIN chosen c
  ON c.caller_id = k.caller_id AND c.name = k.name AND c.receiver IS NOT DISTINCT FROM k.receiver)"""
ORACLES["q_resolve_calls"] = f"WITH {_CALLS} SELECT caller_id, name, receiver, callee_id, rule::INTEGER AS rule, n FROM resolved"
ORACLES["q_call_edges"] = f"WITH {_CALLS} SELECT DISTINCT caller_id, callee_id FROM resolved WHERE callee_id <> caller_id"
# All calls resolved from scratch after the change.
_EDITED = _CALLS.replace("asked AS (", """olds AS (SELECT * FROM units),
edited AS (
  SELECT CASE WHEN touched THEN -id - 1 ELSE id END AS id,
    CASE WHEN touched AND end_line % 2 = 0 THEN name || ' new' ELSE name END AS name, class_name, file_path
  FROM (SELECT *, regexp_matches(file_path, '[13579]$') AS touched FROM olds)),
asked AS (""").replace(
    "SELECT caller_id, name, CASE order_id", "SELECT CASE WHEN regexp_matches(c.file_path, '[13579]$') THEN -caller_id - 1 ELSE caller_id END AS caller_id, u.name, CASE order_id").replace(
    "WHEN 0 THEN class_name", "WHEN 0 THEN u.class_name").replace(
    "FROM nexts JOIN units ON id = callee_id", "FROM nexts JOIN units u ON u.id = callee_id JOIN units c ON c.id = caller_id").replace(
    "FROM kinds k JOIN units u ON u.id = k.caller_id JOIN units c", "FROM kinds k JOIN edited u ON u.id = k.caller_id JOIN edited c")
ORACLES["q_update_edges"] = f"WITH {_EDITED} SELECT DISTINCT caller_id, callee_id, name FROM resolved WHERE callee_id <> caller_id"

_MATCHES = """matches AS (
  SELECT * FROM (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, id, score
    FROM (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS query_id, p_partkey AS id, p_retailprice / 10000 AS score FROM part))
  WHERE pos <= 3),
links AS (SELECT caller_id AS src, callee_id AS dst, 0 AS dir FROM edges UNION ALL SELECT callee_id, caller_id, 1 FROM edges),
level0 AS (SELECT query_id, pos, id, score, NULL::VARCHAR AS relationship, NULL::INTEGER AS expansion_depth FROM matches)"""


def _level(n: int) -> str:
    """Everything up to level ``n``: a neighbour keeps the first parent and direction that reach it."""
    from_last = "expansion_depth IS NULL" if n == 1 else f"expansion_depth = {n - 1}"
    return f"""reach{n} AS (
  SELECT query_id, dst AS id, p.pos AS parent, dir FROM level{n - 1} p JOIN links ON src = p.id
  WHERE {from_last} AND (query_id, dst) NOT IN (SELECT (query_id, id) FROM level{n - 1}) AND dst IN (SELECT id FROM units)
  QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY p.pos, dir) = 1),
level{n} AS (
  SELECT * FROM level{n - 1} UNION ALL
  SELECT query_id, (SELECT max(pos) FROM level{n - 1} l WHERE l.query_id = r.query_id)
      + row_number() OVER (PARTITION BY query_id ORDER BY parent, dir, id), id, 0.0,
    CASE dir WHEN 0 THEN 'calls' ELSE 'called-by' END, {n} FROM reach{n} r)"""


_SHOW_LEVEL = "SELECT query_id, pos::BIGINT AS pos, id, score::DOUBLE AS score, relationship, expansion_depth::INTEGER AS expansion_depth FROM"
ORACLES["q_expand_1"] = f"WITH {_PARTS}, {_MATCHES}, {_level(1)} {_SHOW_LEVEL} level1"
ORACLES["q_expand_2"] = f"WITH {_PARTS}, {_MATCHES}, {_level(1)}, {_level(2)} {_SHOW_LEVEL} level2"

# --- context --------------------------------------------------------------

_LABEL = "CASE WHEN class_name <> '' THEN class_name || '.' ELSE '' END || name || '()'"
_PROVENANCE = (
    "CASE WHEN relationship IS NOT NULL THEN '(' || relationship || ', depth ' || expansion_depth || ')' "
    "ELSE '(score: ' || printf('%.2f', score) || ')' END")
_SEPARATOR = "chr(10) || chr(10) || '// ' || repeat('-', 40) || chr(10) || chr(10)"


def _context(results: str, units: str, queries: str) -> str:
    return f"""texts AS (
  SELECT query_id, string_agg('// ' || {_LABEL} || chr(10) || '// ' || file_path || ':' || start_line || '-' || end_line
    || ' ' || {_PROVENANCE} || chr(10) || code, {_SEPARATOR} ORDER BY pos) AS t
  FROM {results} JOIN {units} USING (id) GROUP BY query_id)
SELECT query_id, coalesce(t, '// No relevant functions found for query: "' || text || '"' || chr(10)
  || '// Build the index first, or rephrase the query.') AS context FROM {queries} LEFT JOIN texts USING (query_id)"""


_BEST = "plain AS (SELECT *, NULL::VARCHAR AS relationship, NULL::INTEGER AS expansion_depth FROM best)"
ORACLES["q_context"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 6, 'best')}, {_BEST},
{_context('plain', 'docs', 'items')}"""
ORACLES["q_context_expanded"] = f"""WITH {_PARTS}, {_MATCHES}, {_level(1)},
brands AS (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS query_id, p_brand AS text FROM part),
{_context('level1', 'units', 'brands')}"""
ORACLES["q_result_lines"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 5, 'best')}, {_BEST}
SELECT query_id, pos, {_LABEL} || ' — ' || file_path || ':' || start_line || ' ' || {_PROVENANCE} AS line
FROM plain JOIN docs USING (id)"""
ORACLES["q_result_summary"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 5, 'best')}, {_BEST},
lines AS (
  SELECT query_id, string_agg({_LABEL} || ' — ' || file_path || ':' || start_line || ' ' || {_PROVENANCE}, chr(10) ORDER BY pos) AS t
  FROM plain JOIN docs USING (id) GROUP BY query_id)
SELECT query_id, coalesce(t, 'No matches found for "' || text || '". Has the index been built?') AS summary
FROM items LEFT JOIN lines USING (query_id)"""
ORACLES["q_result_listing"] = f"""WITH {_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 5, 'best')},
entries AS (
  SELECT query_id, string_agg({_LABEL} || chr(10) || file_path || ':' || start_line || '-' || end_line || chr(10)
    || 'Score: ' || printf('%.2f', score), chr(10) || repeat('-', 20) || chr(10) ORDER BY pos) AS t
  FROM best JOIN docs USING (id) GROUP BY query_id)
SELECT query_id, coalesce(t, 'No matches found for "' || text || '". Has the index been built?') AS listing
FROM items LEFT JOIN entries USING (query_id)"""

# --- evaluation -----------------------------------------------------------

_QRELS = """qrels AS (
  SELECT DISTINCT query_id, file_path || ':' || name AS key
  FROM (SELECT query_id, trim(unnest(regexp_split_to_array(text, '[.\\n]'))) AS sentence FROM items) q
  JOIN (SELECT file_path, name, trim(unnest(regexp_split_to_array(code, '[.\\n]'))) AS sentence FROM docs) d USING (sentence)
  WHERE length(sentence) >= 20),
keyed AS (SELECT id, file_path || ':' || name AS key, ceil(length(code) / 4.0)::BIGINT AS tokens FROM docs),
corpus AS (SELECT sum(ceil(length(text) / 4.0)) AS total FROM documents)"""


def _metrics(results: str, into: str) -> str:
    return f"""{into}_rows AS (
  SELECT query_id, key, (SELECT arg_min(tokens, id) FROM keyed f WHERE f.key = k.key) AS cost,
    (query_id, key) IN (SELECT (query_id, key) FROM qrels) AS good FROM {results} JOIN keyed k USING (id)),
{into} AS (
  SELECT query_id, coalesce(returned, 0)::BIGINT AS returned, coalesce(hits, 0)::BIGINT AS hits, coalesce(relevant, 0)::BIGINT AS relevant,
    coalesce(hits::DOUBLE / nullif(returned, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(relevant, 0), 0) AS recall,
    100.0::DOUBLE * (1 - coalesce(cost, 0)::DOUBLE / (SELECT total FROM corpus)) AS token_reduction_percent
  FROM items
  LEFT JOIN (SELECT query_id, count(*) AS returned, count(DISTINCT key) FILTER (good) AS hits, sum(cost) AS cost FROM {into}_rows GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY query_id) USING (query_id))"""


def _average(method: str, source: str) -> str:
    return f"SELECT '{method}' AS method, avg(token_reduction_percent) AS token_reduction_percent, avg(precision) AS precision, avg(recall) AS recall FROM {source}"


_WHOLE = f"""whole AS (
  SELECT '{FULL}' AS method, 0.0::DOUBLE AS token_reduction_percent, avg(coalesce(hits, 0)::DOUBLE / (SELECT count(*) FROM docs)) AS precision,
    avg(coalesce(hits::DOUBLE / relevant, 0)) AS recall
  FROM items LEFT JOIN (
    SELECT query_id, count(*) AS relevant, count(*) FILTER (key IN (SELECT key FROM keyed)) AS hits FROM qrels GROUP BY query_id) USING (query_id))"""
_EVAL = f"{_DOCS}, {_ITEMS}, {_keyword('docs', 'items')}, {_top('kw', 3, 'best')}, {_QRELS}, {_metrics('best', 'per_kw')}"
ORACLES["q_query_metrics"] = f"""WITH {_EVAL}
SELECT query_id, returned, hits, relevant, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(token_reduction_percent, 6) AS token_reduction_percent FROM per_kw"""
ORACLES["q_retrieval_eval"] = f"""WITH {_EVAL}, {_HYBRID}, {_top('hy', 3, 'best_hy')}, {_metrics('best_hy', 'per_hy')}, {_WHOLE}
SELECT method, round(token_reduction_percent, 6) AS token_reduction_percent, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM (SELECT * FROM whole UNION ALL {_average(KEYWORD, 'per_kw')} UNION ALL {_average(HYBRID, 'per_hy')})"""
_SUMMARY = """SELECT count(*) AS files, (SELECT count(*) FROM documents) AS functions, (SELECT count(*) FROM benchmark) AS scenarios,
  sum(ceil(length(text) / 4.0))::BIGINT AS estimated_repository_tokens FROM documents"""
ORACLES["q_corpus_summary"] = _SUMMARY


def _report_line(method: str, source: str, speed: str) -> str:
    return (
        f"(SELECT '| {method} | ' || {speed} || ' | 1.0 ms | ' || printf('%.1f', token_reduction_percent) || '% | ' "
        f"|| printf('%.1f', precision * 100) || '% | ' || printf('%.1f', recall * 100) || '% |' FROM {source})")


_speed = "printf('%.1f', (SELECT functions FROM summary) / 2.0) || ' funcs/s (2000.0 ms)'"
_notes = " || ".join(f"chr(10) || {_form('- ' + note)}" for note in report.NOTES)
ORACLES["q_report"] = f"""WITH {_EVAL}, {_WHOLE}, mean_kw AS ({_average(KEYWORD, 'per_kw')}), summary AS ({_SUMMARY})
SELECT '{report.TITLE}' || chr(10) || chr(10) || 'Generated: 2026-01-01T00:00:00.000Z' || chr(10) || chr(10)
  || (SELECT printf('Corpus: %d files, %d functions, %d queries, ~%d repository tokens.', files, functions, scenarios, estimated_repository_tokens) FROM summary)
  || chr(10) || chr(10) || '{report.HEADER[0]}' || chr(10) || '{report.HEADER[1]}' || chr(10)
  || {_report_line(FULL, 'whole', "'N/A'")} || chr(10) || {_report_line(KEYWORD, 'mean_kw', _speed)} || chr(10)
  || {_notes} || chr(10) AS report"""
