import corpus
from unitquarry.operators import extract

CASES = {
    "plain.ts": "// sums\nfunction total(items, tax) {\n  let sum = 0;\n  for (const item of items) sum += item.price * item.count;\n  return sum * (1 + tax);\n}\n",
    "arrow.ts": "let seen = 0;\nexport const visit = ({ id }, ...rest) => {\n  seen += rest.length;\n};\n",
    "methods.ts": "class Queue {\n  #items = [];\n  push(item) { this.#items.push(item); }\n  protected async drain(limit) {\n    while (limit--) await this.shift();\n"
                  "  }\n  private shift() { return this.#items.shift(); }\n}\n",
    "flow.ts": "class Robot {\n  step(map) {\n    do { turn(); } while (blocked());\n    switch (map.get(here())) { case wall(1): { return } default: walk() }\n"
               "    try { jump() } catch { fall() } finally { rest() }\n    label: for (;;) { break label }\n    if (map) { } else if (tired()) { sleep() }\n  }\n}\n",
    "lines.ts": "const k = 2;\n\nfunction up(\n  n,\n) { return n + k; }\nconst down = function (n) { return n - k; };\n\n\nfunction both(n) {\n  return down(\n    up(n));\n}\n",
    "modern.ts": "@component({ tag: 'x-box' })\nexport class Box<T extends object> {\n  @input() size = 1;\n  @hook('a')\n  static async *pull<K>(this: Box<K>, key: K): "
                 "AsyncGenerator<Map<K, string>> { yield key; }\n}\nexport async function* read<A, B = A>(a: A): AsyncIterable<B> {\n"
                 "  const inner = async <Q,>(q: Q) => { return q; };\n  yield inner(a);\n}\nexport default function () { return 0; }\n",
    "members.ts": "export default class extends Base {\n  static #n = 0;\n  onClick = (e) => { go(e); };\n  cb: (x: number) => void;\n"
                  "  constructor(private a: string) { super(a); this.later = () => a + 1 }\n  get size(): number { return 1 }\n  set size(v) { this.v = v }\n"
                  "  abstract shape(a: string): void;\n  over(a: string): { a: number };\n  over(a: any): { a: number } { return { a } }\n"
                  "  *gen() { yield 1 }\n  async *many() {}\n  [Symbol.iterator]() { return this.gen() }\n  'quoted name'() {}\n"
                  "  static async delete(id: string): Promise<void> { return api.delete(id) }\n}\n",
    "types.ts": "type Fn = (a: number) => void;\ninterface Shape { area(a: string): void; pick: (x) => string }\n"
                "declare function outside(a: string): void;\nfunction twice(a: string): void\nfunction twice(a: any) { return a }\n"
                "const typed: (x: number) => string = (x: number): string => `n${fmt(x)} (}`;\n"
                "function options({ on }: { on: () => void }, cb = () => 1) { return on() }\n",
    "names.js": "const o = { a: function () { return 1 }, b: (x) => x ? 1 : 2, ['c' + 1]: async y => { await y }, m(q) { return q }, 'n-n': () => { } };\n"
                "module.exports = function named() { return 1 };\nexports.run = async (a) => a.b;\nlist.map(x => x.id).filter((y) => !!y);\n"
                "const t = cond ? (a) => f(a) : (b) => g(b);\nconst later = a => b => a + b\nexport default (z) => z;\n",
    "masks.js": "// function no() {}\n/* class X { y() {} } */\nconst re = /[{(]\"/g, h = () => re.test(\"}{\");\nconst s = 'function q() {';\n"
                "const t = `${items.map((i) => `<li>${show(i)}</li>`)} function r() {`;\nfunction yes() { return a / b / c }\n",
    "nested.ts": "class Outer {\n  make() {\n    return class Inner {\n      deep() { return () => 1 }\n    };\n  }\n  after() {}\n}\nfunction free() {}\n",
    "noend.js": "const a = x => x + 1\nconst b = y =>\n  y.map(z => z)\n   .filter(Boolean)\nconst c = () => ({ k: 1 })\n",
}
EXPECTED = {
    "plain.ts": [("total", "function", None)],
    "arrow.ts": [("visit", "arrow", None)],
    "methods.ts": [("push", "method", "Queue"), ("drain", "method", "Queue"), ("shift", "method", "Queue")],
    "flow.ts": [("step", "method", "Robot")],
    "lines.ts": [("up", "function", None), ("down", "function", None), ("both", "function", None)],
    "modern.ts": [("pull", "method", "Box"), ("read", "function", None), ("inner", "arrow", None), ("default", "function", None)],
    "members.ts": [(n, k, "<anonymous class>") for n, k in [
        ("<anonymous>", "arrow"), ("constructor", "method"), ("this.later", "arrow"), ("size", "method"), ("size", "method"),
        ("over", "method"), ("gen", "method"), ("many", "method"), ("[Symbol.iterator]", "method"), ("quoted name", "method"),
        ("delete", "method")]],
    "types.ts": [("twice", "function", None), ("typed", "arrow", None), ("options", "function", None), ("<anonymous>", "arrow", None)],
    "names.js": [("a", "function", None), ("b", "arrow", None), ("['c' + 1]", "arrow", None), ("m", "method", None), ("n-n", "arrow", None),
                 ("named", "function", None), ("exports.run", "arrow", None), ("<anonymous>", "arrow", None), ("<anonymous>", "arrow", None),
                 ("<anonymous>", "arrow", None), ("<anonymous>", "arrow", None), ("later", "arrow", None), ("<anonymous>", "arrow", None),
                 ("default", "arrow", None)],
    "masks.js": [("h", "arrow", None), ("<anonymous>", "arrow", None), ("yes", "function", None)],
    "nested.ts": [("make", "method", "Outer"), ("deep", "method", "Inner"), ("<anonymous>", "arrow", "Inner"), ("after", "method", "Outer"),
                  ("free", "function", None)],
    "noend.js": [("a", "arrow", None), ("b", "arrow", None), ("<anonymous>", "arrow", None), ("c", "arrow", None)],
}


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def extracted(spark, texts):
    rows = extract.extract_functions(sources(spark, texts)).orderBy("file_path", "start_offset").collect()
    out = {path: [] for path in texts}
    for r in rows:
        content = texts[r.file_path]
        assert r.code == content[r.start_offset:r.end_offset] and r.end_offset > r.start_offset
        assert r.start_line == content[:r.start_offset].count("\n") + 1
        assert r.end_line == content[:r.end_offset - 1].count("\n") + 1
        out[r.file_path].append(r)
    return out


def test_shapes(spark):
    found = extracted(spark, CASES)
    for path, want in EXPECTED.items():
        assert [(r.name, r.kind, r.class_name) for r in found[path]] == want, path


def test_ranges(spark):
    found = extracted(spark, CASES)
    assert [(r.start_line, r.end_line) for r in found["lines.ts"]] == [(3, 5), (6, 6), (9, 12)]
    pull, read, inner, _ = found["modern.ts"]
    assert pull.start_line == 4 and pull.code.startswith("@hook('a')\n  static async") and pull.code.endswith("{ yield key; }")
    assert read.code.startswith("export async function*") and inner.code == "async <Q,>(q: Q) => { return q; }"
    assert [r.code for r in found["noend.js"]] == ["x => x + 1", "y =>\n  y.map(z => z)\n   .filter(Boolean)", "z => z", "() => ({ k: 1 })"]
    assert [r.code for r in found["names.js"]][9:13] == ["(a) => f(a)", "(b) => g(b)", "a => b => a + b", "b => a + b"]


def test_calls(spark):
    texts = {
        "a": "const rank = (team) => { const best = sort(team); if (best) this.show(best); Board.draw(best, sort(best)); }",
        "b": "login(a): Promise<{ x: number }> { if (a) return super.f(a.b.f(), g().h(), a?.i(), j?.(), k.l?.(), n.o<P>(2)); "
             "`${q(1)} r(2) ${`${s(3)}`}`; 't(1)'; u`v`; w[1](2); import('x'); @dec.x(1) class A { m(z) { } sig(a: string): void } }",
        "c": "async (x) => new Thing(y(1)).go(new a.b.Cls(2)); /* no() */ c ? d(1) : e(2); switch (f) { case g(3): h(4) } p.catch(q)",
        "d": "twice(); twice(); Twice.twice(); this.twice()",
    }
    rows = extract.extract_calls(sources(spark, texts)).orderBy("path", "at").collect()
    found = {p: [(r.name, r.receiver) for r in rows if r.path == p] for p in texts}
    assert found["a"] == [("sort", None), ("show", "this"), ("draw", "Board")]
    assert found["b"] == [("f", None), ("g", None), ("h", None), ("i", "a"), ("j", None), ("l", "k"), ("o", "n"),
                          ("q", None), ("s", None), ("x", "dec")]
    assert found["c"] == [("y", None), ("go", None), ("d", None), ("e", None), ("g", None), ("h", None), ("catch", "p")]
    assert found["d"] == [("twice", None), ("twice", "Twice"), ("twice", "this")]


def test_rejects_and_long_text(spark):
    texts = {"ok.js": "f({[]})", "open.js": "function a() { if (x) {", "early.js": "} f()",
             "long.js": "const s = \"" + "\\n" * 3000 + "\"; /*" + "*" * 20000 + "*/ const f = () => [" + "1, " * 20000 + "2];"}
    assert {r.path for r in extract.rejected_sources(sources(spark, texts)).collect()} == {"open.js", "early.js"}
    assert [r.name for r in extracted(spark, {"long.js": texts["long.js"]})["long.js"]] == ["f"]


def test_corpus(spark):
    found = extracted(spark, corpus.SOURCES)
    assert [(p, r.name, r.kind, r.class_name) for p in sorted(found) for r in found[p]] == corpus.FUNCTIONS


def test_lines(spark):
    text = "one\n\nthree \U0001f600\n"
    rows = extract.segment_lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("line").collect()
    assert [r.code for r in rows] == text.split("\n")
    assert all(text[r.start_offset:r.end_offset] == r.code for r in rows)


def test_lines_of_many_texts_move_nothing(spark):
    texts = [None, "", "\n", "a", "a\n\nb\r\n", "\u00e9\U0001f600\n" * 3000, *[f"x{i}\n" * (i % 4) for i in range(700)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string").coalesce(1)
    found = extract.segment_lines(df, "doc", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.doc, []).append((r.line, r.start_offset, r.end_offset, r.code))
    for i, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        want, at = [], 0
        for n, line in enumerate(lines, 1):
            want.append((n, at, at + len(line), line))
            at += len(line) + 1
        assert got.get(i, []) == want
    assert extract.segment_lines(df.limit(0), "doc", "text").count() == 0


MORE = {
    "returned.ts": ("function over(cb: () => void): () => void { go(cb); return () => cb(); }", [("over", "function", None), ("<anonymous>", "arrow", None)], ["go", "cb"]),
    "typeargs.ts": ("x = new Map<string, () => void>();\nsubscribe(cb: Listener): () => void { on(cb) }", [], ["on"]),
    "regex.js": ("function f(s) { if (s) /[{]/.test(s); return s; }\nconst re =\n\n        /[{]/; function g() { return a / b }", [("f", "function", None), ("g", "function", None)], ["test"]),
    "deep.js": ("const a = `${`${`${`${deep(1)}`}`}`}`; function h() { }", [("h", "function", None)], ["deep"]),
    "text.jsx": ("function J(x) { return <div>Don't {fmt(x)} won't</div>; }\nconst K = () => (<A b={f(1)} c='}'>see http://a.b/c {call()} <B/> </A>);\nfunction after() { k() }",
                 [("J", "function", None), ("K", "arrow", None), ("after", "function", None)], ["fmt", "f", "call", "k"]),
    "members.ts": ("class X<T extends Y<() => void>> implements Z { f?: (a: string) => void; g!: () => void = () => h(); static { init(); } async m<T>(): Promise<() => void> { return p(); } [k]() {} }",
                   [("<anonymous>", "arrow", "X"), ("m", "method", "X"), ("[k]", "method", "X")], ["h", "init", "p"]),
    "statements.js": ("switch (a) { case 1: { foo(); break } default: bar() } label: while (x) { y() } for (const z of w()) {} do { v() } while (u())", [], ["foo", "bar", "y", "w", "v", "u"]),
    "targets.js": ("A.prototype.run = function () { };\nlet { u = () => 1 } = v, z = function () {};\nexport default async (q) => q;",
                   [("A.prototype.run", "function", None), ("u", "arrow", None), ("z", "function", None), ("default", "arrow", None)], []),
}


def test_further_forms(spark):
    found = extracted(spark, {p: text for p, (text, *_) in MORE.items()})
    calls = {}
    for r in extract.extract_calls(sources(spark, {p: text for p, (text, *_) in MORE.items()})).orderBy("path", "at").collect():
        calls.setdefault(r.path, []).append(r.name)
    for path, (_, functions, names) in MORE.items():
        assert [(r.name, r.kind, r.class_name) for r in found[path]] == functions, path
        assert calls.get(path, []) == names, path


def test_unclosed_functions_and_line_ends(spark):
    rows = extract.extract_functions(sources(spark, {"open.js": "function f() { if (x) { go(", "cr.js": "a\rfunction q() {\r}\u2028function r() {}"})).orderBy("start_offset").collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [("f", 1, 1), ("q", 2, 3), ("r", 4, 4)]
    assert rows[0].code == "function f() { if (x) { go("


def test_any_text_is_read(spark):
    odd = ["", "(" * 3000, "`${" * 2000, "<div>" * 2000, "a<b," * 2000, "x => " * 300, "}" * 50, "class " * 500, "const a: " * 500, "\x00", "'", "/*", "//", "/", "`", "<", "@", "#"]
    assert extract.outlines(sources(spark, {f"{i}.tsx": t for i, t in enumerate(odd)} | {f"{i}.ts": t for i, t in enumerate(odd)})).count() == 2 * len(odd)


def test_nothing_is_shuffled(spark):
    plan = extract.extract_functions(sources(spark, CASES))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
