import os

import pytest

from unitquarry.sources import files, tree


@pytest.fixture
def root(tmp_path):
    made = {
        "a.ts": "alpha", "_app.tsx": "app", "b/c.js": "gamma", "b/c/d.ts": "delta", "b/c/e/f.mjs": "phi", "b2/x.ts": "bee", "_pages/p.tsx": "page",
        "node_modules/m.js": "no", "gen/g.ts": "generated", "b/.hidden/h.ts": "no", "b/n.d.ts": "no", "notes.txt": "no", "ü/ö.ts": "umlaut", "bad.ts": ""}
    for path, text in made.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (tmp_path / "bad.ts").write_bytes(b"f(\xff)")
    os.symlink(tmp_path, tmp_path / "b" / "loop")
    return str(tmp_path)


def test_equals_the_listing(spark, root, monkeypatch):
    for folders in (1, 3, tree.FOLDERS):
        monkeypatch.setattr(tree, "FOLDERS", folders)
        found = tree.read_tree(spark, root, ["gen/**"])
        want = files.list_tree(spark, root, ["gen/**"])
        assert sorted(found.collect()) == sorted(want.select(found.columns).collect())
        read = {r.path: r.content for r in tree.read_tree(spark, root, ["gen/**"], content=True).collect()}
        assert read == {r.path: r.content for r in files.read_contents(want, root).collect()}
        assert read["_app.tsx"] == "app" and read["bad.ts"] == "f(�)" and "gen/g.ts" not in read


def test_content_is_read_only_where_asked(root, monkeypatch):
    opened, plain = [], files.read_text
    monkeypatch.setattr(files, "read_text", lambda store, base, path: opened.append(path) or plain(store, base, path))
    for content in (False, True):
        reader = tree.TreeReader(root, [], content)
        rows = sum(batch.num_rows for w in reader.partitions() for batch in reader.read(w))
        assert len(opened) == (rows if content else 0)


def test_files_of_a_folder_are_shared_out(root, monkeypatch):
    monkeypatch.setattr(tree, "TASK_FILES", 2)
    reader = tree.TreeReader(root, [], False)
    walks = reader.partitions()
    assert sum(w.folder == "" for w in walks) == 2
    paths = [p for w in walks for batch in reader.read(w) for p in batch.column(0).to_pylist()]
    assert len(paths) == len(set(paths)) and {"a.ts", "b/c/e/f.mjs", "gen/g.ts"} <= set(paths)


def test_path_filters_reach_the_scan(root, monkeypatch):
    entered, plain = [], files.entries
    monkeypatch.setattr(files, "entries", lambda store, base, folder, patterns: entered.append(folder) or plain(store, base, folder, patterns))

    def scan(*filters):
        entered.clear()
        reader = tree.PushedTreeReader(root, [], False)
        left = list(reader.pushFilters(list(filters)))
        return sorted(p for w in reader.partitions() for batch in reader.read(w) for p in batch.column(0).to_pylist()), set(entered), left

    paths, seen, left = scan(tree.StringStartsWith(("path",), "b/c/"))
    assert paths == ["b/c/d.ts", "b/c/e/f.mjs"] and seen == {"", "b", "b/c", "b/c/e"} and left == []
    paths, seen, _ = scan(tree.EqualTo(("path",), "b/c.js"))
    assert paths == ["b/c.js"] and seen == {"", "b"}
    paths, seen, left = scan(tree.In(("path",), ("a.ts", "b2/x.ts", None)), tree.EqualTo(("size",), 5))
    assert paths == ["a.ts", "b2/x.ts"] and seen == {"", "b2"} and len(left) == 1
    paths, seen, _ = scan(tree.StringStartsWith(("path",), "b"), tree.StringStartsWith(("path",), "_"))
    assert paths == [] and seen <= {""}
    assert scan(tree.EqualTo(("path",), "absent/z.ts"))[0] == []


def test_pushed_filters_give_the_same_rows(spark, root):
    condition = "path LIKE 'b%' AND size > 3"
    want = sorted(files.list_tree(spark, root).filter(condition).collect())
    assert sorted(tree.read_tree(spark, root).filter(condition).collect()) == want
    spark.conf.set(tree.PUSHDOWN, "true")
    try:
        assert sorted(tree.read_tree(spark, root).filter(condition).collect()) == want and len(want) > 2
        assert tree.read_tree(spark, root).filter("path = 'nowhere.ts'").count() == 0
    finally:
        spark.conf.unset(tree.PUSHDOWN)


def test_empty_folder(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path), content=True).count() == 0
