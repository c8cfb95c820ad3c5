"""Source trees: which files belong to the index and what is in them.

``files`` has ``path, mtime_ms, size``; ``contents`` adds ``content``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import runtime

# What counts as source, and what never does.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
DEFAULT_IGNORE = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**",
    "**/*.d.ts", "**/*.min.js",
)


def glob_pattern(glob: str) -> str:
    """Regular expression (Java, Python and RE2 alike) for a path glob with ``** * ? [..] {a,b}``."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "[" and "]" in glob[i + 1:]:
            end = glob.index("]", i + 1)
            out.append("[" + glob[i + 1:end].replace("!", "^", 1) + "]")
            i = end + 1
        else:
            c = glob[i]
            depth += (c == "{") - (c == "}")
            out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c)))
            i += 1
    return "^" + "".join(out) + "$"


def ignore_patterns(ignore: Sequence[str] = ()) -> list[str]:
    """The built-in patterns and the caller's, never instead of them.

    A pattern that fits a folder leaves out all that is below, and one that
    ends in ``/**`` fits the folder itself.
    """
    globs = [glob.removesuffix("/**") or "**" for glob in (*DEFAULT_IGNORE, *ignore)]
    return [glob_pattern(glob).removesuffix("$") + "(?:/.*)?$" for glob in globs]


# Path of dot-less components that ends in a source extension.
SOURCE_PATH = r"^(?:[^./][^/]*/)*[^./][^/]*\.(?:" + "|".join(EXTENSIONS) + ")$"


def is_source(path: Column, ignore: Sequence[str] = ()) -> Column:
    """True for the relative paths that belong to the index."""
    kept = path.rlike(SOURCE_PATH)
    for pattern in ignore_patterns(ignore):
        kept &= ~path.rlike(pattern)
    return kept


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, without a URI scheme and with doubled or ``./`` parts removed."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:(?://[^/]*)?(?=/)", "")
    below = F.regexp_replace(plain, "^" + re.escape(root.rstrip("/")) + "/+", "")
    return F.regexp_replace(F.regexp_replace(below, "(?:(?<=/)|^)\\./", ""), "/{2,}", "/")


def scan_files(table: DataFrame, root: str = "", ignore: Sequence[str] = ()) -> DataFrame:
    """Keep the source rows of a table with a ``path`` column, paths made relative to ``root``."""
    named = table.withColumn("path", relative_path(F.col("path"), root) if root else F.col("path"))
    return named.filter(is_source(F.col("path"), ignore))


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the folder's path in it; plain paths and ``file:``, ``s3:``, ``gs:`` or ``hdfs:`` URIs."""
    if "://" in root or root.startswith("file:"):
        store, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    else:
        store, base = fs.LocalFileSystem(), os.path.abspath(root)
    return store, base.rstrip("/")


def entries(store: fs.FileSystem, base: str, folder: str, patterns: Sequence[re.Pattern]) -> Iterator[tuple[str, bool, int, int]]:
    """``path, is_dir, mtime_ms, size`` of what is directly in a folder and not ignored, paths relative to ``base``."""
    here, local = f"{base}/{folder}" if folder else base, isinstance(store, fs.LocalFileSystem)
    for entry in store.get_file_info(fs.FileSelector(here)):
        path = f"{folder}/{entry.base_name}" if folder else entry.base_name
        is_dir = entry.type == fs.FileType.Directory
        if entry.base_name.startswith(".") or any(p.match(path) for p in patterns):
            continue
        if not is_dir and entry.type != fs.FileType.File:
            continue
        # A link to a folder above would be entered again and again.
        if is_dir and local and os.path.realpath(here).startswith(os.path.realpath(entry.path) + "/"):
            continue
        yield path, is_dir, (entry.mtime_ns or 0) // 1_000_000, entry.size or 0


def read_text(store: fs.FileSystem, base: str, path: str) -> str:
    """Content of a file.  Bytes that are no UTF-8 become U+FFFD."""
    with store.open_input_stream(f"{base}/{path}") as f:
        return f.read().decode("utf-8", "replace")


_ENTRIES = "path string, is_dir boolean, mtime_ms bigint, size bigint"


def list_tree(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """``path, mtime_ms, size`` of the source files under a folder or store URI all executors can reach.

    Spark's own listing hides names that start with ``_``, which are ordinary
    source files here, so folders are listed by the executors, one level per
    round.  Ignored folders are not entered.
    """
    patterns = [re.compile(p) for p in ignore_patterns(ignore)]

    def level_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = filesystem(root)
        for batch in batches:
            rows = [row for folder in batch["path"] for row in entries(store, base, folder, patterns)]
            yield pd.DataFrame(rows, columns=["path", "is_dir", "mtime_ms", "size"])

    parts = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([("",)], "path string")
    found = spark.createDataFrame([], "path string, mtime_ms bigint, size bigint")
    while not folders.isEmpty():
        level = runtime.cut(folders.repartition(parts, "path").mapInPandas(level_of, _ENTRIES))
        files = level.filter(~F.col("is_dir") & F.col("path").rlike(SOURCE_PATH))
        found = found.unionByName(files.drop("is_dir"))
        folders = level.filter("is_dir").select("path")
    return found


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` with ``content``, read by the executors.  Bytes that are no UTF-8 become U+FFFD."""
    schema = "path string, mtime_ms bigint, size bigint, content string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = filesystem(root)
        for batch in batches:
            # One file at a time, so a batch of large files is never held together.
            for row in batch.itertuples(index=False):
                yield pd.DataFrame([(row.path, row.mtime_ms, row.size, read_text(store, base, row.path))], columns=["path", "mtime_ms", "size", "content"])

    parts = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "mtime_ms", "size").repartition(parts, "path").mapInPandas(read, schema)


def binary_sources(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """``path, mtime_ms, size, content`` through Spark's file reader, for object stores.

    Content is only read where it is used.  This reader hides every file whose
    name, or whose folder's name, starts with ``_``.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root))
    table = raw.select(
        "path", F.unix_millis("modificationTime").alias("mtime_ms"),
        F.col("length").alias("size"), F.expr("make_valid_utf8(cast(content AS string))").alias("content"))
    return scan_files(table, root, ignore)
