"""Source trees as a Spark data source: ``spark.read.format("source_tree")``.

``register(spark)`` makes the format known; ``read_tree`` does that and reads.
A scan has ``path, mtime_ms, size`` and, with the option ``content``, the text;
without it no file is opened.  Planning lists folders only until there are
enough of them to keep the tasks busy; tasks walk the rest.  Conditions on
``path`` (equal, one of, prefix) reach the scan where Spark hands filters to
Python sources: folders outside them are neither listed nor entered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from . import files

FORMAT = "source_tree"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# Folders to find before tasks are made, files of one folder in a task, and bytes of text in a batch.
FOLDERS = 256
TASK_FILES = 2_000
BATCH_BYTES = 1 << 23
BATCH_ROWS = 10_000

_SOURCE = re.compile(files.SOURCE_PATH)


@dataclass
class Walk(InputPartition):
    """A folder with all below it, or share ``part`` of ``parts`` of the files directly in it."""

    folder: str
    deep: bool
    part: int = 0
    parts: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, root: str, ignore: Sequence[str], content: bool) -> None:
        self.root, self.content = root, content
        self.ignored = files.ignore_patterns(ignore)
        # Every condition is a tuple of prefixes and a set of paths of which one must fit; all conditions must hold.
        self.conditions: list[tuple[tuple[str, ...], frozenset[str]]] = []

    def _fits(self, path: str) -> bool:
        return all(path in exact or path.startswith(prefixes) for prefixes, exact in self.conditions)

    def _leads(self, folder: str) -> bool:
        """Can anything below the folder fit?"""
        start = f"{folder}/" if folder else ""
        return all(
            start.startswith(prefixes) or any(wanted.startswith(start) for wanted in (*prefixes, *exact))
            for prefixes, exact in self.conditions)

    def partitions(self) -> list[Walk]:
        store, base = files.filesystem(self.root)
        patterns = [re.compile(p) for p in self.ignored]
        level, walks = [""] if self._leads("") else [], []
        while level and len(level) < FOLDERS:
            below = []
            for folder in level:
                found = 0
                for path, is_dir, _, _ in files.entries(store, base, folder, patterns):
                    if is_dir and self._leads(path):
                        below.append(path)
                    found += not is_dir and bool(_SOURCE.match(path)) and self._fits(path)
                parts = -(-found // TASK_FILES)
                walks += [Walk(folder, False, i, parts) for i in range(parts)]
            level = below
        # Without anything to read, Spark still asks for a partition.
        return walks + [Walk(folder, True) for folder in level] or [Walk("", False, 0, 0)]

    def _rows(self, walk: Walk) -> Iterator[tuple[str, int, int]]:
        store, base = files.filesystem(self.root)
        patterns = [re.compile(p) for p in self.ignored]
        waiting = [walk.folder] if walk.parts else []
        while waiting:
            for path, is_dir, mtime_ms, size in files.entries(store, base, waiting.pop(), patterns):
                if is_dir:
                    if walk.deep and self._leads(path):
                        waiting.append(path)
                elif _SOURCE.match(path) and self._fits(path) and zlib.crc32(path.encode()) % walk.parts == walk.part:
                    yield path, mtime_ms, size

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        store, base = files.filesystem(self.root)
        names = ["path", "mtime_ms", "size", "content"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names[: len(columns)])

        rows, held = [], 0
        for path, mtime_ms, size in self._rows(partition):
            rows.append((path, mtime_ms, size, files.read_text(store, base, path)) if self.content else (path, mtime_ms, size))
            held += size if self.content else 0
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class PushedTreeReader(TreeReader):
    """With conditions on ``path``; the others go back to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            kind, of = type(condition), getattr(condition, "attribute", None)
            if of != ("path",) or kind not in (EqualTo, In, StringStartsWith):
                yield condition
            elif kind is StringStartsWith:
                self.conditions.append(((condition.value,), frozenset()))
            else:
                values = condition.value if kind is In else [condition.value]
                self.conditions.append(((), frozenset(v for v in values if v is not None)))


class SourceTree(DataSource):
    """Options: ``path``, ``ignore`` (globs, one a line), ``content`` and ``push`` (true or false)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _on(self, option: str) -> bool:
        return str(self.options.get(option, "false")).lower() == "true"

    def schema(self) -> str:
        return "path string, mtime_ms bigint, size bigint" + (", content string" if self._on("content") else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushedTreeReader if self._on("push") else TreeReader
        ignore = [glob for glob in str(self.options.get("ignore", "")).split("\n") if glob]
        return kind(self.options["path"], ignore, self._on("content"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)


def read_tree(spark: SparkSession, root: str, ignore: Sequence[str] = (), content: bool = False) -> DataFrame:
    """Source files below a folder or store URI that all executors can reach.

    Nothing is read before an action.  Filters are pushed if the session has
    ``spark.sql.python.filterPushdown.enabled``.
    """
    register(spark)
    push = spark.conf.get(PUSHDOWN, "false")
    return (
        spark.read.format(FORMAT).option("ignore", "\n".join(ignore)).option("content", str(content).lower())
        .option("push", push).load(root))
