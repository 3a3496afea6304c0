"""A directory tree of text files as a Spark data source.

Built-in file sources drop names that start with a dot or an underscore, so the tree is listed here:
``spark.read.format("bundle").option("path", root)``. The driver lists names only; executors read the
bytes, from any file system that the Arrow library opens (a local or shared folder, or a URI), and
whether they are a text is decided in Spark. Only what the listing found is ever read, so no path in
a question or a link leads out of the tree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.functions.text import dirname
from gleaner.shipping import ship

#: Where this engine keeps its own files in a tree.
STATE = ".gleaner"
#: Names that are no concepts, and directories that are not walked (fixed values).
RESERVED = frozenset({"index.md", "log.md", "_error.log"})
SKIP_DIRS = frozenset({
    STATE, ".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", ".next", ".nuxt",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".cache", ".tox", "coverage", ".coverage", "target",
})
FILES_IN_PARTITION = 256
SCHEMA = "path string, kind string, content binary"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI, and the folder's path there."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def as_text(content: Column) -> Column:
    """Bytes that are UTF-8 without NUL as a text with one kind of line end; null for others."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0")), F.regexp_replace(text, "\r\n?", "\n"))


def listing(store: fs.FileSystem, root: str, eager: bool, folder: str = "") -> Iterator[tuple[str, str]]:
    """(path, kind) of files and indexes, a directory's files by name before its directories.

    Lazy: any extension, no dotfiles, no symbolic links, skipped directories left out. Eager:
    Markdown only, hidden directories and all others but the engine's own are walked."""
    found = store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
    local = isinstance(store, fs.LocalFileSystem)
    named = sorted((f.base_name, f.type == fs.FileType.Directory, local and os.path.islink(f.path)) for f in found)
    at = lambda name: f"{folder}/{name}" if folder else name
    for name, is_dir, linked in named:
        if is_dir or linked and not eager:
            continue
        if name == "index.md":
            yield at(name), "index"
        elif name not in RESERVED and name[0] != "." and (not eager or name.lower().endswith(".md")):
            yield at(name), "file"
    hidden = {STATE} if eager else SKIP_DIRS
    for name, is_dir, linked in named:
        if is_dir and not linked and name not in hidden:
            yield from listing(store, root, eager, at(name))


class _Files(InputPartition):
    def __init__(self, files):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, eager: bool):
        self.root, self.eager = root, eager

    def partitions(self):
        files = list(listing(*opened(self.root), self.eager))
        return [_Files(files[i : i + FILES_IN_PARTITION]) for i in range(0, len(files), FILES_IN_PARTITION)] or [_Files([])]

    def read(self, partition):
        store, root = opened(self.root)
        for path, kind in partition.files:
            try:
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    content = stream.read()
            except OSError:  # unreadable, or gone since it was listed
                content = None
            yield path, kind, content


class BundleSource(DataSource):
    """Options: path, eager (false)."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("eager", "false").lower() == "true")


def load(spark: SparkSession, root: str, eager: bool = False) -> DataFrame:
    """path, kind (file or index), raw (null: binary or unreadable, yet listed) of a tree."""
    ship(spark)
    spark.dataSource.register(BundleSource)
    where = root if "://" in root else os.path.abspath(root)
    found = spark.read.format("bundle").option("path", where).option("eager", str(eager).lower()).load()
    return found.select("path", "kind", as_text(F.col("content")).alias("raw"))


def files_of(tree: DataFrame) -> DataFrame:
    """path, raw of the readable files."""
    return tree.filter("kind = 'file' and raw is not null").select("path", "raw")


def indexes_of(tree: DataFrame) -> DataFrame:
    """path (the directory), text of the indexes."""
    return tree.filter("kind = 'index' and raw is not null").select(dirname(F.col("path")).alias("path"), F.col("raw").alias("text"))


def directories_of(tree: DataFrame) -> DataFrame:
    """path of every directory with a file or an index below it."""
    return tree.select(F.explode(F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("path")).distinct()


def at_paths(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, ...) with kind and raw of the tree's file or index of that path; null where there is
    none, so also for absolute paths, paths with dots, and paths into skipped or linked folders."""
    return asked.join(tree.select("path", "kind", "raw"), "path", "left")
