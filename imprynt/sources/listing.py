"""A folder tree as a DataFrame, listed by the executors: a Python data source whose partitions are folders.

The driver lists only the top of the tree, level by level until there are enough folders to deal out;
each partition walks the folders of its own. Folders that an exclude glob prunes are not entered,
names beginning with "_" or "." are names like any other, and names that are not valid UTF-8 are
counted but cannot be a row's.

With symbolic links followed, a folder can be reached by several ways, also in circles. A walk never
enters a folder that it is inside of or has been to; what several partitions have listed is told apart
afterwards: the first way in name order to a folder is its own, and what was listed through any other
way goes. So the rows do not depend on how folders were dealt out.

The tree must be mounted at the same path on all executors. Other stores know no links; there Spark's
own listing serves (see files.scan_library).
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, rel_path string, size long, mtime_ns long, device long, inode long"


class Folder(InputPartition):
    """Folders to walk: (path from the root with "/" behind it, ids of the folders above and of its own)."""

    def __init__(self, folders: list[tuple[str, tuple]]):
        super().__init__(None)
        self.folders = folders


class Rules:
    def __init__(self, extensions: tuple[str, ...], exclude: tuple[str, ...]):
        from imprynt.sources.files import glob_regex

        self.ends = tuple(e.lower() for e in extensions)
        self.skip = [re.compile(glob_regex(g)) for g in exclude]
        self.prune = [re.compile(glob_regex(g[:-3])) for g in exclude if g.endswith("/**")]

    def enters(self, rel: str) -> bool:
        return not any(p.match(rel) for p in self.prune)

    def takes(self, rel: str) -> bool:
        return rel.lower().endswith(self.ends) and not any(p.match(rel) for p in self.skip)


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.follow = options.get("followsymlinks", "false").lower() == "true"
        self.rules = Rules(tuple(filter(None, options.get("extensions", "").split("|"))), tuple(filter(None, options.get("exclude", "").split("|"))))
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        """The root's own rows go with the first partition: folders above the dealt ones are listed there, not walked."""
        info = os.stat(self.root)
        above, front = [], [("", ((info.st_dev, info.st_ino),))]
        while front and len(front) < self.wanted:
            above += front
            front = [(rel, ids) for folder in front for kind, rel, ids in self._folder(*folder) if kind == "enter"]
        each = max(1, -(-len(front) // (4 * self.wanted)))
        return [Folder([(f"\0{rel}", ids) for rel, ids in above]), *(Folder(front[i : i + each]) for i in range(0, len(front), each))]

    def _folder(self, rel: str, ids: tuple) -> Iterator[tuple]:
        """What is in a folder, in name order: ("enter", path, ids) of folders to walk, ("file", ...) and ("skipped", ...)."""
        try:
            entries = sorted(os.scandir(f"{self.root}/{rel}"), key=lambda e: e.name)
        except OSError:
            return  # gone meanwhile, or not readable
        for e in entries:
            path = f"{rel}{e.name}"
            try:
                path.encode("utf-8")
            except UnicodeEncodeError:
                yield "skipped", None, None
                continue
            try:
                if e.is_dir(follow_symlinks=self.follow):
                    info = e.stat(follow_symlinks=self.follow)
                    own = (info.st_dev, info.st_ino)
                    if self.rules.enters(path) and not (self.follow and own in ids):
                        yield "enter", f"{path}/", (*ids, own)
                elif e.is_file(follow_symlinks=self.follow) and self.rules.takes(path):
                    info = e.stat(follow_symlinks=self.follow)
                    if stat.S_ISREG(info.st_mode):
                        yield "file", path, (info.st_size, info.st_mtime_ns)
            except OSError:
                continue

    def read(self, partition: Folder) -> Iterator[tuple]:
        seen: set[tuple[int, int]] = set()
        for rel, ids in partition.folders:
            only_here = rel.startswith("\0")
            stack = [("enter", rel.removeprefix("\0"), ids)]
            while stack:  # in name order: what a folder holds is put on the stack the other way round
                kind, path, what = stack.pop()
                if kind == "file":
                    yield kind, path, *what, None, None
                elif kind == "skipped":
                    yield kind, None, 1, None, None, None
                elif not self.follow or what[-1] not in seen:
                    seen.add(what[-1])
                    if self.follow:
                        yield "folder", path, None, None, *what[-1]
                    below = list(self._folder(path, what))
                    stack += reversed([x for x in below if not only_here or x[0] != "enter"])


class LibraryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(dict(self.options))


def name_order(path: str):
    """A path as a key that orders trees by name, folder by folder: "/" comes before any other character."""
    return F.translate(path, "/", "\0")


def list_library(spark: SparkSession, root: str, extensions: tuple[str, ...], exclude: tuple[str, ...] = (), follow_symlinks: bool = False, partitions: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rel_path, size, mtime_ns) of the files, and (skipped_names), one row."""
    spark.dataSource.register(LibraryFiles)
    rows = spark.read.format("library_files").options(extensions="|".join(extensions), exclude="|".join(exclude), followSymlinks=str(follow_symlinks).lower(), partitions=str(partitions)).load(root)
    skipped = rows.where("kind = 'skipped'").agg(F.count("*").alias("skipped_names"))
    files = rows.where("kind = 'file'").select("rel_path", "size", "mtime_ns")
    if not follow_symlinks:
        return files, skipped
    folders = rows.where("kind = 'folder'").select("rel_path", "device", "inode").distinct()
    first = folders.groupBy("device", "inode").agg(F.min(name_order("rel_path")).alias("way"))
    known = folders.join(first, ["device", "inode"]).select("rel_path", (name_order("rel_path") != F.col("way")).alias("other"))
    # a folder goes if it, or any folder above it on this way, is reached by an earlier way
    depth = F.size(F.split("rel_path", "/")) - 1
    parts = folders.select("rel_path", F.explode(F.sequence(F.lit(0), depth)).alias("k")).select(F.col("rel_path").alias("folder"), F.when(F.col("k") == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split("rel_path", "/"), F.lit(1), F.greatest("k", F.lit(1))), "/"), F.lit("/"))).alias("rel_path"))
    gone = parts.join(known.where("other"), "rel_path").select("folder").distinct()
    inside = files.withColumn("folder", F.regexp_extract("rel_path", "^(.*/)?", 0))
    return inside.join(gone, "folder", "left_anti").drop("folder").dropDuplicates(["rel_path"]), skipped
