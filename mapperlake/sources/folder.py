"""A folder of XML files as a data source of Spark's, for folders that driver and executors both see.

The driver walks the folder: names in order, folders behind links once (by their real path), tools' folders left out, what can't be listed as a row.
Files are dealt to partitions by their bytes. A task reads a file's head first; only a file that the head calls a mapper, or can't tell, is read to its
end. A file that can't be read is a row with the reason UNREADABLE, one above the limit a row with TOO_LARGE. A path that leads
out of the folder and of the links followed is refused. As a stream, it goes on with files changed after the last one seen.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .projects import HEAD_BYTES, IGNORED_FOLDERS, MAX_BYTES, _READ, classify, classify_head, decode

#: Bytes of files that one partition reads, about.
PARTITION_BYTES = 64 << 20


@dataclass
class Found:
    """A file below a root; reason: why it isn't read."""

    path: str
    size: int
    changed: int
    reason: str | None = None


class Files(InputPartition):
    def __init__(self, files: list[Found]):
        self.files = files


def walk(root: str, max_bytes: int = MAX_BYTES) -> list[Found]:
    """All XML files below root in the order of their paths (relative, with /). Each real folder once, whatever links lead to it."""
    out: list[Found] = []
    seen: set[str] = set()
    work = [""]
    while work:
        folder = work.pop()
        real = os.path.realpath(os.path.join(root, folder))
        if real in seen:
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name, reverse=True)
        except OSError:
            out.append(Found(folder or ".", 0, 0, "UNREADABLE"))
            continue
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_dir():
                    if e.name not in IGNORED_FOLDERS:
                        work.append(path)
                elif e.name.lower().endswith(".xml"):
                    about = e.stat()
                    out.append(Found(path, about.st_size, about.st_mtime_ns, "TOO_LARGE" if about.st_size > max_bytes else None))
            except OSError:
                if e.name.lower().endswith(".xml"):
                    out.append(Found(path, 0, 0, "UNREADABLE"))
    return sorted(out, key=lambda f: f.path)


def by_bytes(files: list[Found], most: int = PARTITION_BYTES) -> list[Files]:
    """Neighbouring files in partitions of about `most` bytes."""
    out: list[Files] = []
    held = most
    for f in files:
        if held >= most:
            out.append(Files([]))
            held = 0
        out[-1].files.append(f)
        held += (0 if f.reason else f.size) + 4096
    return out


def guarded(root: str, path: str) -> str:
    """The place of a path below root; a ValueError for one that leads out of it by its name."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise ValueError(f"{path} isn't below the folder")
    return os.path.join(root, *parts)


def read_one(root: str, f: Found, external: bool = False) -> tuple:
    """A row of the project's files: source_file, size, encoding, kind, external, text, reason."""
    none = (f.path, f.size, None, None, external, None)
    if f.reason:
        return *none, f.reason
    try:
        with open(guarded(root, f.path), "rb") as file:
            head = file.read(HEAD_BYTES)
            kind = classify_head(head)
            if kind is not None and not kind.endswith("MAPPER"):
                return f.path, f.size, None, kind, external, None, kind
            text, encoding = decode(head + file.read())
    except OSError:
        return *none, "UNREADABLE"
    kind = classify(text)
    mapper = kind.endswith("MAPPER")
    return f.path, f.size, encoding, kind, external, text if mapper else None, None if mapper else kind


class FolderSource(DataSource):
    """Options: path (a folder), maxBytes, external (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "mapper_folder"

    def schema(self) -> str:
        return _READ

    def reader(self, schema) -> "FolderReader":
        return FolderReader(self.options)

    def streamReader(self, schema) -> "FolderStream":
        return FolderStream(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.limit = options["path"], int(options.get("maxBytes", MAX_BYTES))
        self.external = options.get("external", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        return by_bytes(walk(self.root, self.limit)) or [Files([])]

    def read(self, partition: Files):
        for f in partition.files:
            yield read_one(self.root, f, self.external)


class FolderStream(DataSourceStreamReader):
    """An offset is the time of the last change that has been seen, in nanoseconds."""

    def __init__(self, options):
        self.batch = FolderReader(options)

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((f.changed for f in walk(self.batch.root, self.batch.limit)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return by_bytes([f for f in walk(self.batch.root, self.batch.limit) if start["changed"] < f.changed <= end["changed"]])

    def read(self, partition: Files):
        return self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass


def files(spark: SparkSession, root: str, external: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below a folder as projects.scan has them, by this source."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("mapper_folder").option("maxBytes", str(max_bytes)).option("external", str(external).lower()).load(root)


def stream(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder as they come and change."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("mapper_folder").load(root)
