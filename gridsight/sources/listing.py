"""Files and folders as rows, listed by tasks.

The driver looks at the upper folders until there are enough to hand out, and keeps the names of folders only; a task
lists some of them with everything below, or one of the upper ones by itself. Stores are reached through pyarrow's file
systems.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that the driver hands out, about.
PREFIXES = 256
SCHEMA = "name string, is_directory boolean, size bigint, last_modified bigint, owner string"
Entry = tuple[str, bool, int, int | None, None]


def _store(uri: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    scheme, apart, rest = uri.partition(":")
    if apart and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif apart and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    elif not apart:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Given(InputPartition):
    """Folders to list, with all below them if ``deep``."""

    def __init__(self, folders: list[str], deep: bool):
        self.folders = folders
        self.deep = deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.glob = options.get("glob")
        self.prefixes = int(options.get("prefixes", PREFIXES))

    def _entries(self, folder: str) -> tuple[list[Entry], list[str]]:
        """Rows for what lies directly in a folder, which is named relative to the root, and the folders among it."""
        from pyarrow import fs

        store, root = _store(self.root)
        root = root.rstrip("/")
        rows, folders = [], []
        for found in store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/") or "/", recursive=False)):
            name = folder + found.base_name
            changed = None if found.mtime_ns is None else found.mtime_ns // 1_000_000_000
            if found.type == fs.FileType.Directory:
                rows.append((name + "/", True, 0, changed, None))
                folders.append(name + "/")
            elif self.glob is None or fnmatchcase(found.base_name, self.glob):
                rows.append((name, False, found.size, changed, None))
        return rows, folders if self.recursive else []

    def partitions(self) -> Sequence[InputPartition]:
        upper, waiting = [], [""]
        while waiting and len(waiting) < self.prefixes:
            upper += waiting
            waiting = [below for folder in waiting for below in self._entries(folder)[1]]
        parts = max(1, min(self.prefixes, len(waiting)))
        deep = [Given(waiting[part::parts], True) for part in range(parts)] if waiting else []
        return [*[Given([folder], False) for folder in upper], *deep]

    def read(self, partition: Given) -> Iterator[Entry]:
        waiting = list(partition.folders)
        while waiting:
            rows, folders = self._entries(waiting.pop())
            yield from rows
            waiting += folders if partition.deep else []


class FolderListing(DataSource):
    """S4 as a data source: options path, recursive, glob, prefixes."""

    @classmethod
    def name(cls) -> str:
        return "gridsight_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))
