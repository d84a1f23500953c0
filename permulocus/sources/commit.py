"""What the file-writing data sources share: tasks write temporary names, the commit gives final ones, and a failed or lost task leaves nothing.

Files are opened through the file system of their address: local folders that all share, or any that Arrow knows.
"""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the place in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, deep: bool = False) -> list[str]:
    """Files in a folder; none where it doesn't exist."""
    system, inside = opened(path)
    if system.get_file_info(inside).type == fs.FileType.NotFound:
        return []
    return sorted(x.path for x in system.get_file_info(fs.FileSelector(inside, recursive=deep)) if x.type == fs.FileType.File)


def own(file: str) -> bool:
    """Whether it is data: names that begin with _ or a dot are not."""
    return posixpath.basename(file)[0] not in "_."


class Files(WriterCommitMessage):
    """A task's files: temporary names beside the final ones, both below the folder."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class FolderWriter(DataSourceWriter):
    """Writers put files under names of self.temporary() and return Files."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def temporary(self) -> tuple[fs.FileSystem, str]:
        """A new file's place, in a folder that exists then."""
        system, inside = opened(self.path)
        system.create_dir(inside, recursive=True)
        return system, f"{inside}/_{self.job}-{uuid.uuid4().hex}"

    def commit(self, messages: list) -> None:
        system, inside = opened(self.path)
        system.create_dir(inside, recursive=True)
        before = {x for x in listed(self.path, deep=True) if own(x)}
        after = set()
        for temporary, final in (f for m in messages if m for f in m.files):
            place = f"{inside}/{final}"
            system.create_dir(posixpath.dirname(place), recursive=True)
            system.move(temporary, place)
            after.add(place)
        for old in before - after if self.overwrite else ():
            system.delete_file(old)
        self.abort([])  # files of attempts that were lost

    def abort(self, messages: list) -> None:
        for file in listed(self.path):
            if posixpath.basename(file).startswith(f"_{self.job}-"):
                opened(self.path)[0].delete_file(file)
