"""Binary files of tasks: written under names no other attempt uses, listed by the rows of the attempt that succeeded."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs) and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class NewFile:
    """A file of one task attempt. A retried or speculative attempt writes another; readers go by the returned names."""

    def __init__(self, folder: str, stem: str, suffix: str):
        system, base = locate(folder)
        system.create_dir(base, recursive=True)
        self.path = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.stream = system.open_output_stream(locate(self.path)[1], compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def open_input(path: str) -> BinaryIO:
    system, inner = locate(path)
    return system.open_input_file(inner)
