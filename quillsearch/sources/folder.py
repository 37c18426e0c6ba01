"""A folder on a local or shared file system, for the few small files of a store."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


class Folder:
    """``path`` is a plain path or a URI (hdfs://, s3://, gs://, abfs://, file://)."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        if "://" in path:
            self.fs, self.root = fs.FileSystem.from_uri(self.path)
        else:
            self.fs, self.root = fs.LocalFileSystem(), os.path.abspath(self.path)

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def exists(self, name: str = "") -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}".rstrip("/")).type != fs.FileType.NotFound

    def names(self) -> list[str]:
        """Names of what lies in the folder; none if it isn't there."""
        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def put(self, name: str, data: bytes) -> None:
        """Write a file that appears whole under a name that is not taken yet."""
        if self.exists(name):
            raise FileExistsError(name)
        with self.sink(f".{name}-{uuid.uuid4().hex}") as (f, part):
            f.write(data)
        self.fs.move(f"{self.root}/{part}", f"{self.root}/{name}")

    @contextmanager
    def sink(self, name: str) -> Iterator:
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            yield f, name

    def drop(self, name: str) -> None:
        at = f"{self.root}/{name}"
        if self.fs.get_file_info(at).type == fs.FileType.Directory:
            self.fs.delete_dir(at)
        else:
            self.fs.delete_file(at)
