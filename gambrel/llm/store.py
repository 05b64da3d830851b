"""Files in the shared folder, through whatever file system its address names."""

from __future__ import annotations

import re


def open_fs(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if (plain := re.match(r"(?:file:)?/+", uri)) and not re.match(r"\w\w+:", uri.removeprefix("file:")):
        return fs.LocalFileSystem(), "/" + uri[plain.end() :]
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
