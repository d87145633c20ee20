"""Files that tasks write to and read from the shared folder, by any scheme pyarrow knows."""

from __future__ import annotations

import pyarrow.fs


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI (``file:/x``, ``s3://...``, ``hdfs://...``) and the path there."""
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder)
