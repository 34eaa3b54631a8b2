"""Files that Python tasks write to and read from the shared folder, by whatever file system its URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def arrow_uri(uri: str) -> str:
    """The name Arrow knows a folder by: S3 has names of its own in Hadoop, and ``dbfs:`` is mounted at ``/dbfs``."""
    scheme, mark, rest = uri.partition(":")
    if mark and scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if mark and scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    return uri


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(uri))


def task_file(prefix: str, suffix: str) -> str:
    """A name no other attempt of a task uses: what a lost attempt leaves is never listed in an index."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{prefix}-{part:05d}-{uuid.uuid4().hex}{suffix}"


def task_part() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
