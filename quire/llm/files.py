"""Files that tasks write and read themselves, in a folder that all executors reach.

Local and mounted paths go through the operating system, any other scheme through Arrow's file systems
(HDFS, S3, GCS). A file appears under its name only when it is whole, and names hold the task attempt:
what a lost or repeated task left behind is never listed in a manifest, and never read.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark import TaskContext


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def task_file(folder: str, suffix: str) -> str:
    """A path in ``folder`` that no other attempt of this or any other task uses."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex[:12]}{suffix}"


@contextmanager
def writing(uri: str):
    """A binary file for writing, moved to its name when the block ends well."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as f:
            yield f
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".new", "wb") as f:
        yield f
    os.rename(path + ".new", path)


@contextmanager
def reading(uri: str):
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield f
        return
    with open(path, "rb") as f:
        yield f
