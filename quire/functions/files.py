"""Files that tasks write themselves, each whole or not at all."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


def write_file(uri: str, body: bytes) -> None:
    """``body`` as the file ``uri``: written beside it and moved there, so a lost or repeated task leaves no torn file."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        beside = f"{parsed.path}.{uuid.uuid4().hex}.new"
        with open(beside, "wb") as f:
            f.write(body)
        os.replace(beside, parsed.path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.new"
    with system.open_output_stream(beside) as f:
        f.write(body)
    system.move(beside, path)


def read_file(uri: str) -> bytes:
    """The body of the file ``uri``."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        with open(parsed.path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()
