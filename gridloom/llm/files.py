"""Binary files that tasks write and read in the shared folder."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (see ``shared.qualified``), and the path in it."""
    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        raise ValueError(f"a URI is needed, so that all machines mean the same file: {path}")
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@contextmanager
def written_file(folder: str, prefix: str, suffix: str):
    """Yields (stream, path) of a new file.

    Every attempt of a task writes a file of its own; only the path that a
    successful attempt returns is ever read, so a lost or repeated task leaves
    at most a file that nothing names.
    """
    system, base = located(folder)
    system.create_dir(base, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{base}/{name}", compression=None) as stream:
        yield stream, f"{folder}/{name}"


def opened(path: str):
    """A stream of the file's bytes as they are."""
    system, base = located(path)
    return system.open_input_stream(base, compression=None)
