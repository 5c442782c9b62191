"""Binary files in the shared folder, written and read by tasks (any file system that pyarrow knows by its URI)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def publish(path: str, chunks) -> int:
    """Writes a file under a name of its own, then moves it into place: a repeated task attempt replaces whole files only."""
    system, target = locate(path)
    system.create_dir(target.rpartition("/")[0], recursive=True)
    draft = f"{target}.{uuid.uuid4().hex}.draft"
    size = 0
    with system.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    try:
        system.move(draft, target)
    except OSError:  # some stores do not replace on a move
        system.delete_file(target)
        system.move(draft, target)
    return size


def load(path: str) -> bytes:
    system, target = locate(path)
    with system.open_input_file(target) as source:
        return source.read()
