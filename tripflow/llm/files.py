"""Files that tasks write to and read from the shared folder, in any store pyarrow can open."""

from __future__ import annotations

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def write_file(uri: str, parts) -> int:
    """Write byte strings one after the other; returns the size. The folder is made if needed."""
    system, path = store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with system.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return size
