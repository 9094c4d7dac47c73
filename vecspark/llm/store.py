"""Plain files in the shared folder, from driver and executors alike."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_dir(path: str) -> None:
    where, inner = resolve(path)
    where.create_dir(inner, recursive=True)


def open_write(path: str):
    where, inner = resolve(path)
    return where.open_output_stream(inner)


def mapped(path: str):
    """A readable file: memory-mapped where the folder is a mounted one, else a random-access stream of the store."""
    import pyarrow as pa

    where, inner = resolve(path)
    return pa.memory_map(inner, "r") if isinstance(where, fs.LocalFileSystem) else where.open_input_file(inner)
