"""File formats by content, then by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

MAGIC = ((b"AQED", "aqed"), (b"\x89HDF", "hdf5"))
SUFFIXES = {"aqed": "aqed", "json": "json", "csv": "csv", "tsv": "csv", "h5": "hdf5", "hdf5": "hdf5", "parquet": "parquet"}


def suffix(path: str) -> str | None:
    return SUFFIXES.get(path.rstrip("/").rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def detect(head: bytes, path: str) -> str:
    """Format of a file from its first bytes (a magic counts only with eight bytes there) and its name."""
    if len(head) >= 8:
        for magic, name in MAGIC:
            if head.startswith(magic):
                return name
    if head.lstrip()[:1] in (b"{", b"["):
        return "json"
    found = suffix(path)
    if found is None:
        raise ValueError(f"unknown format: {path}")
    return found


def detect_text(path: str, content: str, asked: str | None = None) -> str:
    """Format of a command-line input: as asked, by name, by a leading bracket, else CSV."""
    if asked:
        return asked
    return suffix(path) or ("json" if content.lstrip()[:1] in ("{", "[") else "csv")


def output_format(path: str | None, source: str) -> str:
    return (suffix(path) if path else None) or source


def detect_path(spark: SparkSession, path: str) -> str:
    if suffix(path) == "parquet":
        return "parquet"
    from .files import read_bytes

    return detect(read_bytes(spark, path)[:64], path)
