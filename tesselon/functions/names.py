"""File names and tile keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_BYTES = 32


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The last component without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1)


def tile_key(prefix: Column) -> Column:
    """The prefix's first 32 bytes, filled up with zero bytes."""
    raw = F.encode(prefix, "UTF-8")
    return F.substring(F.concat(raw, F.unhex(F.lit("00" * KEY_BYTES))), 1, KEY_BYTES)


def key_text(key: Column) -> Column:
    """A key for display, without the zero bytes at its end."""
    return F.regexp_replace(F.decode(key, "UTF-8"), "\\x00+$", "")


def output_path(folder: str, prefix: Column, suffix: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), stem(prefix), F.lit(suffix))
