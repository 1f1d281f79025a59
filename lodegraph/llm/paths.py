"""Paths of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """A path with "/" for "\\" and without leading "./"."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def extension(path: Column) -> Column:
    """The last extension of the file name in lower case, without its dot; null without one."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(found != "", found)
