"""Reports as files: JSON, or embedded in HTML."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.nested import flat_tables

SCHEMA_VERSION = "5.0"


def embedded(html: Column, which: str = "current") -> Column:
    """The JSON text of a report in an HTML page; null if the page holds none."""
    found = F.regexp_extract(html, rf'(?s)<script[^>]*id="?cs-{re.escape(which)}"?[^>]*>(.*?)</script>', 1)
    return F.nullif(F.replace(found, F.lit("<\\/"), F.lit("</")), F.lit(""))


def read(spark: SparkSession, path: str, which: str = "current", *, versions: tuple[str, ...] | None = (SCHEMA_VERSION,)) -> DataFrame:
    """(snap_id, payload, ingested_at, file) of report files, .json whole and .html or .htm by their embedded report.

    A report that names another schema than ``versions`` fails the query with a message that names it; None takes all.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("ingested_at"))
    page = F.lower("file").rlike(r"\.html?$")
    rows = files.select(F.xxhash64("file").alias("snap_id"), F.when(page, embedded(F.col("value"), which)).otherwise(F.col("value")).alias("payload"), "ingested_at", "file")
    if versions is None:
        return rows
    found = F.get_json_object("payload", "$.schema_version")
    known = found.isNull() | found.isin(*versions)
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(": report of schema "), found, F.lit(f", expected {' or '.join(versions)}"))).cast("string")
    return rows.withColumn("payload", F.when(known, F.col("payload")).otherwise(wrong))


def check_version(payload: str) -> dict:
    """A report of the current schema; another version is an error that names it."""
    report = json.loads(payload)
    found = report.get("schema_version")
    if found != SCHEMA_VERSION:
        raise ValueError(f"report of schema {found}, expected {SCHEMA_VERSION}")
    return report


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The flat tables of all reports below a path."""
    return flat_tables(read(spark, path))


def is_report(name: str) -> bool:
    """Whether an input is a report rather than a folder of sources."""
    return name.lower().endswith((".json", ".html", ".htm"))
