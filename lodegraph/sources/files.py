"""Source files below a folder, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def walk(spark: SparkSession, root: str, extensions: list[str], *, skip_dirs: list[str] = (), hidden: bool = True) -> DataFrame:
    """(path, text) of files with the extensions, but below skipped or, with ``hidden``, dotted directories.

    Files are listed and read by the executors; ignore lines are applied by the operators on paths.
    """
    globs = "*.{" + ",".join(extensions) + "}"
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=globs).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    base = root.rstrip("/") + "/"
    path = F.regexp_extract("file", rf"^(?:file:/*)?/?\Q{base.removeprefix('file:').lstrip('/')}\E(.*)$", 1)
    rows = rows.select(path.alias("path"), "text")
    names = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    if skip_dirs:
        rows = rows.filter(~F.arrays_overlap(names, F.array(*map(F.lit, skip_dirs))))
    return rows.filter(~F.exists(F.split("path", "/"), lambda n: F.startswith(n, F.lit(".")))) if hidden else rows


def has_marker(spark: SparkSession, root: str, markers: list[str]) -> bool:
    """Whether any of the files that mark a language stands in the folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for marker in markers:
        path = hadoop.Path(f"{root.rstrip('/')}/{marker}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return True
    return False
