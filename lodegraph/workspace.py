"""Session helpers: table access, the shared work folder, tables written to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast once they were counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodegraph-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class _Written(threading.local):
    """The tables that each thread wrote, so that queries that run side by side don't release each other's."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []
        _all_written.append(self.tables)


_all_written: list[list[tuple[SparkSession, str]]] = []
_written = _Written()


def materialize(df: DataFrame, *, partition_files: int | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and keeps disk use low, as the
    columns are encoded and compressed. Tables go when the driver ends, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodegraph-{uuid.uuid4().hex}"
    schema = df.schema
    out = df.coalesce(partition_files) if partition_files else df
    out.write.option("compression", "zstd").parquet(path)
    _written.tables.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def materialize_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``materialize``, and the number of rows for which a condition holds, counted while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A position for ``release``: tables written later than it can be released together."""
    return len(_written.tables)


def release(since: int, keep: DataFrame | None = None) -> None:
    """Delete the tables written since ``mark``, but for those that ``keep`` reads."""
    kept = {f.split("/")[-2] for f in keep.inputFiles()} if keep is not None else set()
    rest = []
    for spark, path in _written.tables[since:]:
        if path.rsplit("/", 1)[1] in kept:
            rest.append((spark, path))
        else:
            _delete(spark, path)
    _written.tables[since:] = rest


@atexit.register
def _cleanup() -> None:
    for spark, path in [t for tables in _all_written for t in tables]:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def _width(df: DataFrame) -> Column:
    """About the bytes of a row: of texts their own, of nested values those of their JSON."""
    sizes = [F.lit(16)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary", "char", "varchar"):
            sizes.append(F.coalesce(F.octet_length(F.collate(c, "UTF8_BINARY") if f.dataType.typeName() == "string" else c), F.lit(0)))
        elif f.dataType.typeName() in ("array", "map", "struct"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    return reduce(lambda a, b: a + b, sizes)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint on ``df`` if it has at most ``rows`` rows of ``size`` bytes together; beyond that the plain table.

    The check stops counting one row past the bound.
    """
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= size else df
