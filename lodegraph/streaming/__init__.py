"""Arriving snapshots and deliveries, handled by the batch operators micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodegraph.operators.latest import latest


def upsert_latest(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str, partitions: int = 8) -> StreamingQuery:
    """Keep a table at ``path`` of the newest delivery of each key.

    Each micro-batch is merged with the table of the epoch before and written as a new epoch, so a
    batch that is run again after a failure gives the same table. Read it with ``current``.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch
        before = current(batch.sparkSession, path, epoch)
        if before is not None:
            rows = batch.unionByName(before)
        latest(rows, keys, at).repartition(partitions).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, before: int | None = None) -> DataFrame | None:  # noqa: ANN001
    """The table of the last epoch (before ``before``), if there is one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if n.startswith("epoch=") and (before is None or int(n[6:]) < before)]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch of a stream."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
