"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.latest import latest
from lodegraph.workspace import broadcast_if_small, materialize


def content_hash(*columns: Column) -> Column:
    """A 64-bit hash of several values that tells a null from any value in any place."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def numeric_entries(text: Column) -> Column:
    """The entries of a JSON object of numbers, sorted by key, as numbers; null values don't count.

    Null, an unreadable text or one that is no object gives no entries.
    """
    entries = F.map_entries(F.from_json(text, "map<string,double>"))
    entries = F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), (e["value"] + F.lit(0.0)).alias("value")))
    return F.coalesce(F.array_sort(entries), F.expr("cast(array() as array<struct<key:string,value:double>>)"))


def snapshot_changes(df: DataFrame, series: list[str], snap: str, key: list[str], content: Column, at: str) -> DataFrame:
    """(series, snap, key, status) with status ``added``, ``removed`` or ``changed``.

    Of rows with one (series, snap, key) the one with the latest ``at`` counts; of several such
    that with the greatest content hash. A snapshot is compared with the next lower number of its
    series that exists, so gaps in the numbers don't matter; the first one of a series gives
    nothing. Each key's rows are windowed by the index of their snapshot in the series: another hash
    than at the index before is a change, a jump of the index a removal and a later addition. Rows with a null
    snapshot number are left out; null series and keys count as values. Repeated rows and an empty
    table need nothing special, other columns are ignored.
    """
    rows = df.filter(F.col(snap).isNotNull()).select(*series, snap, *key, at, content.alias("_lg_hash"))
    order = Window.partitionBy(*series).orderBy(snap)
    snaps = rows.select(*series, snap).distinct().withColumn("_lg_i", F.row_number().over(order)).withColumn("_lg_next", F.lead(snap).over(order))
    snaps = broadcast_if_small(materialize(snaps).withColumnsRenamed({c: f"_lg_{c}" for c in [*series, snap]}))
    rows = latest(rows, [*series, snap, *key], at)
    rows = rows.join(snaps, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_lg_{c}")) for c in [*series, snap]]))
    line = Window.partitionBy(*series, *key).orderBy("_lg_i")
    rows = rows.withColumns({"_lg_back": F.lag("_lg_i").over(line), "_lg_old": F.lag("_lg_hash").over(line), "_lg_ahead": F.lead("_lg_i").over(line)})
    i, back, ahead = F.col("_lg_i"), F.col("_lg_back"), F.col("_lg_ahead")
    event = lambda number, status: F.struct(F.col(number).alias(snap), F.lit(status).alias("status"))
    here = (
        F.when((i > 1) & (back.isNull() | (back < i - 1)), event(snap, "added"))
        .when((back == i - 1) & (F.col("_lg_old") != F.col("_lg_hash")), event(snap, "changed"))
    )
    gone = F.when(F.col("_lg_next").isNotNull() & (ahead.isNull() | (ahead > i + 1)), event("_lg_next", "removed"))
    return rows.select(*series, *key, F.explode(F.array_compact(F.array(here, gone))).alias("_lg_e")).select(*series, f"_lg_e.{snap}", *key, "_lg_e.status")
