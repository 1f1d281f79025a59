"""Comparison of a graph with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _status(before: str, after: str):  # noqa: ANN202
    return F.when(F.col(before).isNull(), "added").when(F.col(after).isNull(), "removed").otherwise("unchanged")


def _sides(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with b and c, true where the side has them: one aggregation instead of a full outer join."""
    both = base.select(*keys, F.lit(True).alias("b"), F.lit(None).cast("boolean").alias("c")).unionByName(current.select(*keys, F.lit(None).cast("boolean").alias("b"), F.lit(True).alias("c")))
    return both.groupBy(*keys).agg(F.bool_or("b").alias("b"), F.bool_or("c").alias("c"))


def diff_graphs(base: tuple[DataFrame, DataFrame], current: tuple[DataFrame, DataFrame], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a status.

    Nodes are added, removed or unchanged, and affected if unchanged but an edge of theirs was
    added or removed; edges likewise, affected if unchanged but an end is not.
    """
    edge = [*by, "source", "target", "kind"]
    edges = _sides(base[1], current[1], edge).withColumn("status", _status("b", "c")).drop("b", "c")
    changed = edges.filter("status <> 'unchanged'")
    touched = changed.select(*by, F.col("source").alias("id")).unionByName(changed.select(*by, F.col("target").alias("id"))).distinct().withColumn("touched", F.lit(True))
    nodes = _sides(base[0], current[0], [*by, "id"]).withColumn("status", _status("b", "c")).drop("b", "c").join(touched, [*by, "id"], "left")
    nodes = nodes.select(*by, "id", F.when((F.col("status") == "unchanged") & F.col("touched").isNotNull(), "affected").otherwise(F.col("status")).alias("status"))
    moved = nodes.filter("status <> 'unchanged'").select(*by, "id", F.lit(True).alias("moved"))
    for end in ("source", "target"):
        edges = edges.join(moved.withColumnsRenamed({"id": end, "moved": f"{end}_moved"}), [*by, end], "left")
    hit = F.col("source_moved").isNotNull() | F.col("target_moved").isNotNull()
    edges = edges.select(*edge, F.when((F.col("status") == "unchanged") & hit, "affected").otherwise(F.col("status")).alias("status"))
    return nodes, edges


def diff_cycles(base: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, status) of members of cycles: ``both``, ``baseline`` or ``current``."""
    members = lambda g: g.select(*by, F.explode("nodes").alias("id")).distinct()
    rows = _sides(members(base), members(current), [*by, "id"])
    return rows.select(*by, "id", F.when(F.col("b").isNull(), "current").when(F.col("c").isNull(), "baseline").otherwise("both").alias("status"))


def group_status(nodes: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by, group, status): a group's side; ``both`` if it has members of both sides."""
    has = lambda *s: F.coalesce(F.bool_or(F.col("status").isin(*s)), F.lit(False))
    rows = nodes.groupBy(*by, group).agg(has("unchanged", "affected").alias("same"), has("removed").alias("b"), has("added").alias("c"))
    return rows.select(*by, group, F.when(F.col("same") | (F.col("b") & F.col("c")), "both").when(F.col("b"), "baseline").otherwise("current").alias("status"))


def new_and_resolved(base: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule, location, status): violations by signature that are ``new`` or ``resolved``."""
    rows = _sides(base, current, [*by, "rule", "location"]).filter("b is null or c is null")
    return rows.select(*by, "rule", "location", F.when(F.col("b").isNull(), "new").otherwise("resolved").alias("status"))


def verdict(changes: DataFrame, by: list[str]) -> DataFrame:
    """(by, new, resolved, verdict): degraded with any new violation, else improved with any resolved, else neutral."""
    rows = changes.groupBy(*by).agg(F.count(F.when(F.col("status") == "new", 1)).alias("new"), F.count(F.when(F.col("status") == "resolved", 1)).alias("resolved"))
    return rows.withColumn("verdict", F.when(F.col("new") > 0, "degraded").when(F.col("resolved") > 0, "improved").otherwise("neutral"))
