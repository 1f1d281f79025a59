"""Levels of a graph, reachability, and what of a catalog is in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import is_external
from lodegraph.workspace import materialize_counting


def split_functions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, functions): ids with "#" name functions."""
    inside = F.contains("id", F.lit("#"))
    return nodes.filter(~inside), nodes.filter(inside)


def with_parent(functions: DataFrame, files: DataFrame, by: list[str], parent: str = "parent") -> DataFrame:
    """Functions whose parent still is a node."""
    return functions.join(files.select(*by, F.col("id").alias(parent)).distinct(), [*by, parent], "left_semi").select(*functions.columns)


def reachable(starts: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, id) of all that edges lead to from the starts, these included: a breadth-first search of all graphs at once.

    Only nodes reached in the last step are followed in the next one.
    """
    pairs = edges.select(*by, "source", "target").distinct()
    seen, fresh = materialize_counting(starts.select(*by, "id").distinct().withColumn("fresh", F.lit(True)), F.col("fresh"))
    while fresh:
        front = seen.filter("fresh").select(*by, F.col("id").alias("source"))
        found = pairs.join(front, [*by, "source"], "left_semi").select(*by, F.col("target").alias("id")).distinct()
        found = found.join(seen.select(*by, "id"), [*by, "id"], "left_anti").withColumn("fresh", F.lit(True))
        seen, fresh = materialize_counting(seen.withColumn("fresh", F.lit(False)).unionByName(found), F.col("fresh"))
    return seen.drop("fresh")


def drop_unreachable(nodes: DataFrame, edges: DataFrame, starts: DataFrame, links: DataFrame, by: list[str], crate: str = "crate") -> tuple[DataFrame, DataFrame]:
    """Without the nodes of crates that links between crates don't reach from the starting crates, such as
    those that only tests need, and without their edges. Nodes without a crate stay; an external ``ext:name@version`` belongs to the crate ``name``."""
    used = reachable(starts, links, by).withColumnRenamed("id", "_crate")
    own = F.coalesce(F.col(crate), F.when(is_external(), F.regexp_extract("id", r"^ext:([^@]+)@", 1)))
    rows = nodes.withColumn("_crate", F.nullif(own, F.lit("")))
    gone = rows.filter("_crate is not null").join(used, [*by, "_crate"], "left_anti").select(*by, "id")
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), [*by, end], "left_anti")
    return nodes.join(gone, [*by, "id"], "left_anti").select(*nodes.columns), edges


def present_columns(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, rows): how many rows of each graph have the column; those with none can go from the dictionaries, and a declared metric among them deserves a warning."""
    counts = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns])).alias("c")).select(*by, "c.*")


def used_roots(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, root) of the {root} tokens that ids begin with; ``target`` always is one."""
    found = nodes.select(*by, F.regexp_extract("id", r"^\{([^}]+)\}", 1).alias("root")).filter("root <> ''")
    return found.unionByName(nodes.select(*by, F.lit("target").alias("root"))).distinct()
