"""Worst-first rankings, tiers, breaches and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.model import Principle
from lodegraph.operators.rules import long_values, ranked

#: Rows of a scorecard unless asked otherwise.
SCORECARD_ROWS = 15


def rank_by(df: DataFrame, by: list[str], metric: str, top: int) -> DataFrame:
    """(by, id, value, rank): the ``top`` worst nodes of each graph; missing sloc and items count as 0.

    The rank is limited before the shuffle, so a large graph is not gathered.
    """
    rows = df.filter(F.col(metric).isNotNull() & F.coalesce(F.col("kind") != "external", F.lit(True)))
    rows = rows.withColumn("rank", F.row_number().over(ranked(rows, by, metric))).filter(F.col("rank") <= top)
    return rows.select(*by, "id", F.col(metric).cast("double").alias("value"), "rank")


def rank_cycles(groups: DataFrame, by: list[str], top: int) -> DataFrame:
    """(by, component, kind, size, rank): chains before mutual ones, the largest first."""
    order = Window.partitionBy(*by).orderBy(F.when(F.col("kind") == "chain", 0).otherwise(1), F.desc("size"), "component")
    return groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(*by, "component", "kind", "size", "rank")


def tier_counts(df: DataFrame, by: list[str], thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """(by, metric, warnings, infos): values over each metric's (info, warning) limits; a warning is an info too."""
    rows = long_values(df, by, sorted(thresholds))
    limit = lambda i: F.element_at(F.create_map(*[x for k, v in sorted(thresholds.items()) for x in (F.lit(k), F.lit(float(v[i])))]), F.col("metric"))
    return rows.groupBy(*by, "metric").agg(F.count(F.when(F.col("value") > limit(1), 1)).alias("warnings"), F.count(F.when(F.col("value") > limit(0), 1)).alias("infos"))


def _breaches(df: DataFrame, by: list[str], thresholds: dict[str, tuple[float, float]], cycle: str | None) -> DataFrame:
    rows = long_values(df, [*by, "id"], sorted(thresholds))
    limit = lambda i: F.element_at(F.create_map(*[x for k, v in sorted(thresholds.items()) for x in (F.lit(k), F.lit(float(v[i])))]), F.col("metric"))
    warned = F.col("value") > limit(1)
    bound = F.when(warned, limit(1)).when(F.col("value") > limit(0), limit(0))
    rows = rows.withColumns({"warning": warned, "bound": bound}).filter("bound is not null")
    rows = rows.select(*by, "id", "metric", "warning", F.when(F.col("bound") > 0, F.col("value") / F.col("bound")).otherwise(float("inf")).alias("ratio"))
    if cycle:
        rows = rows.unionByName(df.filter(F.col(cycle).isNotNull()).select(*by, "id", F.lit("cycle").alias("metric"), F.lit(True).alias("warning"), F.lit(1.0).alias("ratio")))
    return rows


def breach_rows(df: DataFrame, by: list[str], thresholds: dict[str, tuple[float, float]], *, cycle: str | None = None, top: int = SCORECARD_ROWS) -> DataFrame:
    """(by, id, warnings, infos, worst, ratio, rank): nodes with most breaches; ``worst`` has the greatest ratio of value to limit."""
    rows = _breaches(df, by, thresholds, cycle).groupBy(*by, "id").agg(
        F.count(F.when(F.col("warning"), 1)).alias("warnings"), F.count(F.when(~F.col("warning"), 1)).alias("infos"), F.max(F.struct("ratio", "metric")).alias("w"),
    )
    rows = rows.join(df.select(*by, "id", F.coalesce(F.col("hk"), F.lit(0.0)).alias("hk")), [*by, "id"])
    order = Window.partitionBy(*by).orderBy(F.desc("warnings"), F.desc("infos"), F.desc("hk"), "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.select(*by, "id", "warnings", "infos", F.col("w.metric").alias("worst"), F.col("w.ratio").alias("ratio"), "rank")


def scorecard(df: DataFrame, by: list[str], principles: list[Principle], thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """(by, principle, warnings, infos, top): breaches and the worst node of each principle's metric.

    Counts and top node come from one aggregation per graph over all metrics.
    """
    lenses = [(p.id, p.sort_metric) for p in principles if p.sort_metric in df.columns]
    counts = []
    for _, metric in lenses:
        value = F.col(metric).cast("double")
        info, warning = thresholds.get(metric, (float("inf"), float("inf")))
        order = F.struct(value, F.coalesce("sloc", F.lit(0)).cast("double"), F.coalesce("items", F.lit(0)).cast("double"))
        best = F.max(F.when(value.isNotNull(), order))
        counts.append(F.struct(F.count(F.when(value > warning, 1)).alias("warnings"), F.count(F.when((value > info) & (value <= warning), 1)).alias("infos"), F.max_by(F.col("id"), F.when(value.isNotNull(), order)).alias("top"), best.alias("by")))
    rows = df.filter(F.coalesce(F.col("kind") != "external", F.lit(True))).groupBy(*by).agg(F.array(*counts).alias("c"))
    names = F.array(*[F.lit(i) for i, _ in lenses])
    rows = rows.select(*by, F.explode(F.arrays_zip(names.alias("principle"), F.col("c"))).alias("z"))
    return rows.select(*by, "z.principle", "z.c.warnings", "z.c.infos", "z.c.top")


def warning_types(df: DataFrame, by: list[str], limits: dict[str, float], cycle: str | None = None) -> DataFrame:
    """(by, types): the number of metrics with any breach, and one more for any cycle."""
    some = [F.coalesce(F.bool_or(F.col(m) > v), F.lit(False)).cast("int") for m, v in sorted(limits.items())]
    some += [F.coalesce(F.bool_or(F.col(cycle).isNotNull()), F.lit(False)).cast("int")] if cycle else []
    total = some[0]
    for s in some[1:]:
        total = total + s
    return df.groupBy(*by).agg(total.alias("types"))


def connections(edges: DataFrame, modules: DataFrame, by: list[str]) -> DataFrame:
    """(by, source, target, kind, side): edges that touch a set of modules: ``common`` inside it, ``in`` to it, ``out`` of it."""
    flag = modules.select(*by, "id").distinct().withColumn("is", F.lit(True))
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(flag.withColumnsRenamed({"id": end, "is": f"{end}_in"}), [*by, end], "left")
    s, t = F.col("source_in").isNotNull(), F.col("target_in").isNotNull()
    side = F.when(s & t, "common").when(t, "in").when(s, "out")
    return rows.withColumn("side", side).filter("side is not null").select(*by, "source", "target", "kind", "side")
