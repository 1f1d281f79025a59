"""Metrics of nodes and graphs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.cel import compile_metric, topological
from lodegraph.functions.numeric import finite, present, truncated
from lodegraph.model import DERIVED, HK, INPUTS, LOC_BLOCK, Metric, MetricDef


def derive(df: DataFrame, metrics: Iterable[Metric | MetricDef] = DERIVED, inputs: Iterable[str] = INPUTS, texts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with a column per formula, unrounded; formulas may read each other."""
    formulas = {m.key: m.formula for m in metrics}
    scope = {k: F.col(k) for k in inputs if k in df.columns}
    for key in topological(formulas):
        df = df.withColumn(key, compile_metric(formulas[key], scope, texts))
        scope[key] = F.col(key)
    return df


def emitted(df: DataFrame, metrics: Iterable[Metric | MetricDef] = DERIVED, inputs: Iterable[str] = INPUTS) -> DataFrame:
    """Values as they are reported: truncated, null at the value that means absence; line counts only of files with code."""
    out = {m.key: present(F.col(m.key), m.omit_at) for m in metrics if m.key in df.columns}
    for key in inputs:
        value = present(F.col(key))
        out[key] = F.when(F.col("sloc") > 0, value) if key in LOC_BLOCK else value
    return df.withColumns(out)


def with_hk(df: DataFrame) -> DataFrame:
    """``df`` with hk of reported sloc, fan_in and fan_out; missing inputs count as 0."""
    scope = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in ("sloc", "fan_in", "fan_out")}
    return df.withColumn("hk", present(compile_metric(HK.formula, scope)))


def user_metrics(df: DataFrame, defs: list[MetricDef], inputs: Iterable[str], texts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the reported values of users' node formulas, in the order in which they read each other."""
    node = {m.key: m for m in defs if m.scope == "node"}
    scope = {k: F.col(k) for k in inputs}
    for key in topological({k: m.formula for k, m in node.items()}):
        made = compile_metric(node[key].formula, scope, texts)
        df = df.withColumn(key, F.when(made.isNotNull(), present(made, node[key].omit_at)))
        scope[key] = F.col(key)
    return df


def population(value: Column, name: str, omit_at: float = 0.0) -> Column:
    """``all``: a missing value counts at the floor; any other name: only present values off the floor."""
    x = finite(value.cast("double"))
    return F.coalesce(x, F.lit(float(omit_at))) if name == "all" else F.when(x != omit_at, x)


def percentile_of(reducer: str) -> float | None:
    """The percentage of median or p<q>; None for any other reducer."""
    q = 50.0 if reducer == "median" else float(m[1]) if (m := re.fullmatch(r"p(\d+(?:\.\d+)?)", reducer)) else None
    return None if q is None or q > 100 else q


def reduced(value: Column, reducer: str) -> Column:
    """An aggregate of doubles: sum avg mean min max count; null for none and for an unknown name."""
    plain = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max}
    if reducer in plain:
        return plain[reducer](value)
    return F.nullif(F.count(value), F.lit(0)).cast("double") if reducer == "count" else F.max(F.lit(None).cast("double"))


def percentiles(values: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, name…): exact percentiles of ``value``, interpolated from the lower neighbour: a + (h - floor(h)) * (b - a), h = (n - 1) * q / 100.

    Equal values are counted before the shuffle; a group's window sees its different values only.
    """
    counts = values.filter("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"))
    keys = Window.partitionBy(*by)
    rows = counts.withColumns({"_upto": F.sum("_n").over(keys.orderBy("value")), "_all": F.sum("_n").over(keys.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ends, out = [], []
    for i, (name, q) in enumerate(wanted.items()):
        place = (F.col("_all") - 1) * F.lit(q / 100.0)
        for side, at in (("a", F.floor(place)), ("b", F.least(F.floor(place) + 1, F.col("_all") - 1))):
            ends.append(F.max(F.when((F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto")), F.col("value"))).alias(f"_{side}{i}"))
        out.append((F.col(f"_a{i}") + (place - F.floor(place)) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(name))
    return rows.groupBy(*by).agg(F.max("_all").alias("_all"), *ends).select(*by, *out)


def aggregate(df: DataFrame, by: list[str], metric: str, reducer: str, name: str = "not_empty", omit_at: float = 0.0) -> DataFrame:
    """(by, value) of agg(metric, reducer, population); ``top<N>`` and ``top<N>_<reducer>`` reduce the N largest values.

    The N largest are ranked before the shuffle on each side, so a large graph is not gathered.
    """
    values = df.select(*by, population(F.col(metric), name, omit_at).alias("value")).filter("value is not null")
    if m := re.fullmatch(r"top(\d+)(?:_(.+))?", reducer):
        order = Window.partitionBy(*by).orderBy(F.desc("value")) if by else Window.orderBy(F.desc("value"))
        values = values.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= int(m[1])).drop("_rank")
        return aggregate(values, by, "value", m[2] or "avg", "all") if int(m[1]) else values.groupBy(*by).agg(F.max(F.lit(None).cast("double")).alias("value"))
    if (q := percentile_of(reducer)) is not None:
        return percentiles(values, by, {"value": q})
    return values.groupBy(*by).agg(reduced(F.col("value"), reducer).alias("value"))


def aggregates(df: DataFrame, by: list[str], wanted: Iterable[tuple[str, str, str]], omit_at: dict[str, float] | None = None) -> tuple[DataFrame, dict[tuple[str, str, str], str]]:
    """One row per graph with every (metric, reducer, population) once; and the columns' names.

    One pass serves all plain reducers, one more the percentiles of each metric and population.
    """
    names = {w: f"_agg{i}" for i, w in enumerate(dict.fromkeys(wanted))}
    value = lambda m, p: population(F.col(m), p, (omit_at or {}).get(m, 0.0))
    special = {w for w in names if w[1].startswith("top") or percentile_of(w[1]) is not None}
    plain = [reduced(value(m, p), r).alias(n) for (m, r, p), n in names.items() if (m, r, p) not in special]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *plain).drop("_n")
    parts = [aggregate(df, by, m, r, p, (omit_at or {}).get(m, 0.0)).withColumnRenamed("value", n) for (m, r, p), n in names.items() if r.startswith("top")]
    for m, p in dict.fromkeys((m, p) for m, r, p in names if percentile_of(r) is not None):
        parts.append(percentiles(df.select(*by, value(m, p).alias("value")), by, {n: percentile_of(r) for (x, r, y), n in names.items() if (x, y) == (m, p) and percentile_of(r) is not None}))
    for part in parts:
        out = out.join(part, by, "left") if by else out.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return out, names


def stats(df: DataFrame, by: list[str], keys: Iterable[str]) -> DataFrame:
    """(by, key, value): the truncated mean of the positive finite values of each key, where there is one."""
    keys = list(keys)
    means = df.groupBy(*by).agg(*[F.avg(F.when(finite(F.col(k).cast("double")) > 0, F.col(k).cast("double"))).alias(k) for k in keys])
    rows = means.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("s"))
    return rows.select(*by, "s.key", truncated(F.col("s.value")).alias("value")).filter("value > 0")


def graph_metrics(df: DataFrame, by: list[str], defs: list[MetricDef], omit_at: dict[str, float] | None = None) -> DataFrame:
    """One row per graph with the reported values of formulas over aggregates; later ones may read earlier ones."""
    made = {m.key: m for m in defs if m.scope == "graph"}
    wanted: list[tuple[str, str, str]] = []

    def note(metric: str, reducer: str, name: str) -> Column:
        wanted.append((metric, reducer, name))
        return F.lit(0.0)

    order = topological({k: m.formula for k, m in made.items()})
    for key in order:
        compile_metric(made[key].formula, {k: F.lit(0.0) for k in made}, None, note)
    rows, names = aggregates(df, by, wanted, omit_at)
    scope: dict[str, Column] = {}
    for key in order:
        value = compile_metric(made[key].formula, scope, None, lambda m, r, p: F.col(names[m, r, p]))
        rows = rows.withColumn(key, F.when(value.isNotNull(), present(value, made[key].omit_at)))
        scope[key] = F.col(key)
    return rows.drop(*names.values())
