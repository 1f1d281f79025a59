"""Folders, crates and groups of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import parts
from lodegraph.operators.graph import is_external


def folder(path: Column) -> Column:
    return parts(path)["dir"]


def dig_key(path: Column, crate: Column, dig: int, root: Column | None = None) -> Column:
    """The group of a node at a level of the ladder: crate and the first ``dig`` folders below its root.

    Below zero the crate's own folders are cut by so many levels from their end. What is left empty is "_root".
    """
    where = folder(path)
    if dig < 0:
        names = F.split(crate, "/")
        kept = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) + dig, F.lit(0))), "/")
        return F.coalesce(F.nullif(kept, F.lit("")), F.lit("_root"))
    if root is not None:
        where = F.when(F.startswith(where, F.concat(root, F.lit("/"))), F.substring(where, F.length(root) + 2, F.lit(1 << 30))).when(where == root, F.lit("")).otherwise(where)
    inner = F.array_join(F.slice(F.split(where, "/"), F.lit(1), F.lit(dig)), "/") if dig else F.lit("")
    key = F.concat_ws("/", F.nullif(crate, F.lit("")), F.nullif(inner, F.lit("")))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("_root"))


def folder_key(path: Column, depth: int) -> Column:
    """The first ``depth`` folders of a path, "_root" for none."""
    return F.coalesce(F.nullif(F.array_join(F.slice(F.split(folder(path), "/"), F.lit(1), F.lit(max(depth, 0))), "/"), F.lit("")), F.lit("_root"))


def group_counts(nodes: DataFrame, by: list[str], depths: range) -> DataFrame:
    """(by, depth, groups): distinct folder keys at each depth, of inner nodes."""
    rows = nodes.filter(~is_external()).select(*by, F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), folder_key(F.col("path"), d).alias("key")) for d in depths])).alias("k"))
    return rows.groupBy(*by, "k.depth").agg(F.count_distinct("k.key").alias("groups"))


def rollup(nodes: DataFrame, by: list[str], numbers: list[str], cycle: str) -> DataFrame:
    """(by, level, key, members, in_cycle, numbers): sums per file, per folder and per crate, as grouping sets."""
    rows = nodes.filter(~is_external()).select(*by, "id", folder(F.col("path")).alias("folder"), F.coalesce("crate", F.lit("")).alias("crate"), F.col(cycle).alias("_cycle"), *[F.col(n).cast("double") for n in numbers])
    sets = [[F.col(b) for b in by] + [F.col(k)] for k in ("id", "folder", "crate")]
    sums = [F.sum(n).alias(n) for n in numbers]
    out = rows.groupingSets(sets, *by, "id", "folder", "crate").agg(F.grouping("id").alias("_g1"), F.grouping("folder").alias("_g2"), F.count(F.lit(1)).alias("members"), F.count("_cycle").alias("in_cycle"), *sums)
    level = F.when(F.col("_g1") == 0, "file").when(F.col("_g2") == 0, "folder").otherwise("crate")
    return out.select(*by, level.alias("level"), F.coalesce("id", "folder", "crate").alias("key"), "members", "in_cycle", *numbers)


def common_folder(rows: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(keys, root): the longest common folder of a group's paths.

    The least and the greatest path of a group share what all of them share, so two values are enough.
    """
    ends = rows.groupBy(*keys).agg(F.min(folder(F.col(path))).alias("a"), F.max(folder(F.col(path))).alias("b"))
    pairs = F.arrays_zip(F.split("a", "/").alias("x"), F.split("b", "/").alias("y"))
    same = F.transform(pairs, lambda p: p["x"] == p["y"])
    n = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    kept = F.when(n == 0, F.size(same)).otherwise(n - 1).cast("int")
    return ends.select(*keys, F.array_join(F.slice(F.split("a", "/"), F.lit(1), kept), "/").alias("root"))


def crate_roots(nodes: DataFrame, by: list[str], trimmed: tuple[str, ...] = ("src", "tests", "benches", "lib", "bin")) -> DataFrame:
    """(by, crate, root): the common folder of each crate's files without source folders at its end."""
    found = common_folder(nodes.filter(~is_external() & F.col("crate").isNotNull()), [*by, "crate"])
    return found.withColumn("root", F.regexp_replace("root", rf"(?:(?:^|/)(?:{'|'.join(trimmed)}))+$", ""))


def group_summary(nodes: DataFrame, by: list[str], cycle: str) -> DataFrame:
    """(by, crate, files, folders, sloc, hk, in_cycle, root) of each crate; sloc falls back to loc."""
    rows = nodes.filter(~is_external()).withColumn("crate", F.coalesce("crate", F.lit("")))
    sums = rows.groupBy(*by, "crate").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct(folder(F.col("path"))).alias("folders"), F.sum(F.coalesce("sloc", F.col("loc").cast("double"), F.lit(0.0))).alias("sloc"),
        F.sum(F.coalesce("hk", F.lit(0.0))).alias("hk"), F.count(cycle).alias("in_cycle"),
    )
    return sums.join(common_folder(rows, [*by, "crate"]), [*by, "crate"])


def distribution(nodes: DataFrame, by: list[str], metrics: list[str], quantiles: tuple[float, ...] = (0.01, 0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """(by, metric, n, mean, least, most, p…) of the positive values of each metric."""
    rows = nodes.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(*by, "m.*").filter("value > 0")
    out = rows.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", F.array(*map(F.lit, quantiles))).alias("q"))
    return out.select(*by, "metric", "n", "mean", "least", "most", *[F.col("q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)])


def upper_median(nodes: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, median): the upper one of two middle positive values, exact, from counts of equal values."""
    value = F.when(F.col(metric) > 0, F.col(metric).cast("double"))
    return nodes.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) within group (order by case when `{metric}` > 0 then -cast(`{metric}` as double) end)").alias("m"), F.count(value).alias("n")).filter("n > 0").select(*by, (-F.col("m")).alias("median"))


def depth_extremes(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, file_depth, crate_depth): the most folders above a file, and in a crate's name."""
    depth = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))
    return nodes.filter(~is_external()).groupBy(*by).agg(F.max(depth(folder(F.col("path")))).alias("file_depth"), F.max(depth(F.coalesce("crate", F.lit("")))).alias("crate_depth"))


def summary(nodes: DataFrame, edges: DataFrame, by: list[str], cycle: str) -> DataFrame:
    """(by, nodes, folders, crates, edges, in_cycles, sloc) of the inner graph."""
    inner = nodes.filter(~is_external())
    counts = inner.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(folder(F.col("path"))).alias("folders"), F.count_distinct("crate").alias("crates"), F.count(cycle).alias("in_cycles"), F.sum(F.coalesce("sloc", F.lit(0.0))).alias("sloc"))
    ids = inner.select(*by, "id")
    linked = edges.join(ids.withColumnRenamed("id", "source"), [*by, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [*by, "target"], "left_semi")
    lines = linked.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"))
    return counts.join(lines, by, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def neighbours(nodes: DataFrame, edges: DataFrame, by: list[str], focus: Column) -> DataFrame:
    """(by, side, crate, files): crates at the far end of edges that cross the border of a focus.

    Counted are distinct far files over flow edges; a crate that calls and is called is a caller only.
    """
    flags = nodes.filter(~is_external()).select(*by, "id", F.coalesce("crate", F.lit("")).alias("crate"), focus.alias("inside"))
    ends = lambda c: flags.select(*by, F.col("id").alias(c), F.col("crate").alias(f"{c}_crate"), F.col("inside").alias(f"{c}_inside"))
    rows = edges.join(ends("source"), [*by, "source"]).join(ends("target"), [*by, "target"]).filter("source_inside <> target_inside")
    side = F.when(F.col("target_inside"), "caller").otherwise("dependency")
    far = lambda c: F.when(F.col("target_inside"), F.col(f"source{c}")).otherwise(F.col(f"target{c}"))
    rows = rows.select(*by, side.alias("side"), far("_crate").alias("crate"), F.when(F.col("kind") == "uses", far("")).alias("file"))
    rows = rows.groupBy(*by, "side", "crate").agg(F.count_distinct("file").alias("files"))
    callers = rows.filter("side = 'caller'").select(*by, "crate")
    return rows.filter("side = 'caller'").unionByName(rows.filter("side = 'dependency'").join(callers, [*by, "crate"], "left_anti").select(*rows.columns))
