"""What a browser of the graph shows: filters, tables, focus, neighbours, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.model import FLOW_KINDS
from lodegraph.operators.graph import flow_edges, is_external
from lodegraph.operators.hier import common_folder, folder, group_counts
from lodegraph.operators.metrics import percentiles

#: Groups that a focus may reveal at most.
REVEALED = 20


def shown(df: DataFrame, key: str) -> DataFrame:
    """Nodes that a filter by ``cycle`` or by a metric keeps: members of cycles, or values above 0."""
    return df.filter(F.col(key).isNotNull() if key == "cycle" else F.col(key) > 0)


def local_graph(nodes: DataFrame, edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inner nodes and the edges between them."""
    inner = nodes.filter(~is_external())
    for end in ("source", "target"):
        edges = edges.join(inner.select(*by, F.col("id").alias(end)).distinct(), [*by, end], "left_semi")
    return inner, edges


def search(df: DataFrame, text: str, name: str = "name") -> DataFrame:
    """Rows whose name holds a text, whatever the case; an empty text keeps all."""
    return df.filter(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(text.strip().lower())))


def sort_order(key: str, descending: bool) -> Column:
    """A table's order by a column: what is empty counts as smallest in both directions."""
    return F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()


def default_sort(wanted: list[str], present: set[str]) -> str | None:
    """The first key of a signed list that is present; the sign doesn't count."""
    return next((k.lstrip("+-") for k in wanted if k.lstrip("+-") in present), None)


def zero_match_hint(nodes: DataFrame, focus: str, path: str = "path") -> str | None:
    """A hint for a focus that matches nothing: whether its first segment is known; None if it matches."""
    from lodegraph.functions.paths import focused

    if not nodes.filter(focused(F.col(path), focus)).isEmpty():
        return None
    first = focus.strip().removeprefix("./").split("/")[0]
    known = not nodes.filter(focused(F.col(path), first)).isEmpty()
    return f"no module matches '{focus}'" + (f"; try '{first}'" if known and first != focus else "")


def files_dig(path: Column, id: Column, dig: int, deepest: Column) -> Column:
    """The group at a level of folders; one past the deepest folder each file is its own group."""
    from lodegraph.operators.hier import folder_key

    return F.when(F.lit(dig) > deepest, id).otherwise(folder_key(path, dig))


def auto_focus(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, root): the folder that a view of each graph begins at, below all folders that hold one folder and no file."""
    return common_folder(nodes.filter(~is_external()), by)


def crates_of_folders(folders: DataFrame, roots: DataFrame, by: list[str], key: str = "folder") -> DataFrame:
    """(by, folder, crate): the crate whose root of (by, crate, root) is the deepest prefix of each folder; null for none."""
    names = F.split(key, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))
    options = folders.select(*by, key).distinct().select(*by, key, F.posexplode(above).alias("depth", "root"))
    best = options.join(roots.select(*by, "crate", "root"), [*by, "root"], "left").filter("crate is not null")
    best = best.groupBy(*by, key).agg(F.max(F.struct("depth", "crate")).alias("b")).select(*by, key, F.col("b.crate").alias("crate"))
    return folders.select(*by, key).distinct().join(best, [*by, key], "left")


def landing_depth(nodes: DataFrame, by: list[str], depths: range, most: int = REVEALED) -> DataFrame:
    """(by, depth): the deepest level at which fewer than ``most`` groups are revealed, else the first level."""
    counts = group_counts(nodes, by, depths)
    return counts.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("groups") < most, F.col("depth"))), F.min("depth")).alias("depth"))


def neighbour_popup(nodes: DataFrame, edges: DataFrame, by: list[str], focus: DataFrame) -> DataFrame:
    """(by, id, side, crate, own, n): how many neighbours by flow edges each focused node of (by, id) has in each crate; ``own`` marks its own crate."""
    crates = nodes.select(*by, F.col("id").alias("far"), F.coalesce("crate", F.lit("")).alias("crate"))
    mine = nodes.select(*by, "id", F.coalesce("crate", F.lit("")).alias("own_crate")).join(focus.select(*by, "id"), [*by, "id"], "left_semi")
    flow = flow_edges(edges)
    both = flow.select(*by, F.col("source").alias("id"), F.col("target").alias("far"), F.lit("out").alias("side")).unionByName(flow.select(*by, F.col("target").alias("id"), F.col("source").alias("far"), F.lit("in").alias("side")))
    rows = both.distinct().join(mine, [*by, "id"]).join(crates, [*by, "far"])
    return rows.groupBy(*by, "id", "side", "crate", (F.col("crate") == F.col("own_crate")).alias("own")).agg(F.count(F.lit(1)).alias("n"))


def edge_lines(edges: DataFrame, by: list[str], kinds: tuple[str, ...] = FLOW_KINDS) -> DataFrame:
    """(by, source, target, line): where a neighbour is imported: the first line of a flow edge, else the last of any."""
    flow = F.min(F.when(F.col("kind").isin(*kinds), F.col("line")))
    return edges.groupBy(*by, "source", "target").agg(F.coalesce(flow, F.max("line")).alias("line"))


def ranked_members(groups: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, id, place): the members of each cycle by hk, the largest first."""
    rows = groups.select(*by, "component", F.explode("nodes").alias("id")).join(nodes.select(*by, "id", "hk"), [*by, "id"], "left")
    order = Window.partitionBy(*by, "component").orderBy(F.desc(F.coalesce("hk", F.lit(0.0))), "id")
    return rows.select(*by, "component", "id", F.row_number().over(order).alias("place"))


def cycle_edges_diff(base: tuple[DataFrame, DataFrame], current: tuple[DataFrame, DataFrame], by: list[str]) -> DataFrame:
    """(by, source, target, status): flow edges inside one cycle on a side, of pairs (edges, components): ``both``, ``baseline`` or ``current``."""

    def inside(edges: DataFrame, components: DataFrame) -> DataFrame:
        ends = lambda c: components.select(*by, F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
        rows = flow_edges(edges).join(ends("source"), [*by, "source"]).join(ends("target"), [*by, "target"])
        return rows.filter("source_in = target_in").select(*by, "source", "target").distinct()

    b, c = inside(*base).withColumn("b", F.lit(True)), inside(*current).withColumn("c", F.lit(True))
    status = F.when(F.col("b").isNull(), "current").when(F.col("c").isNull(), "baseline").otherwise("both")
    return b.join(c, [*by, "source", "target"], "full").select(*by, "source", "target", status.alias("status"))


def depth_below_crates(nodes: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """(by, depth): the most folders of a file below the root of its crate."""
    rows = nodes.filter(~is_external()).select(*by, "crate", folder(F.col("path")).alias("folder")).join(roots, [*by, "crate"])
    rest = F.when(F.col("root") == "", F.col("folder")).when(F.startswith("folder", F.concat("root", F.lit("/"))), F.substring("folder", F.length("root") + 2, F.lit(1 << 30))).otherwise("")
    return rows.groupBy(*by).agg(F.max(F.when(rest == "", 0).otherwise(F.size(F.split(rest, "/")))).alias("depth"))


def summary_stats(nodes: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, avg, min, p50, p90, max, sum) of the positive values of inner nodes."""
    rows = nodes.filter(~is_external()).select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(*by, "m.*").filter("value > 0")
    keys = [*by, "metric"]
    plain = rows.groupBy(*keys).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"))
    return plain.join(percentiles(rows, keys, {"p50": 50.0, "p90": 90.0}), keys).select(*keys, "avg", "min", "p50", "p90", "max", "sum")


def summary_deltas(base: DataFrame, current: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, stat, value, delta): the statistics of now and what they gained since the baseline; a side that is missing counts as 0."""
    stats = ("avg", "min", "p50", "p90", "max", "sum")
    long = lambda d, name: summary_stats(d, by, metrics).select(*by, "metric", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias(name)) for s in stats])).alias("s")).select(*by, "metric", "s.*")
    rows = long(current, "value").join(long(base, "before"), [*by, "metric", "stat"], "full")
    value, before = F.coalesce("value", F.lit(0.0)), F.coalesce("before", F.lit(0.0))
    return rows.select(*by, "metric", "stat", value.alias("value"), (value - before).alias("delta"))
