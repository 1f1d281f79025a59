"""Rules that turn metrics, cycles and checks into violations.

Violations are (by, rule, rule_group, location, line, message, weight, why, fix).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodegraph.functions.cel import CelError, compile_check, expand_defs, interpolate, parse
from lodegraph.functions.cel.compiler import Typed
from lodegraph.functions.cel.parser import Node, names
from lodegraph.functions.paths import parts
from lodegraph.model import CheckDef, concern
from lodegraph.operators.graph import adjacency, break_points, is_external
from lodegraph.operators.metrics import aggregates

_COLUMNS = ("rule", "rule_group", "location", "line", "message", "weight", "why", "fix")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def long_values(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) of all present values."""
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    return rows.select(*keys, "m.metric", "m.value").filter("value is not null")


def threshold_violations(df: DataFrame, by: list[str], limits: dict[str, float]) -> DataFrame:
    """A violation for each inner node and metric whose value exceeds its limit, whichever direction is better."""
    unknown = sorted(set(limits) - set(df.columns))
    if unknown:
        raise ValueError(f"no such metric: {', '.join(unknown)}")
    rows = long_values(df.filter(~is_external()), [*by, "id"], sorted(limits))
    bound = F.element_at(F.create_map(*[x for k, v in sorted(limits.items()) for x in (F.lit(k), F.lit(float(v)))]), F.col("metric"))
    rows = rows.withColumn("bound", bound).filter("value > bound")
    # The wording of the message.
    whole = (F.col("value") == F.floor("value")) & (F.col("bound") == F.floor("bound"))
    ratio = F.when(F.col("bound") > 0, F.col("value") / F.col("bound")).otherwise(float("inf"))
    number = lambda c: F.when(whole, F.format_string("%.0f", c)).otherwise(F.format_string("%.2f", c))
    text = F.concat("metric", F.lit(" "), number(F.col("value")), F.lit(" > "), number(F.col("bound")), F.lit(" ("), F.format_string("%.1f", ratio), F.lit("×)"))
    group = F.element_at(F.create_map(*[F.lit(x) for k in sorted(limits) for x in (k, concern(k))]), F.col("metric"))
    return rows.select(*by, F.concat(F.lit("threshold.file."), "metric").alias("rule"), group.alias("rule_group"), F.col("id").alias("location"), _null("int").alias("line"), text.alias("message"), ratio.alias("weight"), _null("string").alias("why"), _null("string").alias("fix"))


def apply_budgets(groups: DataFrame, budgets: dict[str, int | None]) -> DataFrame:
    """Cycles of the kinds that are not switched off; a kind without a rule has the budget 0."""
    off = [k for k, v in budgets.items() if v is None]
    return groups.filter(~F.col("kind").isin(*off)) if off else groups


def cycle_message(kind: Column, nodes: Column, size: Column) -> Column:
    """The first four members of a cycle in words (fixed values: the wording)."""
    shown = F.slice(nodes, F.lit(1), F.lit(4))
    tail = F.when(size > 4, F.concat(F.lit(" → … ("), size.cast("string"), F.lit(" nodes total)"))).otherwise(F.lit(" → (back to start)"))
    return F.when(kind == "mutual", F.concat(F.lit("mutual cycle between "), F.array_join(shown, " ↔ "))).otherwise(F.concat(F.lit("chain cycle: "), F.array_join(shown, " → "), tail))


def cycle_violations(groups: DataFrame, edges: DataFrame, by: list[str], budgets: dict[str, int | None]) -> DataFrame:
    """If a graph has more cycles of a kind than its budget, each of them is a violation at its break point."""
    limit = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(budgets[k])), sorted(k for k in budgets if budgets[k] is not None), F.when(F.lit(False), 0)).otherwise(0)
    counts = groups.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("found"))
    rows = apply_budgets(groups, budgets).join(counts, [*by, "kind"]).withColumn("budget", limit).filter("found > budget")
    rows = rows.join(break_points(rows, edges, by), [*by, "component"], "left")
    over = F.when(F.col("budget") > 0, F.format_string(" [%d > budget %d]", "found", "budget")).otherwise("")
    return rows.select(
        *by, F.concat(F.lit("cycle."), "kind").alias("rule"), F.lit("CYC").alias("rule_group"), F.coalesce("source", F.col("nodes")[0]).alias("location"), "line",
        F.concat(cycle_message(F.col("kind"), F.col("nodes"), F.col("size")), over).alias("message"), F.col("size").cast("double").alias("weight"), _null("string").alias("why"), _null("string").alias("fix"),
    )


_KINDS = {T.BooleanType: "bool", T.StringType: "text", T.DoubleType: "float", T.FloatType: "float", T.LongType: "int", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int"}


def _reads(tree: Node, functions: set[str]) -> bool:
    return (tree.kind == "call" and tree.value in functions) or any(_reads(a, functions) for a in tree.args)


def _aggregates_of(tree: Node) -> set[tuple[str, str, str]]:
    own = set()
    if tree.kind == "call" and tree.value == "agg":
        texts = [str(a.value) for a in tree.args]
        own = {(*texts, *["not_empty"] * (3 - len(texts)))}
    return own.union(*(_aggregates_of(a) for a in tree.args)) if tree.args else own


def _with_graph(rows: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the values of their graph; without ``by`` there is one graph and one row of values."""
    if by:
        return rows.join(values, by, "left")
    return rows.withColumn("_one", F.lit(1)).join(values.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def check_hits(df: DataFrame, edges: DataFrame, by: list[str], checks: list[CheckDef], defs: dict[str, str] | None = None, omit_at: dict[str, float] | None = None) -> DataFrame:
    """Violations of users' checks on inner nodes.

    Graph lists (deps, rdeps, files, siblings) and project aggregates are joined only if a check reads them; each
    aggregate is computed once. A check that can't be compiled is one violation of infinite weight without location;
    one that fails on a node doesn't fire there.
    """
    trees, bad = {}, []
    for check in checks:
        try:
            trees[check.id] = parse(expand_defs(check.when, defs or {}))
        except CelError as e:
            bad.append((check, str(e)))
    read = set().union(*(names(t) for t in trees.values())) if trees else set()
    wanted = set().union(*(_aggregates_of(t) for t in trees.values())) if trees else set()
    wanted = {w for w in wanted if w[0] in df.columns}
    rows = df.filter(~is_external())
    path = parts(F.col("path"))
    scope = {f.name: Typed(F.col(f.name), _KINDS[type(f.dataType)]) for f in df.schema.fields if type(f.dataType) in _KINDS and f.name not in by}
    scope |= {k: Typed(v, "text") for k, v in path.items()} | {"path": Typed(F.col("path"), "text")}
    uses = {n for n in ("deps", "rdeps") if n in read} | ({"deps"} if any(_reads(t, {"depends_on"}) for t in trees.values()) else set()) | ({"rdeps"} if any(_reads(t, {"depended_on_by"}) for t in trees.values()) else set())
    if uses:
        near = adjacency(df, edges, by, "path")
        rows = rows.join(near, [*by, "id"], "left")
        scope |= {n: Typed(F.col(n), "list") for n in ("deps", "rdeps")}
    inner = df.filter(F.coalesce(F.col("kind") != "external", F.lit(True)))
    if "siblings" in read:
        folders = inner.withColumn("_dir", path["dir"]).groupBy(*by, "_dir").agg(F.array_sort(F.collect_set("path")).alias("_all"))
        rows = rows.withColumn("_dir", path["dir"]).join(folders, [*by, "_dir"], "left").withColumn("siblings", F.array_remove("_all", F.col("path"))).drop("_dir", "_all")
        scope["siblings"] = Typed(F.col("siblings"), "list")
    if "files" in read or any(_reads(t, {"file_exists"}) for t in trees.values()):
        files = inner.groupBy(*by).agg(F.array_sort(F.collect_set("path")).alias("files"))
        rows = _with_graph(rows, files, by)
        scope["files"] = Typed(F.col("files"), "list")
    found: dict[tuple[str, str, str], str] = {}
    if wanted:
        values, found = aggregates(rows, by, sorted(wanted), omit_at)
        rows = _with_graph(rows, values, by)
    some = lambda lists, text: Typed(F.exists(lists, lambda d: F.contains(d, text.column)), "bool")
    functions = {
        "depends_on": lambda t: some(F.col("deps"), t),
        "depended_on_by": lambda t: some(F.col("rdeps"), t),
        "file_exists": lambda t: Typed(F.array_contains(F.col("files"), t.column), "bool"),
    }
    none = F.lit(None).cast("double")
    fired = []
    for check in checks:
        if check.id not in trees:
            continue
        try:
            test = compile_check(expand_defs(check.when, defs or {}), scope, lambda m, r, p: F.col(found[m, r, p]) if (m, r, p) in found else none, functions)
        except CelError as e:
            bad.append((check, str(e)))
            continue
        value = lambda k: scope[k].column if k in scope and scope[k].kind in ("text", "int", "float", "bool") else None
        said = lambda t: interpolate(t, value, lambda k: scope[k].kind in ("int", "float")) if t is not None else _null("string")
        fired.append(F.when(test, F.struct(F.lit(f"check.{check.id}").alias("rule"), F.lit(check.group).alias("rule_group"), said(check.message).alias("message"), said(check.why).alias("why"), said(check.fix).alias("fix"))))
    shape = "struct<" + ", ".join([*(f"`{b}`: {df.schema[b].dataType.simpleString()}" for b in by), "rule: string", "rule_group: string", "location: string", "line: int", "message: string", "weight: double", "why: string", "fix: string"]) + ">"
    broken = [tuple([None] * len(by) + [f"check.{c.id}", c.group, "", None, f"the check can't be compiled: {e}", float("inf"), c.why, c.fix]) for c, e in bad]
    out = df.sparkSession.createDataFrame(broken, shape)
    if fired:
        # One pass over the nodes evaluates all checks.
        hits = rows.select(*by, "id", F.explode(F.array_compact(F.array(*fired))).alias("h"))
        out = hits.select(*by, "h.rule", "h.rule_group", F.col("id").alias("location"), _null("int").alias("line"), "h.message", F.lit(1.0).alias("weight"), "h.why", "h.fix").unionByName(out)
    return out


def all_violations(df: DataFrame, edges: DataFrame, groups: DataFrame, by: list[str], *, limits: dict[str, float], budgets: dict[str, int | None], checks: list[CheckDef] = (), defs: dict[str, str] | None = None) -> DataFrame:
    """Violations of all rules."""
    found = cycle_violations(groups, edges, by, budgets)
    if limits:
        found = found.unionByName(threshold_violations(df, by, limits))
    if checks:
        found = found.unionByName(check_hits(df, edges, by, list(checks), defs))
    return found.select(*by, *_COLUMNS)


def top_findings(violations: DataFrame, n: int) -> DataFrame:
    """The n heaviest violations of all."""
    return violations.orderBy(F.desc("weight"), "location", "rule", "message").limit(n)


def exit_status(violations: DataFrame, exit_zero: bool = False) -> int:
    """1 if anything was found, whatever part of it is shown."""
    return 0 if exit_zero or violations.isEmpty() else 1


def rule_focus(violations: DataFrame, *wanted: str) -> DataFrame:
    """Violations whose rule, group or last part of the rule is wanted."""
    return violations.filter(F.col("rule").isin(*wanted) | F.col("rule_group").isin(*wanted) | F.element_at(F.split("rule", r"\."), -1).isin(*wanted))


def breakdown(violations: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule_group, findings)."""
    return violations.groupBy(*by, "rule_group").agg(F.count(F.lit(1)).alias("findings"))


def suggested_limits(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, most): the greatest value of each metric of inner nodes, a limit that nothing exceeds."""
    rows = long_values(df.filter(~is_external()), by, metrics)
    return rows.groupBy(*by, "metric").agg(F.max("value").alias("most"))


def sarif_rules(violations: DataFrame) -> DataFrame:
    """(rule, rule_group, why): each rule once, with the least of its texts."""
    return violations.groupBy("rule").agg(F.min("rule_group").alias("rule_group"), F.min("why").alias("why"))


def ranked(df: DataFrame, by: list[str], metric: str) -> Window:
    """The worst-first order of nodes by a metric."""
    return Window.partitionBy(*by).orderBy(F.desc(metric), F.desc(F.coalesce("sloc", F.lit(0))), F.desc(F.coalesce("items", F.lit(0))), "id")
