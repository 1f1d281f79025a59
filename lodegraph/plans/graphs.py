"""Queries for the graph operators over the nodes and edges of all repositories at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import numeric, paths
from lodegraph.model import DERIVED, CheckDef, MetricDef, Principle
from lodegraph.operators import diff, graph, hier, levels, metrics, rank, rules
from lodegraph.operators.latest import latest
from lodegraph.workspace import materialize, table

BY = ["repo"]
#: The measured inputs of a node, from its lines l and items m; the same text is SQL for both engines.
INPUT_SQL = {
    "eta1": "5 + l % 17", "eta2": "3 + m % 13", "n1": "l * 2 + m", "n2": "l + m * 2", "spaces": "1 + m", "branches": "l % 11",
    "cognitive": "l % 7", "exits": "m % 3", "args": "m % 5", "closures": "l % 2", "sloc": "l", "lloc": "(l - l % 2) / 2", "cloc": "l % 9",
    "blank": "l % 6", "tloc": "m % 4", "span_sloc": "l + l % 9 + l % 6",
}
LIMITS = {"hk": 100000.0, "sloc": 600.0, "cyclomatic": 40.0, "fan_out": 6.0}
BUDGETS = {"mutual": 0, "chain": 1}
THRESHOLDS = {"hk": (10000.0, 100000.0), "sloc": (300.0, 600.0), "cyclomatic": (20.0, 40.0)}
PRINCIPLES = [Principle("coupling", "hk"), Principle("size", "sloc"), Principle("complexity", "cyclomatic"), Principle("surface", "items"), Principle("fan", "fan_out")]
CHECKS = [
    CheckDef("hub", "fan_in > 3 && fan_out > 3", "{name} in {dir} has {fan_in} dependents", fix="split it"),
    CheckDef("tangle", "sloc > agg('sloc', 'p90', 'not_empty')", "sloc {sloc} of {kind}", group="SIZ"),
    CheckDef("broken", "sloc >", "never"),
]
_SHORT = {"inputs": list(INPUT_SQL), "outs": ["cyclomatic", "vocabulary", "length"]}


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sighting of every node, with its path and measured inputs."""
    rows = latest(table(spark, sf_dir, "nodes").select("repo", "id", "seen_at", "node_key", "kind", "name", "external", "crate", "visibility", "path", "loc", "items"), ["repo", "id"], "seen_at").drop("seen_at")
    rows = rows.withColumn("path", paths.node_path(F.col("id"), F.col("path")))
    measured = rows.withColumns({"l": F.coalesce("loc", F.lit(0)), "m": F.coalesce("items", F.lit(0))})
    return measured.withColumns({k: F.expr(f"cast({v} as double)") for k, v in INPUT_SQL.items()}).drop("l", "m")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges")


_kept: dict[tuple[str, str, str, str], DataFrame] = {}


def forget() -> None:
    """Make kept tables anew when they are needed next."""
    _kept.clear()


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """When the tables were written and how large they are: a changed folder gives no kept table."""
    jvm = spark.sparkContext._jvm
    found = []
    for name in ("nodes", "edges"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        summary, status = system.getContentSummary(path), system.getFileStatus(path)
        found.append(f"{summary.getLength()}:{summary.getFileCount()}:{status.getModificationTime()}")
    return ",".join(found)


def _once(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries pass over is made once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key not in _kept:
        _kept[key] = materialize(make())
    return _kept[key]


def edges_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("edges", spark, sf_dir, lambda: graph.first_edges(edges_of(spark, sf_dir), BY))


def final(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The final graph: both tables are made once, as many queries pass over them."""
    edges = edges_final(spark, sf_dir)
    return _once("nodes", spark, sf_dir, lambda: graph.finalize(nodes_of(spark, sf_dir), edges, BY)[0]), edges


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the final graph with reported metrics: counts, derived ones, coupling, hk and cycle kind."""

    def make() -> DataFrame:
        nodes = final(spark, sf_dir)[0]
        inner = ~graph.is_external()
        raw = metrics.derive(nodes, [m for m in DERIVED if m.key in _SHORT["outs"]])
        out = metrics.emitted(raw, [m for m in DERIVED if m.key in _SHORT["outs"]])
        for c in [*_SHORT["inputs"], *_SHORT["outs"]]:
            out = out.withColumn(c, F.when(inner, F.col(c)))
        out = out.join(graph.coupling(nodes, edges_final(spark, sf_dir), BY), ["repo", "id"], "left")
        out = metrics.with_hk(out).withColumn("hk", F.when(inner, F.col("hk")))
        members = groups_of(spark, sf_dir).select("repo", F.explode("nodes").alias("id"), F.col("kind").alias("cycle"))
        return out.join(members, ["repo", "id"], "left")

    return _once("measured", spark, sf_dir, make)


def components_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("components", spark, sf_dir, lambda: graph.strong_components(final(spark, sf_dir)[0], edges_final(spark, sf_dir), BY))


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of all repos, those across crates too."""
    return _once("groups", spark, sf_dir, lambda: graph.cycles(components_of(spark, sf_dir), final(spark, sf_dir)[0], BY, drop_multi_crate=False))


def baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph as of an earlier day: nodes first seen by then, and the edges that leave them."""
    seen = table(spark, sf_dir, "nodes").groupBy("repo", "id").agg(F.min("seen_at").alias("first")).filter("first < timestamp '2025-07-01'")
    nodes = nodes_of(spark, sf_dir).join(seen, ["repo", "id"], "left_semi")
    edges = edges_of(spark, sf_dir).join(seen.select("repo", F.col("id").alias("source")), ["repo", "source"], "left_semi")
    return nodes, graph.first_edges(edges.select("repo", "source", "target", "kind", "line", "visibility"), BY)


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.all_violations(measured(spark, sf_dir), edges_final(spark, sf_dir), groups_of(spark, sf_dir), BY, limits=LIMITS, budgets=BUDGETS, checks=CHECKS)


def _base_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the baseline's metrics that need no graph: thresholds on size."""
    return rules.threshold_violations(baseline(spark, sf_dir)[0], BY, {"sloc": 600.0})


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.new_and_resolved(_base_violations(spark, sf_dir), rules.threshold_violations(measured(spark, sf_dir), BY, {"sloc": 600.0}), BY)


def _derived(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    rows = metrics.derive(nodes_of(spark, sf_dir).filter(~graph.is_external()))
    return rows.select("repo", "id", *[F.round(k, 6).alias(k) for k in keys])


def _agg(spark: SparkSession, sf_dir: str, reducers: list[str], population: str = "not_empty") -> DataFrame:
    rows, names = metrics.aggregates(measured(spark, sf_dir).filter(~graph.is_external()), BY, [("sloc", r, population) for r in reducers])
    return rows.select("repo", *[F.round(names["sloc", r, population], 6).alias(f"sloc_{r}") for r in reducers])


def _check(spark: SparkSession, sf_dir: str, when: str, message: str = "{name}", defs: dict[str, str] | None = None) -> DataFrame:
    hits = rules.check_hits(measured(spark, sf_dir), edges_final(spark, sf_dir), BY, [CheckDef("c", when, message)], defs)
    return hits.select("repo", "location", "message")


def _diffed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return diff.diff_graphs(baseline(spark, sf_dir), (final(spark, sf_dir)[0], edges_final(spark, sf_dir)), BY)


def _user_metrics(spark: SparkSession, sf_dir: str, *defs: MetricDef) -> DataFrame:
    rows = measured(spark, sf_dir).filter(~graph.is_external())
    texts = paths.parts(F.col("path")) | {"path": F.col("path")}
    out = metrics.user_metrics(rows, list(defs), ["sloc", "cloc", "hk", "fan_in", "fan_out", "cyclomatic"], texts)
    return out.select("repo", "id", *[F.round(d.key, 6).alias(d.key) for d in defs]).filter(" or ".join(f"{d.key} is not null" for d in defs))


def _functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(functions with their parent's id, files)."""
    rows = latest(table(spark, sf_dir, "nodes").select("repo", "id", "seen_at", "parent"), ["repo", "id"], "seen_at")
    files, functions = levels.split_functions(rows)
    return functions, files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.lower("path").rlike(r"\.(md|markdown)$")).select("doc_id", "text")


def markdown_lines(docs: DataFrame) -> DataFrame:
    """Counts of a Markdown text: headings, deepest heading, lines of fenced code, links."""
    from lodegraph.sources.markdown import measure

    return measure(docs, "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "finalize_edges": edges_final,
    "external_prune": lambda s, d: final(s, d)[0].select("repo", "id", "kind"),
    "flow_edges": lambda s, d: graph.flow_edges(edges_final(s, d)).select("repo", "source", "target"),
    "coupling": lambda s, d: graph.coupling(final(s, d)[0], edges_final(s, d), BY),
    "hk": lambda s, d: measured(s, d).filter("hk is not null").select("repo", "id", "hk"),
    "top_hk": lambda s, d: rank.rank_by(measured(s, d), BY, "hk", 15),
    "derived_halstead": lambda s, d: _derived(s, d, ["vocabulary", "length", "volume", "effort", "time", "bugs"]),
    "derived_mi": lambda s, d: _derived(s, d, ["cyclomatic", "mi", "mi_sei"]),
    "omit_at_floor": lambda s, d: measured(s, d).select("repo", "id", "cyclomatic", "cognitive", "sloc", "cloc", "tloc"),
    "round_sig3": lambda s, d: nodes_of(s, d).select("repo", "id", numeric.truncated(F.col("loc") / 7).alias("by_seven"), numeric.truncated(F.col("items") / 4096).alias("small")),
    "stats_mean": lambda s, d: metrics.stats(measured(s, d).filter(~graph.is_external()), BY, ["sloc", "cloc", "cyclomatic", "fan_in", "fan_out", "hk"]),
    "agg_basic": lambda s, d: _agg(s, d, ["sum", "avg", "min", "max", "count"]),
    "agg_percentiles": lambda s, d: _agg(s, d, ["median", "p90", "p99", "p99.9"]).withColumnRenamed("sloc_p99.9", "sloc_p999"),
    "agg_top10_avg": lambda s, d: metrics.aggregate(measured(s, d).filter(~graph.is_external()), BY, "sloc", "top10_avg").withColumn("value", F.round("value", 6)),
    "agg_population_all": lambda s, d: _agg(s, d, ["avg", "median", "count"], "all"),
    "graph_metric_compose": lambda s, d: metrics.graph_metrics(measured(s, d).filter(~graph.is_external()), BY, [MetricDef("big", "agg('sloc', 'max', 'not_empty') - agg('sloc', 'min', 'not_empty')", "graph"), MetricDef("spread", "big / agg('sloc', 'count', 'not_empty')", "graph")]).select("repo", F.round("big", 3).alias("big"), F.round("spread", 2).alias("spread")),
    "user_metric_ratio": lambda s, d: _user_metrics(s, d, MetricDef("ratio", "sloc > 0.0 ? cloc * 8.0 / 16.0 : 0.0"), MetricDef("twice", "ratio * 2.0")),
    "user_metric_path_branch": lambda s, d: _user_metrics(s, d, MetricDef("weighted", "ext == 'py' ? sloc * 2.0 : (path.contains('/core/') ? sloc * 3.0 : sloc)")),
    "threshold_violations": lambda s, d: rules.threshold_violations(measured(s, d), BY, LIMITS).select("repo", "rule", "rule_group", "location", F.round("weight", 6).alias("weight")),
    "threshold_messages": lambda s, d: rules.threshold_violations(measured(s, d), BY, {"sloc": 600.0, "fan_out": 6.0}).select("repo", "location", F.regexp_replace("message", r" \(.*$", "").alias("message")),
    "cycle_members": lambda s, d: components_of(s, d).select("repo", "id", "component"),
    "cycle_groups": lambda s, d: groups_of(s, d).select("repo", "component", "kind", "size", F.array_join("nodes", ",").alias("members")),
    "cycle_budget": lambda s, d: rules.cycle_violations(groups_of(s, d), edges_final(s, d), BY, BUDGETS).select("repo", "rule", "location", "line", "weight"),
    "multi_crate_drop": lambda s, d: graph.cycles(components_of(s, d), final(s, d)[0], BY).select("repo", "component", "kind", "size"),
    "break_point": lambda s, d: graph.break_points(groups_of(s, d), edges_final(s, d), BY),
    "cycle_rank": lambda s, d: rank.rank_cycles(groups_of(s, d), BY, 3),
    "check_relative_p90": lambda s, d: _check(s, d, "sloc > agg('sloc', 'p90', 'not_empty')"),
    "check_depends_on": lambda s, d: _check(s, d, "depends_on('valve') && !depended_on_by('.py')"),
    "check_siblings": lambda s, d: _check(s, d, "siblings.size() > 1 && siblings.exists(x, x.endsWith('.go'))"),
    "check_exists_macro": lambda s, d: _check(s, d, "deps.exists(x, x.contains('planner')) || rdeps.all(x, x.startsWith('ext:')) && rdeps.size() > 0"),
    "check_regex": lambda s, d: _check(s, d, "path.matches('[aeiou]r[a-z]*_[0-9a-z]+\\\\.(rs|go)$')"),
    "defs_macro": lambda s, d: _check(s, d, "large && linked", "{stem}.{ext}", {"large": "sloc > limit", "limit": "500", "linked": "fan_in > 1"}),
    "message_interpolation": lambda s, d: _check(s, d, "fan_in >= 3", "{name} of {kind}: {fan_in} in, {cloc} comments, {nothing}"),
    "violations_all": lambda s, d: _violations(s, d).select("repo", "rule", "rule_group", "location", F.round(numeric.finite(F.col("weight")), 6).alias("weight")),
    "violation_breakdown": lambda s, d: rules.breakdown(_violations(s, d), BY),
    "findings_top": lambda s, d: rules.top_findings(rules.threshold_violations(measured(s, d), BY, LIMITS), 20).select("repo", "location", "rule"),
    "rule_focus": lambda s, d: rules.rule_focus(rules.threshold_violations(measured(s, d), BY, LIMITS), "SIZ", "fan_out").select("repo", "rule", "location"),
    "sarif_rules_dedup": lambda s, d: rules.sarif_rules(_violations(s, d)).select("rule", "rule_group"),
    "suggest_config_max": lambda s, d: rules.suggested_limits(measured(s, d), BY, ["sloc", "hk", "cyclomatic", "fan_in"]),
    "scorecard_principles": lambda s, d: rank.scorecard(measured(s, d), BY, PRINCIPLES[:3], THRESHOLDS).select("repo", "principle", "warnings", "infos"),
    "breach_rows": lambda s, d: rank.breach_rows(measured(s, d), BY, THRESHOLDS, cycle="cycle").select("repo", "id", "warnings", "infos", "worst", F.round("ratio", 6).alias("ratio"), "rank"),
    "rank_metric": lambda s, d: rank.rank_by(measured(s, d), BY, "cyclomatic", 10),
    "tier_counts": lambda s, d: rank.tier_counts(measured(s, d), BY, THRESHOLDS),
    "warning_types": lambda s, d: rank.warning_types(measured(s, d).filter(~graph.is_external()), BY, LIMITS, "cycle"),
    "connections": lambda s, d: rank.connections(edges_final(s, d), rank.rank_by(measured(s, d), BY, "hk", 5).select("repo", "id"), BY),
    "diff_nodes": lambda s, d: _diffed(s, d)[0],
    "diff_edges": lambda s, d: _diffed(s, d)[1],
    "diff_cycles": lambda s, d: diff.diff_cycles(graph.cycles(graph.strong_components(*baseline(s, d), BY), baseline(s, d)[0], BY, drop_multi_crate=False), groups_of(s, d), BY),
    "new_violations": _changes,
    "verdict": lambda s, d: diff.verdict(_changes(s, d), BY),
    "group_status": lambda s, d: diff.group_status(_diffed(s, d)[0].withColumn("kind", F.coalesce(F.get(F.split(F.col("id"), "/"), F.lit(1)), F.lit(""))), BY, "kind"),
    "ignore_glob": lambda s, d: graph.ignore(final(s, d)[0], edges_final(s, d), BY, ["*core/*", "ext:a*", "**/*.{py,go}"])[1].select("repo", "source", "target", "kind"),
    "focus_path": lambda s, d: measured(s, d).filter(paths.focused(F.col("path"), "area00/") | paths.focused(F.col("path"), "src/core")).select("repo", "id"),
    "relativize": lambda s, d: nodes_of(s, d).select("repo", "id", paths.relativized(F.regexp_replace("id", r"^\{target\}", "/work"), {"target": "/work", "area": "/work/area00", "top": "/"}).alias("short")),
    "path_parts": lambda s, d: nodes_of(s, d).select("repo", "id", *[v.alias(f"p_{k}") for k, v in paths.parts(F.col("path")).items()]),
    "path_normalize": lambda s, d: edges_final(s, d).select("repo", "source", "target", "kind", paths.normalized(F.concat("source", F.lit("/.././x/../"), "target")).alias("joined")),
    "test_paths": lambda s, d: nodes_of(s, d).filter(paths.test_path(F.col("path"), ["tests", "valve", "src", "area00"], suffixes=["_3.py"], prefixes=["map"])).select("repo", "id"),
    "adjacency_lists": lambda s, d: graph.adjacency(final(s, d)[0], edges_final(s, d), BY).select("repo", "id", F.array_join("deps", ",").alias("deps"), F.array_join("rdeps", ",").alias("rdeps")),
    "dig_in": lambda s, d: measured(s, d).filter(~graph.is_external()).groupBy("repo", hier.dig_key(F.col("path"), F.col("crate"), 1).alias("key")).agg(F.count(F.lit(1)).alias("members")),
    "dig_out": lambda s, d: measured(s, d).filter(~graph.is_external()).groupBy("repo", hier.folder_key(F.col("path"), 2).alias("key")).agg(F.count(F.lit(1)).alias("members")),
    "group_counts": lambda s, d: hier.group_counts(measured(s, d), BY, range(0, 5)),
    "grouping_sets_rollup": lambda s, d: hier.rollup(measured(s, d), BY, ["sloc", "fan_in"], "cycle"),
    "group_edges": lambda s, d: graph.group_edges(edges_final(s, d), measured(s, d).select("repo", "id", hier.folder_key(F.col("path"), 1).alias("group")), BY),
    "group_stats_lcp": lambda s, d: hier.group_summary(measured(s, d), BY, "cycle"),
    "crate_roots": lambda s, d: hier.crate_roots(measured(s, d), BY),
    "summary_distribution": lambda s, d: hier.distribution(measured(s, d), BY, ["sloc", "fan_in", "cyclomatic"]).select("repo", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "p1", "p10", "p50", "p90", "p99")]),
    "summary_counts": lambda s, d: hier.summary(measured(s, d), edges_final(s, d), BY, "cycle"),
    "upper_median": lambda s, d: hier.upper_median(measured(s, d), BY, "sloc"),
    "depth_extremes": lambda s, d: hier.depth_extremes(measured(s, d), BY),
    "neighbour_groups": lambda s, d: hier.neighbours(measured(s, d), edges_final(s, d), BY, F.col("path").rlike("^[a-m]")),
    "disjoint_ids": lambda s, d: graph.shared_ids(nodes_of(s, d).withColumn("language", F.col("repo")), [], "language"),
    "markdown_metrics": lambda s, d: markdown_lines(_docs(s, d)),
    "function_split": lambda s, d: levels.split_functions(nodes_of(s, d))[1].select("repo", "id"),
    "orphan_functions": lambda s, d: levels.with_parent(*_functions(s, d), BY).select("repo", "id"),
    "reachable": lambda s, d: levels.reachable(nodes_of(s, d).filter("kind = 'module'"), graph.flow_edges(edges_final(s, d)), BY),
    "present_columns": lambda s, d: levels.present_columns(nodes_of(s, d), BY, ["kind", "external", "crate", "visibility", "items"]),
    "used_roots": lambda s, d: levels.used_roots(nodes_of(s, d), BY),
    "abbreviations": lambda s, d: measured(s, d).filter("hk is not null").select("repo", "id", numeric.abbreviated(F.col("hk")).alias("shown")),
}
