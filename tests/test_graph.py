import random

from pyspark.sql import functions as F

from lodegraph.model import CheckDef, MetricDef, Principle, parse_cycle_rule
from lodegraph.operators import diff, graph, hier, metrics, rank, rules
from lodegraph.operators.metrics import aggregate, derive, emitted, graph_metrics, stats, user_metrics, with_hk

NODES = "g string, id string, kind string, external boolean, crate string, path string"
EDGES = "g string, source string, target string, kind string, line int, visibility string"


def nodes(spark, *ids, g="x"):
    return spark.createDataFrame([(g, i, "external" if i.startswith("ext:") else "file", None, None, i) for i in ids], NODES)


def edges(spark, *pairs, g="x"):
    return spark.createDataFrame([(g, p[0], p[1], p[2] if len(p) > 2 else "uses", p[3] if len(p) > 3 else None, None) for p in pairs], EDGES)


def test_finalize_keeps_the_first_edge_and_used_externals(spark):
    n, e = graph.finalize(nodes(spark, "a", "b", "ext:unused", "ext:used"), edges(spark, ("a", "b", "uses", 9), ("a", "b", "uses", 4), ("a", "b", "uses", None), ("a", "a"), ("b", "ext:used")), ["g"])
    assert {r["id"] for r in n.collect()} == {"a", "b", "ext:used"}
    assert {(r["source"], r["target"], r["line"]) for r in e.collect()} == {("a", "b", 4), ("b", "ext:used", None)}


def test_coupling(spark):
    n = nodes(spark, "a", "b", "c", "ext:x")
    e = edges(spark, ("a", "b"), ("a", "b", "uses", 3), ("b", "c"), ("a", "ext:x"), ("ext:x", "a"), ("c", "a", "contains"), ("c", "missing"))
    got = {r["id"]: tuple(r)[2:] for r in graph.coupling(n, e, ["g"]).collect()}
    assert got == {"a": (None, 1, 1), "b": (1, 1, None), "c": (1, None, None)}


def _brute_components(pairs):
    reach = {}
    for a, _ in pairs:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for s, t in pairs:
                if s == x and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[a] = seen
    return {a: min([a, *(b for b in reach[a] if a in reach.get(b, ()))]) for a in reach if a in reach[a]}


def test_components_locally_and_by_colouring_agree_with_brute_force(spark):
    rng = random.Random(8)
    ids = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)} - {(i, i) for i in ids}) + [("z1", "z2"), ("z2", "z1")]
    n, e = nodes(spark, *ids, "z1", "z2"), edges(spark, *pairs, ("z1", "z1"), ("n00", "gone"), ("n01", "z1", "contains"))
    expected = _brute_components(pairs)
    for limit in (10**6, 0):
        assert {r["id"]: r["component"] for r in graph.strong_components(n, e, ["g"], local_edges=limit).collect()} == expected


def test_cycles_by_kind_and_crates(spark):
    n = spark.createDataFrame([("x", i, "file", None, c, i) for i, c in (("a", None), ("b", None), ("c", None), ("d", "k1"), ("e", "k2"), ("p/src/f", None), ("q/src/f", None), ("h", "k1"), ("i", None))], NODES)
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("p/src/f", "q/src/f"), ("q/src/f", "p/src/f"), ("h", "i"), ("i", "h"))
    groups = graph.cycles(graph.strong_components(n, e, ["g"]), n, ["g"])
    assert {(r["component"], r["kind"], r["size"]) for r in groups.collect()} == {("a", "chain", 3), ("h", "mutual", 2)}
    assert {r["component"]: (r["source"], r["target"]) for r in graph.break_points(groups, e, ["g"]).collect()} == {"a": ("a", "b"), "h": ("h", "i")}


def test_empty_graph(spark):
    n, e = nodes(spark, "a").limit(0), edges(spark, ("a", "b")).limit(0)
    parts = graph.strong_components(n, e, ["g"])
    assert parts.count() == 0 and graph.cycles(parts, n, ["g"]).count() == 0
    assert graph.coupling(n, e, ["g"]).count() == 0 and graph.adjacency(n, e, ["g"]).count() == 0


def test_published_metric_values(spark):
    """A small Go project with known counts, coupling and metrics."""
    rows = [
        ("main.go", 19, 16, 32, 30, 3, 3, 4, 15, 10, 4, 4, 23, None, 1, 1), ("mathx.go", 10, 9, 11, 13, 2, 0, 0, 6, 3, 2, 2, 10, 1, 1, None),
        ("util.go", 8, 5, 10, 10, 2, 1, 1, 7, 3, 2, 1, 10, 1, None, None),
    ]
    rows = [tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows]
    df = spark.createDataFrame(rows, "id string, eta1 double, eta2 double, n1 double, n2 double, spaces double, branches double, cognitive double, sloc double, lloc double, cloc double, blank double, span_sloc double, fan_in double, fan_out double, fan_out_external double")
    out = with_hk(emitted(derive(df), inputs=["cognitive", "sloc", "cloc", "blank"]))
    got = {r["id"]: r.asDict() for r in out.collect()}
    expected = {
        "main.go": {"cyclomatic": 6, "length": 62, "vocabulary": 35, "volume": 318.015, "effort": 5664.651, "time": 314.702, "bugs": 0.105, "mi": 88.862, "mi_sei": 83.213, "hk": None},
        "mathx.go": {"cyclomatic": 2, "length": 24, "vocabulary": 19, "volume": 101.95, "effort": 736.307, "time": 40.905, "bugs": 0.0271, "mi": 109.19, "mi_sei": 113.967, "hk": 6, "cognitive": None},
        "util.go": {"cyclomatic": 3, "length": 20, "vocabulary": 13, "volume": 74.008, "effort": 592.07, "time": 32.892, "bugs": 0.0235, "mi": 110.626, "mi_sei": 116.14, "hk": None},
    }
    for name, values in expected.items():
        for key, value in values.items():
            assert got[name][key] == value, (name, key)
    means = {r["key"]: r["value"] for r in stats(out, [], ["sloc", "cyclomatic", "bugs", "effort", "cognitive", "hk", "volume", "mi"]).collect()}
    assert means == {"sloc": 9.333, "cyclomatic": 3.666, "bugs": 0.0518, "effort": 2331.009, "cognitive": 2.5, "hk": 6.0, "volume": 164.657, "mi": 102.892}


def test_reducers(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 5, 3, 9, 2, 8)] + [(None,), (0.0,), (float("nan"),)], "v double")
    value = lambda r, p="not_empty": aggregate(df, [], "v", r, p).first()
    got = {r: value(r)[0] for r in ("sum", "avg", "min", "max", "count", "median", "p90", "top3_avg", "top3_max", "top2_sum", "top10", "top2_p50")}
    assert got == {"sum": 28, "avg": 28 / 6, "min": 1, "max": 9, "count": 6, "median": 4, "p90": 8.5, "top3_avg": 22 / 3, "top3_max": 9, "top2_sum": 17, "top10": 28 / 6, "top2_p50": 8.5}
    assert value("count", "all")[0] == 9 and value("top")[0] is None and value("p101")[0] is None


def test_user_and_graph_metrics(spark):
    df = spark.createDataFrame([("g", "a", 40.0, 10.0, "a/b.py"), ("g", "b", 0.0, 3.0, "b.rs"), ("g", "c", None, 1.0, "c")], "g string, id string, sloc double, cloc double, path string")
    defs = [MetricDef("ratio", "sloc > 0.0 ? cloc / sloc * 100.0 : 0.0"), MetricDef("twice", "ratio * 2.0"), MetricDef("bad", "ln(sloc - sloc)")]
    got = {r["id"]: (r["ratio"], r["twice"], r["bad"]) for r in user_metrics(df, defs, ["sloc", "cloc"]).collect()}
    assert got == {"a": (25.0, 50.0, None), "b": (None, None, None), "c": (None, None, None)}
    made = graph_metrics(df, ["g"], [MetricDef("half", "total / 2.0", "graph"), MetricDef("total", "agg('cloc', 'sum', 'all')", "graph"), MetricDef("none", "agg('cloc', 'what', 'all')", "graph")]).first()
    assert (made["total"], made["half"], made["none"]) == (14.0, 7.0, None)
    assert MetricDef("x", "1.0", warning=3.0).info == 3.0


def _measured(spark):
    rows = [("x", "a", "file", None, "k", "d/a.py", 700.0, 3.0, 9.0, 5, None), ("x", "b", "file", None, "k", "d/b.rs", 10.0, None, 1.0, 2, "mutual"), ("x", "c", "file", None, "m", "c.go", None, 100.0, None, None, "mutual"), ("x", "ext:e", "external", None, None, "ext:e", 999.0, 1.0, 1.0, 1, None)]
    return spark.createDataFrame(rows, "g string, id string, kind string, external boolean, crate string, path string, sloc double, hk double, cyclomatic double, items int, cycle string")


def test_violations(spark):
    df, e = _measured(spark), edges(spark, ("a", "b"), ("b", "c"), ("c", "b"))
    got = rules.threshold_violations(df, ["g"], {"sloc": 350.0, "hk": 0.0}).collect()
    assert {(r["rule"], r["location"], r["weight"], r["rule_group"]) for r in got} == {("threshold.file.sloc", "a", 2.0, "SIZ"), ("threshold.file.hk", "a", float("inf"), "CPL"), ("threshold.file.hk", "c", float("inf"), "CPL")}
    assert next(r["message"] for r in got if r["rule"].endswith("sloc")) == "sloc 700 > 350 (2.0×)"
    groups = graph.cycles(graph.strong_components(df, e, ["g"]), df, ["g"], drop_multi_crate=False)
    bad = rules.cycle_violations(groups, e, ["g"], {"mutual": 0}).collect()
    assert [(r["rule"], r["location"], r["weight"], r["message"]) for r in bad] == [("cycle.mutual", "b", 2.0, "mutual cycle between b ↔ c")]
    assert rules.cycle_violations(groups, e, ["g"], {"mutual": 1}).count() == 0 == rules.cycle_violations(groups, e, ["g"], {"mutual": None}).count()
    checks = [
        CheckDef("big", "sloc > agg('sloc', 'p50', 'not_empty') && !(kind == 'x')", "{name} {sloc} {absent}"), CheckDef("dep", "depends_on('b.rs')", "m"), CheckDef("sib", "siblings.exists(s, s.endsWith('.rs'))", "m"),
        CheckDef("re", "matches(path, '/[ab]\\\\.')", "m"), CheckDef("badre", "matches(path, '(')", "m"), CheckDef("file", "file_exists('c.go') && stem == 'c'", "m"), CheckDef("syntax", "1 +", "m"), CheckDef("type", "path > 3", "m"), CheckDef("num", "sloc + 1.0", "m"),
    ]
    hits = rules.check_hits(df, e, ["g"], checks).collect()
    assert {(r["rule"][6:], r["location"]) for r in hits} == {("big", "a"), ("dep", "a"), ("dep", "c"), ("sib", "a"), ("re", "a"), ("re", "b"), ("file", "c"), ("syntax", ""), ("type", "")}
    assert next(r["message"] for r in hits if r["rule"] == "check.big") == "a.py 700 {absent}"
    assert rules.exit_status(rules.threshold_violations(df, ["g"], {"sloc": 1e9})) == 0 and parse_cycle_rule(True) == 0 and parse_cycle_rule(False) is None


def test_checks_of_a_single_graph(spark):
    hits = rules.check_hits(_measured(spark).drop("g"), edges(spark, ("a", "b")).drop("g"), [], [CheckDef("c", "sloc >= agg('sloc', 'max', 'not_empty') && files.size() == 3", "m")])
    assert [r["location"] for r in hits.collect()] == ["a"]


def test_rankings(spark):
    df = _measured(spark)
    assert [(r["id"], r["rank"]) for r in rank.rank_by(df, ["g"], "hk", 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]
    limits = {"sloc": (5.0, 300.0), "hk": (2.0, 50.0)}
    got = {r["id"]: (r["warnings"], r["infos"], r["worst"], r["rank"]) for r in rank.breach_rows(df.filter("kind = 'file'"), ["g"], limits, cycle="cycle").collect()}
    assert got == {"c": (2, 0, "hk", 1), "a": (1, 1, "sloc", 2), "b": (1, 1, "sloc", 3)}
    card = {r["principle"]: (r["warnings"], r["infos"], r["top"]) for r in rank.scorecard(df, ["g"], [Principle("S", "sloc"), Principle("N", "nothing")], limits).collect()}
    assert card == {"S": (1, 1, "a")}
    tiers = {r["metric"]: (r["warnings"], r["infos"]) for r in rank.tier_counts(df.filter("kind = 'file'"), ["g"], limits).collect()}
    assert tiers == {"sloc": (1, 2), "hk": (1, 2)}


def test_diffs(spark):
    before = (nodes(spark, "a", "b", "c", "old"), edges(spark, ("a", "b"), ("b", "c"), ("c", "old")))
    after = (nodes(spark, "a", "b", "c", "new", "calm"), edges(spark, ("a", "b"), ("b", "c"), ("c", "new")))
    n, e = diff.diff_graphs(before, after, ["g"])
    assert {r["id"]: r["status"] for r in n.collect()} == {"a": "unchanged", "b": "unchanged", "c": "affected", "old": "removed", "new": "added", "calm": "added"}
    assert {(r["source"], r["target"]): r["status"] for r in e.collect()} == {("a", "b"): "unchanged", ("b", "c"): "affected", ("c", "old"): "removed", ("c", "new"): "added"}
    v = lambda *rows: spark.createDataFrame([("x", r, w) for r, w in rows], "g string, rule string, location string")
    for base, cur, expected in ((v(("r", "a")), v(("r", "a"), ("r", "b")), "degraded"), (v(("r", "a"), ("r", "b")), v(("r", "a")), "improved")):
        assert diff.verdict(diff.new_and_resolved(base, cur, ["g"]), ["g"]).first()["verdict"] == expected


def test_hierarchy_of_folders(spark):
    df = _measured(spark).withColumn("loc", F.lit(1))
    assert {(r["crate"], r["root"]) for r in hier.crate_roots(df, ["g"]).collect()} == {("k", "d"), ("m", "")}
    roll = {(r["level"], r["key"]): (r["members"], r["in_cycle"], r["sloc"]) for r in hier.rollup(df, ["g"], ["sloc"], "cycle").collect()}
    assert roll[("folder", "d")] == (2, 1, 710.0) and roll[("crate", "m")] == (1, 1, None) and roll[("file", "a")] == (1, 0, 700.0)
    assert hier.upper_median(df.filter("kind = 'file'"), ["g"], "sloc").first()["median"] == 700.0
    key = df.select(hier.dig_key(F.col("path"), F.col("crate"), 1).alias("k"), hier.folder_key(F.lit("a/b/c/d.py"), 2).alias("f")).collect()
    assert [r["k"] for r in key] == ["k/d", "k/d", "m", "_root"] and key[0]["f"] == "a/b"
