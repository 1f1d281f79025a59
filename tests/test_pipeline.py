import pytest

from lodegraph import pipeline
from lodegraph.model import CheckDef, Metric, Principle
from lodegraph.operators import advice, viewer
from lodegraph.sources.dialects import BY_EXTENSION, DIALECTS, measure_text

OF = {d.name: d for d in DIALECTS}
GO = """// Package a is measured.
package a

import "fmt"

func Twice(n, m int, s string) int {
	// two comments
	f := func(x int) int { return x * 2 }
	for i := 0; i < n; i++ {
		if i > 2 && n > i || m == 0 {
			fmt.Println(s)
		} else {
			n--
		}
	}
	return f(n)
}

func (t *T) Get() {}
"""
CODE = {
    "js": "class A {\n  get(a, b) { if (a && b) { return a ? 1 : 2; } else { throw b; } }\n}\nfunction f(x) { for (let i = 0; i < 3; i++) { x(); } do { x(); } while (x); }\nconst g = (p, q) => p + q; // end\n",
    "rs": "/* a\n b */\nfn f(a: u8, b: &str) -> u8 {\n    let c = |x, y| x + y;\n    match a { 1 => c(1, 2), _ => loop { break 3 } }\n}\nimpl T { fn g(&self) -> R { let v = h()?; while v { } Ok(v) } }\n",
    "c": "#include <a.h>\nint f(void);\nint g(int a, char *b) {\n  int s = 0;\n  for (int i = 0; i < a; i++) { if (a > 1 && b) { s += i; } else if (b) { s--; } }\n  switch (s) { case 1: break; default: s = 2; }\n  return s;\n}\n",
    "cs": 'class C {\n  int F(int a, string b) { foreach (var x in a) { if (x > 1) { return x; } } return 0; }\n  int P => 3;\n  void G() { var f = (int a) => a + 1; try { } catch (E e) { throw; } }\n}\n',
}


def counts(extension, text):
    rows = measure_text(text, BY_EXTENSION[extension])
    return rows[0][4], {r[0]: r for r in rows[1:]}


def test_go_counts_by_hand():
    file, units = counts("go", GO)
    assert set(units) == {"#Twice@6", "#Get@19"} and units["#Twice@6"][1:4] == ("fn", 6, 17) and units["#Get@19"][1] == "method"
    # The file, two functions, a closure; for, if, &&, ||; parameters share types.
    assert (file["spaces"], file["branches"], file["exits"], file["args"], file["closures"]) == (4, 4, 2, 3, 1)
    # for 1, if 2, && 1, || 1, else 1
    assert file["cognitive"] == 6 == units["#Twice@6"][4]["cognitive"]
    assert (file["span_sloc"], file["cloc"], file["blank"], file["sloc"]) == (19, 2, 3, 14)
    # import, f :=, return, for with i := and i++, if, Println, n--, return
    assert file["lloc"] == 10
    small, _ = counts("go", "package p\n\nfunc F(a int) int {\n\treturn a\n}\n")
    # package func ( { return; p F a int int a
    assert (small["eta1"], small["n1"], small["eta2"], small["n2"]) == (5, 5, 4, 6)


def test_other_languages():
    js, units = counts("js", CODE["js"])
    assert set(units) == {"#get@2", "#f@4"} and (js["closures"], js["args"], js["exits"]) == (1, 5, 2)
    assert js["branches"] == 1 + 1 + 1 + 1 + 1 and js["cognitive"] == (1 + 1 + 1) + (1 + 1) and js["cloc"] == 1
    rust, units = counts("rs", CODE["rs"])
    assert set(units) == {"#f@3", "#g@7"} and (rust["closures"], rust["args"], rust["exits"], rust["cloc"]) == (1, 5, 1, 2)
    assert rust["branches"] == 2 + 1 + 1 + 1 and units["#g@7"][4]["cognitive"] == 1
    c, units = counts("c", CODE["c"])
    assert set(units) == {"#g@3"} and (c["args"], c["exits"], c["branches"]) == (2, 1, 5) and c["cognitive"] == 1 + 2 + 1 + 1 + 1
    cs, units = counts("cs", CODE["cs"])
    assert set(units) == {"#F@2", "#G@4"} and (cs["closures"], cs["exits"], cs["branches"]) == (1, 3, 3)
    for d in DIALECTS:
        assert measure_text(None, d)[0][4]["sloc"] == 0 and measure_text(") } ] ( { '", d)[0][1] == "file"
        assert measure_text("x(" * 3000 + "{" * 3000, d)[0][4]["n1"] > 5000


FILES = [
    ("r", "go.mod", "module m.x\n"), ("r", "main.go", 'package main\n\nimport (\n\t"fmt"\n\t"m.x/a"\n)\n\nfunc main() {\n\tfmt.Println(a.F(1))\n}\n'), ("r", "a/a.go", "package a\n\nfunc F(n int) int {\n\tif n > 1 {\n\t\treturn n\n\t}\n\treturn 0\n}\n"),
    ("r", "p/x.py", "import p.y\n\ndef f():\n    return p.y\n"), ("r", "p/y.py", "import p.x\n"), ("r", "bad.py", "def ("), ("r", "n.c", None), ("r", None, "x"), ("r", "d.md", "# T\n[a](p/x.py)\n"), ("q", "s/i.ts", 'import x from "./j";\nexport const y = 1;\n'), ("q", "s/j.ts", "export default 1;\n"), ("q", "s/j.ts", ""),
]


def test_report_of_source_files(spark):
    df = spark.createDataFrame(FILES, "repo string, path string, text string")
    out = pipeline.report(df, ["repo"])
    nodes = {(r["repo"], r["id"]): r for r in out["nodes"].collect()}
    assert ("r", "ext:fmt") in nodes and nodes["r", "a/a.go"]["fan_in"] == 1 and nodes["r", "main.go"]["fan_out_external"] == 1
    assert nodes["r", "a/a.go"]["cyclomatic"] == 3 and nodes["r", "bad.py"]["sloc"] is None and nodes["r", "p/x.py"]["cycle"] == "mutual" and nodes["q", "s/j.ts"]["fan_in"] == 1
    assert {r["id"] for r in out["functions"].collect()} == {"main.go#main@8", "a/a.go#F@3", "p/x.py#f@3"}
    assert [r["size"] for r in out["cycles"].collect()] == [2] and [r["headings"] for r in out["pages"].collect()] == [1]
    hits = pipeline.check(df, ["repo"], limits={"cyclomatic": 2.0}, budgets={"mutual": 0}, checks=[CheckDef("c", "cloc < 1.0 && sloc > 8.0", "{name}", why="{name} is bare", fix="see {nothing}")])
    assert {(r["rule"], r["location"]) for r in hits.collect()} == {("threshold.file.cyclomatic", "a/a.go"), ("cycle.mutual", "p/x.py")}
    old = df.filter("path <> 'a/a.go'")
    assert {(r["rule"], r["status"]) for r in pipeline.check(df, ["repo"], limits={"cyclomatic": 2.0}, budgets={}, baseline=old).collect()} == {("threshold.file.cyclomatic", "new")}
    assert pipeline.report(df.limit(0), ["repo"])["nodes"].count() == 0


def test_languages(spark):
    df = spark.createDataFrame(FILES, "repo string, path string, text string")
    assert {r["source"] for r in pipeline.import_edges(df, ["repo"], ["py", "golang"]).collect()} == {"main.go", "p/x.py", "p/y.py"}
    with pytest.raises(ValueError, match="no such language: cobol"):
        pipeline.import_edges(df, ["repo"], ["cobol"])
    with pytest.raises(ValueError, match="claim .py"):
        pipeline.register(pipeline.Plugin("other", ("py",), pipeline.imports.python_imports))


def test_browsing(spark):
    nodes = spark.createDataFrame([("r", "a/b/x", "a/b/x", "X1", "file", "k", 3.0, 2.0, None), ("r", "a/b/c/y", "a/b/c/y", "y", "file", "k", None, 0.0, "chain"), ("r", "a/b/z", "a/b/z", "z", "file", "l", 5.0, 9.0, "chain"), ("r", "ext:e", None, "e", "external", None, None, None, None)], "repo string, id string, path string, name string, kind string, crate string, sloc double, hk double, cycle string").selectExpr("*", "false as external", "cast(0 as bigint) as items")
    edges = spark.createDataFrame([("r", "a/b/x", "a/b/z", "uses", 9), ("r", "a/b/x", "a/b/z", "uses", 4), ("r", "a/b/x", "a/b/z", "contains", 1), ("r", "a/b/x", "ext:e", "contains", 7), ("r", "a/b/z", "a/b/c/y", "uses", 1)], "repo string, source string, target string, kind string, line int")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(viewer.shown(nodes, "hk")) == ["a/b/x", "a/b/z"] and len(ids(viewer.shown(nodes, "cycle"))) == 2 and ids(viewer.search(nodes, " x")) == ["a/b/x"]
    assert viewer.local_graph(nodes, edges, ["repo"])[1].count() == 4
    assert ids(nodes.orderBy(viewer.sort_order("sloc", True), "id"))[:2] == ["a/b/z", "a/b/x"] and ids(nodes.orderBy(viewer.sort_order("sloc", False), "id"))[0] == "a/b/c/y"
    assert viewer.default_sort(["-hk", "+sloc"], {"sloc"}) == "sloc" and viewer.default_sort([], {"a"}) is None
    assert viewer.zero_match_hint(nodes, "a/q") == "no module matches 'a/q'; try 'a'" and viewer.zero_match_hint(nodes, "a/b") is None
    assert viewer.auto_focus(nodes, ["repo"]).first()["root"] == "a/b"
    lines = {(r["target"], r["line"]) for r in viewer.edge_lines(edges, ["repo"]).collect()}
    assert lines == {("a/b/z", 4), ("ext:e", 7), ("a/b/c/y", 1)}
    popup = {(r["side"], r["crate"], r["own"], r["n"]) for r in viewer.neighbour_popup(nodes, edges, ["repo"], nodes.filter("id = 'a/b/z'")).collect()}
    assert popup == {("in", "k", False, 1), ("out", "k", False, 1)}
    parts = spark.createDataFrame([("r", "a/b/x", "c"), ("r", "a/b/z", "c")], "repo string, id string, component string")
    diff = viewer.cycle_edges_diff((edges.limit(0), parts), (edges, parts), ["repo"])
    assert {(r["source"], r["target"], r["status"]) for r in diff.collect()} == {("a/b/x", "a/b/z", "current")}
    deltas = {(r["stat"]): (r["value"], r["delta"]) for r in viewer.summary_deltas(nodes.filter("id = 'a/b/x'"), nodes, ["repo"], ["sloc"]).collect()}
    assert deltas["sum"] == (8.0, 5.0) and deltas["p50"] == (4.0, 1.0)
    assert "| sloc | sum | 8 | +5 |" in advice.summary_markdown(viewer.summary_deltas(nodes.filter("id = 'a/b/x'"), nodes, ["repo"], ["sloc"]).collect())
    assert {(r["id"], r["tier"]) for r in advice.narrowed(nodes, ["repo"], "sloc", (2.0, 4.0), 5).collect()} == {("a/b/z", "warning"), ("a/b/x", "info")}
    folders = viewer.crates_of_folders(spark.createDataFrame([("r", "a/b/c"), ("r", "q")], "repo string, folder string"), spark.createDataFrame([("r", "k", "a"), ("r", "l", "a/b")], "repo string, crate string, root string"), ["repo"])
    assert {(r["folder"], r["crate"]) for r in folders.collect()} == {("a/b/c", "l"), ("q", None)}


def test_advice():
    assert advice.tiers({"sloc": (300.0, 600.0), "hk": (10.0, None), "x": (None, None)}, {"sloc": 250.0}) == {"hk": (None, 10.0), "sloc": (None, 250.0)}
    assert advice.auto_tier(0, 4) == ("info", 4) and advice.auto_tier(2, 4) == ("warning", 2) and advice.auto_tier(2, 4, "info") == ("info", 4)
    assert (advice.prompt_size(0), advice.prompt_size(5, 2), advice.prompt_size(5, 2, 9)) == (1, 2, 9)
    lenses = [Principle("size", "sloc")]
    assert advice.resolve_focus("size", lenses, ["hk"]) == ("principle", "size") and advice.resolve_focus("rules.HK", lenses, ["hk"]) == ("metric", "hk") and advice.resolve_focus("CYCLE", lenses, [])[0] == "cycle"
    with pytest.raises(ValueError, match="size, hk, cycle"):
        advice.resolve_focus("nope", lenses, ["hk"])
    assert advice.resolve_report_language(None, ["a"]) == "a" and advice.resolve_report_language("b", ["a", "b"]) == "b" and advice.resolve_report_language(None, ["a", "b"], ["b"]) == "b" and advice.resolve_report_language(None, ["a", "b"]) == "a"
    with pytest.raises(ValueError):
        advice.resolve_report_language(None, ["a", "b"], ["a", "b"])
    assert advice.rule_text("threshold.file.hk", {"threshold.file": {"why": "big in {lang}"}}, "go") == {"why": "big in go", "tune": "raise [rules.thresholds.file] hk = <limit>"}
    config = {"rules": {"cycles": {"mutual": 0, "chain": 1}}, "languages": {"go": {"rules": {"cycles": {"chain": 2}}}}}
    assert advice.rules_of(config, "go")["cycles"] == {"mutual": 0, "chain": 2} and advice.rules_of(config, "c") == config["rules"]
    assert advice.merge_maps([{"a": 1, "b": 2}, {"a": 3}]) == {"a": 3, "b": 2} and '"plugins"' in advice.export_config({"a": 1}, {"a": 2}, {"go": {}})
    assert advice.view({"columns": ["a", "b"], "size": "sloc"}, {"columns": {"remove": ["a"], "add": ["c"]}, "size": "hk"}) == {"columns": ["b", "c"], "size": "hk"}
    spec = advice.specs([Metric("hk", "f")], {"hk": {"label": "HK"}}, "docs/", "go")["hk"]
    assert spec["label"] == "HK" and spec["doc_url"] == "docs/go/hk.md" and advice.pruned({"a": 1, "b": 2}, ["b"]) == {"b": 2}


def test_modules_and_crates(spark):
    edges = spark.createDataFrame([("r", "m1", "m2", "uses", 3), ("r", "m1", "m3", "uses", 5), ("r", "m2", "m3", "uses", 2), ("r", "k1", "k2", "uses", 1)], "repo string, source string, target string, kind string, line int")
    homes = spark.createDataFrame([("r", "m1", "f1"), ("r", "m2", "f1"), ("r", "m3", "f2")], "repo string, id string, file string")
    crates = spark.createDataFrame([("r", "k1"), ("r", "k2")], "repo string, id string")
    assert [tuple(r) for r in advice.collapse(edges, homes, ["repo"], crates).collect()] == [("r", "f1", "f2", "uses", 2)]
    files = spark.createDataFrame([("r", "k", "src/main.rs"), ("r", "k", "src/lib.rs"), ("r", "l", "b.rs"), ("r", "l", "a.rs")], "repo string, crate string, path string")
    assert {tuple(r) for r in advice.root_files(files, ["repo"]).collect()} == {("r", "k", "src/lib.rs"), ("r", "l", "a.rs")}
    modules = spark.createDataFrame([("r", "a", "f", 3), ("r", "b", "f", None), ("r", "c", "g", 7), ("r", "d", "g", 2)], "repo string, id string, path string, line int")
    assert {r["id"] for r in advice.file_backed(modules, ["repo"]).collect()} == {"b", "d"}
    sums = advice.roll_up(spark.createDataFrame([("r", "p", 2), ("r", "p", None), ("r", None, 9)], "repo string, parent string, loc int"), ["repo"])
    assert [tuple(r) for r in sums.collect()] == [("r", "p", 2)]
    facts = advice.facts(spark.createDataFrame([("r", "b", None), ("r", "a", None), ("r", "a", None)], "repo string, x string, y string"), ["repo"], ["x", "y"])
    assert [tuple(r) for r in facts.collect()] == [("r", "a,b", None)]
