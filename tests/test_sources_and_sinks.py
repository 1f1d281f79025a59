import json
import subprocess

import pytest

from lodegraph.sinks import writers
from lodegraph.sources import config, files, imports, markdown, reports
from lodegraph.streaming import current, upsert_latest

FILES = "g string, path string, text string"


def table(spark, **texts):
    return spark.createDataFrame([("r", k.replace("__", "/").replace("_D_", "."), v) for k, v in texts.items()], FILES)


def edges(df):
    return {(r["source"], r["target"], r["kind"], r["line"]) for r in df.collect()}


def test_python_imports(spark):
    t = spark.createDataFrame([("r", "p/__init__.py", ""), ("r", "p/a.py", "import os, p.b\nfrom . import c as d\nfrom .q.e import x\nfrom .missing import y\n"), ("r", "p/b.py", "from p import a\n"), ("r", "p/c.py", None), ("r", "p/q/e.py", "from ..b import *\nimport numpy.linalg as la")], FILES)
    assert edges(imports.python_imports(t, ["g"])) == {("p/a.py", "ext:os", "uses", 1), ("p/a.py", "p/b.py", "uses", 1), ("p/a.py", "p/c.py", "uses", 2), ("p/a.py", "p/q/e.py", "uses", 3), ("p/b.py", "p/a.py", "uses", 1), ("p/q/e.py", "p/b.py", "uses", 1), ("p/q/e.py", "ext:numpy", "uses", 2)}


def test_script_go_c_csharp_imports(spark):
    t = spark.createDataFrame([("r", "s/a.ts", 'import { x } from "./b";\nexport * from "../t";\nconst y = require("@s/p/z");\nimport "react";\n// import "no"\n'), ("r", "s/b.js", ""), ("r", "t/index.ts", "")], FILES)
    assert edges(imports.script_imports(t, ["g"])) == {("s/a.ts", "s/b.js", "uses", 1), ("s/a.ts", "t/index.ts", "uses", 2), ("s/a.ts", "ext:@s/p", "uses", 3), ("s/a.ts", "ext:react", "uses", 4)}
    t = spark.createDataFrame([("r", "main.go", 'package main\nimport (\n\t"fmt"\n\tu "m.x/util"\n)\n'), ("r", "util/a.go", ""), ("r", "util/b.go", ""), ("r", "util/a_test.go", "")], FILES)
    assert edges(imports.go_imports(t, ["g"], "m.x")) == {("main.go", "ext:fmt", "uses", 3), ("main.go", "util/a.go", "uses", 4), ("main.go", "util/b.go", "uses", 4)}
    t = spark.createDataFrame([("r", "src/a.c", '#include "a.h"\n#include "inc/b.h"\n#include <c.h>\n#include "d.h"\n'), ("r", "src/a.h", ""), ("r", "inc/b.h", ""), ("r", "x/c.h", ""), ("r", "y/d.h", ""), ("r", "z/d.h", "")], FILES)
    assert edges(imports.c_includes(t, ["g"])) == {("src/a.c", "src/a.h", "uses", 1), ("src/a.c", "inc/b.h", "uses", 2), ("src/a.c", "x/c.h", "uses", 3), ("src/a.c", "ext:d.h", "uses", 4)}
    t = spark.createDataFrame([("r", "a.cs", "using System;\nusing A.B;\nnamespace C;\n"), ("r", "b.cs", "namespace A.B { }\n"), ("r", "c.cs", "namespace A.B;\nusing C;")], FILES)
    assert edges(imports.csharp_usings(t, ["g"])) == {("a.cs", "ext:System", "uses", 1), ("a.cs", "b.cs", "uses", 2), ("a.cs", "c.cs", "uses", 2), ("c.cs", "a.cs", "uses", 2)}


def test_statements_over_lines(spark):
    assert imports.python_statements("from x import (\n  a,\n  b as c)\ns = 'import no'\nif 1:\n    import d.e, f\n") == [(1, "x", "a", 0), (1, "x", "b", 0), (6, "d.e", "", 0), (6, "f", "", 0)]
    assert imports.python_statements("import a\nfrom .b import c\n(") == [(1, "a", "", 0), (2, "b", "c", 1)] and imports.python_statements(None) == []
    script = 'import {\n  a,\n} from "./a";\nconst s = "from \'no\'"; // require("no")\nexport {\n b } from "b"\nx.require("no"); /* import "no" */ const y = await import("lazy"), z = `require("no")`;\n'
    assert imports.script_specifiers(script) == [(1, "./a"), (5, "b"), (7, "lazy")] and imports.script_specifiers(None) == []
    assert imports.use_paths("a::{b::{c,d::{e,f::{g,h::{i}}}},self}") == ["a::b::c", "a::b::d::e", "a::b::d::f::g", "a::b::d::f::h::i", "a::self"] and imports.use_paths("*") == []
    t = spark.createDataFrame([("r", "m/go.mod", "module m.x/y\n\ngo 1.22\n"), ("r", "m/a.go", 'import "m.x/y/util"\nimport "m.x/yz"\n'), ("r", "m/util/b.go", "")], FILES)
    assert edges(imports.go_imports(t, ["g"])) == {("m/a.go", "m/util/b.go", "uses", 1), ("m/a.go", "ext:m.x/yz", "uses", 2)} == edges(imports.extract_all(t, ["g"]))


def test_rust_uses(spark):
    t = spark.createDataFrame([("r", "k/src/lib.rs", "pub use crate::a::Thing;\nuse std::{fmt, io::{self, Read}};\n"), ("r", "k/src/a.rs", "use super::b::{c::X, Y};\nuse crate::*;\n"), ("r", "k/src/b/mod.rs", "use self::c::Z; // use crate::a;\n"), ("r", "k/src/b/c.rs", "")], FILES)
    assert edges(imports.rust_uses(t, ["g"])) == {("k/src/lib.rs", "k/src/a.rs", "reexports", None), ("k/src/lib.rs", "ext:std", "uses", None), ("k/src/a.rs", "k/src/b/c.rs", "uses", None), ("k/src/a.rs", "k/src/b/mod.rs", "uses", None), ("k/src/a.rs", "k/src/lib.rs", "super", None), ("k/src/b/mod.rs", "k/src/b/c.rs", "uses", None)}
    assert imports.extract_all(t, ["g"]).count() == 6
    assert imports.line_counts(t.filter("path like '%/mod.rs'"), ["g"]).first()[2:] == (2, 1, 0)


def test_markdown(spark):
    text = "# A\n\n```\n# no\n[x](y)\n```\n## B [l](c.md) ![i](p.png) [e](https://x.test/a)\n[bad](gone.md#p) [top](#a) [img](../z.png)"
    t = spark.createDataFrame([("r", "d/a.md", text), ("r", "d/c.md", None), ("r", "z.png", "")], FILES)
    got = {r["path"]: tuple(r)[1:] for r in markdown.measure(t, "path", "text").collect()}
    assert got["d/a.md"] == (2, 2, 2, 5) and got["d/c.md"] == (0, 0, 0, 0)
    links = {r["link"]: r["kind"] for r in markdown.classify_links(t, ["g"], "path", "text").collect()}
    assert links == {"y": "broken", "c.md": "doc", "https://x.test/a": "external", "gone.md#p": "broken", "#a": "local", "../z.png": "local"}


def test_config(tmp_path):
    assert config.patch_list(["a", "b", "c"], {"remove": ["b"], "after": {"a": ["x"]}, "before": {"gone": ["y"]}, "prepend": ["p"], "add": ["a", "z"], "replace": {"c": "C"}}) == ["p", "a", "x", "C", "z"]
    assert config.patch_list(["a", "b"], {"clear": True, "add": ["c", "c"]}) == ["c"] and config.patch_list(["a"], ["b"]) == ["b"]
    with pytest.raises(ValueError):
        config.patch_list([], {"push": [1]})
    f = tmp_path / "c.toml"
    f.write_text('version = "5.0"\n[rules.thresholds]\nsloc = "1K"\n[report]\ncolumns = { add = ["x"] }\n')
    got = config.load([f], {"report": {"columns": ["a"]}, "rules": {"thresholds": {"hk": 1}}}, ["rules.thresholds.hk=5", "ignore=all"])
    assert got["report"]["columns"] == ["a", "x"] and config.limits(got["rules"]["thresholds"], {"sloc", "hk"}) == {"hk": 5.0, "sloc": 1000.0} and got["ignore"] == "all"
    f.write_text("[other]\n")
    with pytest.raises(ValueError):
        config.load([f])
    with pytest.raises(ValueError):
        config.limits({"nope": 1}, {"sloc"})
    with pytest.raises(ValueError):
        config.unique_extensions({"a": ["x"], "b": ["x"]})
    assert config.resolve_languages([], [], ["b", "a"], {}) == ["a", "b"] and config.resolve_languages(["py"], ["go"], [], {"python": ["py"]}) == ["python"]
    assert config.blob_url("git@host.test:a/b.git", "c1", "x.py", 3) == "https://host.test/a/b/blob/c1/x.py#L3"
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert config.git_state(str(tmp_path)) is None and config.git_state("/", {"branch": "m", "commit": "c", "dirty_files": 0})["commit"] == "c"


def test_reports_from_files(spark, tmp_path):
    report = {"schema_version": "5.0", "git": {"commit": "abc"}, "languages": {"go": {"graphs": {"files": {"nodes": [{"id": "</x>"}]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(report))
    (tmp_path / "b.html").write_text(writers.html_report(json.dumps(report), "{}"))
    got = reports.tables(spark, str(tmp_path))
    assert [r["node"] for r in got["node"].collect()] == ["</x>", "</x>"] and got["git"].count() == 2
    assert reports.check_version(json.dumps(report))["git"] and reports.is_report("x.HTM") and not reports.is_report("src")
    with pytest.raises(ValueError):
        reports.check_version('{"schema_version": "4"}')


def test_walk(spark, tmp_path):
    for name in ("a.py", "d/b.py", "skip/c.py", ".git/d.py", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert {r["path"] for r in files.walk(spark, str(tmp_path), ["py"], skip_dirs=["skip"]).collect()} == {"a.py", "d/b.py"}
    assert files.has_marker(spark, str(tmp_path), ["no", "e.txt"]) and not files.has_marker(spark, str(tmp_path), ["no"])


def test_documents(spark, tmp_path):
    rows = [("threshold.file.sloc", "SIZ", "a.py", None, "sloc 7 > 3", 2.3, None, "split"), ("check.x", "LNT", "b.py", 4, "bad", float("inf"), "since", None), ("check.x", "LNT", "c.py", 1, "bad", 1.0, None, None)]
    v = spark.createDataFrame(rows, "rule string, rule_group string, location string, line int, message string, weight double, why string, fix string")
    doc = json.loads(writers.sarif(v, language="py"))["runs"][0]
    assert [r["id"] for r in doc["tool"]["driver"]["rules"]] == ["check.x", "threshold.file.sloc"] and len(doc["results"]) == 3
    assert doc["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 4 and doc["results"][1]["partialFingerprints"]["signature"] == "py:threshold.file.sloc:a.py"
    assert all(i["severity"] == "major" for i in json.loads(writers.code_quality(v)))
    assert writers.diagnostics(v, "github").splitlines()[0] == "::warning file=b.py,line=4,title=check.x::bad"
    assert writers.diagnostics(v, "human", 1).count("\n") == 0 and json.loads(writers.diagnostics(v, "json"))[0]["weight"] is None
    assert "split" in writers.diagnostics(v, "prompt")
    writers.write_findings(v, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert writers.file_name("{project-dir}-{git-hash-4}.json", project="my app!", commit="abcdef") == "my-app-abcd.json"
    assert writers.formats({}, {}, {}) == ["json", "html"] and writers.formats({"sarif": True}, {"json": "x"}, {}) == ["json", "sarif"]
    n, e = spark.createDataFrame([("g", "b", 1), ("g", "a", 2)], "g string, id string, x int"), spark.createDataFrame([("g", "a", "b", "uses")], "g string, source string, target string, kind string")
    assert [json.loads(r["json"]).get("id") for r in writers.canonical_graph(n, e, ["g"]).collect()] == ["a", "b", None]


def test_stream_keeps_the_latest(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "table")
    for part in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")]):
        spark.createDataFrame(part, "k int, t int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, t int, v string").parquet(source)
        upsert_latest(stream, ["k"], "t", out, str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in current(spark, out).collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
