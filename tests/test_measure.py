from pyspark.sql import functions as F

from lodegraph.operators import levels
from lodegraph.operators.metrics import derive, emitted
from lodegraph.sources.measure import measure_python, measure_text

TEXT = '''"""Doc."""
# note
import os


def f(a, b=1, *c):
    """Inner doc."""
    if a and b or c:  # why
        for x in c:
            if x: return x
    elif b:
        pass
    else:
        raise ValueError
    return lambda y: y if y else a
'''


def test_counts():
    file, function = measure_text(TEXT)
    assert function[:4] == ("#f@6", "fn", 6, 15) and file[1:4] == ("file", 1, 15)
    counts = file[4]
    assert (counts["spaces"], counts["args"], counts["closures"], counts["exits"]) == (2, 4, 1, 3)
    assert counts["branches"] == 3 + 1 + 1 + 2  # if, elif, inner if; for; ternary; and, or
    assert counts["cloc"] == 4 and counts["blank"] == 2 and counts["sloc"] == 10 and counts["span_sloc"] == 15
    # if 1, and/or 2, for 2, inner if 3, elif 1, else 1, ternary in a lambda 2
    assert counts["cognitive"] == 12
    assert measure_text("def (") == [] and measure_text(None)[0][4]["sloc"] == 0


def test_table_of_files_and_functions(spark):
    df = spark.createDataFrame([("r", "a.py", TEXT), ("r", "b.py", None), (None, "c.py", "def ("), ("r", "d.py", "")], "repo string, id string, text string")
    rows = measure_python(df, ["repo"])
    got = {r["id"]: r for r in emitted(derive(rows)).collect()}
    assert set(got) == {"a.py", "a.py#f@6", "b.py", "d.py"} and got["a.py#f@6"]["parent"] == "a.py"
    assert got["a.py"]["cyclomatic"] == 9 and got["a.py"]["volume"] > 0 and got["b.py"]["volume"] is None
    files, functions = levels.split_functions(rows)
    assert functions.count() == 1 == levels.with_parent(functions, files, ["repo"]).count()
    assert levels.with_parent(functions, files.filter("id <> 'a.py'"), ["repo"]).count() == 0
    assert measure_python(df.limit(0), ["repo"]).count() == 0


def test_reachable_and_dropped_crates(spark):
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "d", "e")], "g string, source string, target string")
    starts = spark.createDataFrame([("g", "a")], "g string, id string")
    assert {r["id"] for r in levels.reachable(starts, edges, ["g"]).collect()} == {"a", "b", "c"}
    assert levels.reachable(starts.limit(0), edges, ["g"]).count() == 0
    nodes = spark.createDataFrame([("g", "x", "file", "a"), ("g", "y", "file", "d"), ("g", "z", "file", None), ("g", "ext:e@1", "external", None), ("g", "ext:c@1", "external", None)], "g string, id string, kind string, crate string").withColumn("external", F.lit(None).cast("boolean"))
    use = spark.createDataFrame([("g", "x", "y"), ("g", "x", "z")], "g string, source string, target string")
    kept, left = levels.drop_unreachable(nodes, use, starts, edges, ["g"])
    assert {r["id"] for r in kept.collect()} == {"x", "z", "ext:c@1"} and [(r["source"], r["target"]) for r in left.collect()] == [("x", "z")]


def test_what_is_in_use(spark):
    df = spark.createDataFrame([("g", "{target}/a", 1, None), ("g", "{reg}/b", None, None), ("g", "ext:x", 2, None)], "g string, id string, a int, b int")
    assert {r["column"]: r["rows"] for r in levels.present_columns(df, ["g"], ["a", "b"]).collect()} == {"a": 2, "b": 0}
    assert {r["root"] for r in levels.used_roots(df, ["g"]).collect()} == {"target", "reg"}
