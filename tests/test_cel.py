import pytest
from pyspark.sql import functions as F

from lodegraph.functions.cel import CelError, compile_check, compile_metric, expand_defs, parse, topological
from lodegraph.functions.cel.compiler import Typed
from lodegraph.functions.numeric import abbreviated, exact_log2, parse_number, truncated
from lodegraph.functions.paths import glob_regex, normalized, parts, relativized


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(7, 2.5, "src/a.py", True, ["x", "ext:y"], None, 0)], "i bigint, d double, s string, b boolean, l array<string>, n double, z bigint")


SCOPE = {"i": "int", "d": "float", "s": "text", "b": "bool", "l": "list", "n": "float", "z": "int"}


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("i / 2 == 3", True), ("-i / 2 == -3", True), ("i % 4 == 3", True), ("i / z == 1", False), ("i / z == 1 || b", True), ("i / z == 1 && b", False), ("d / 2.0 == 1.25", True), ("i > 6.5", True),
        ("s.contains('a.') && s.endsWith('.py') && s.startsWith('src')", True), ("s.matches('^a')", False), ("matches(s, 'a.py$')", True), ("s.matches('(')", False), ("size(s) == 8", True), ("'é'.size() == 2", True),
        ("l.exists(x, x == 'ext:y')", True), ("l.all(x, x.size() > 0)", True), ("l.exists_one(x, x.startsWith('ext'))", True), ("l.filter(x, x != 'x').size() == 1", True), ("l.map(x, x + '!')[0] == 'x!'", True), ("'x' in l", True), ("l[5] == 'x'", False),
        ("n > 1.0", False), ("!(n > 1.0)", False), ("has(n)", False), ("has(nothing)", False), ("b ? i > 1 : d > 9.0", True), ("[1, 2, 3].max() == 3", True), ("max2(i, d) == 7.0", True), ("double('2.5') == d", True), ("int(2.9) == 2", True), ("string(i) == '7'", True),
        ("{'k': 1}.k == 1", True), ("'k' in {'k': 1}", True), ("s == 3", False), ("s != 3", True), ("i + 1 // comment", False), ("true && !false", True), ("0x10 == 16", True), ("r'\\d' == '\\\\d'", True),
    ],
)
def test_checks(row, source, expected):
    scope = {k: Typed(F.col(k), v) for k, v in SCOPE.items()}
    assert row.select(compile_check(source, scope)).first()[0] is expected


@pytest.mark.parametrize("source", ["1 +", "foo(1)", "i +", "s > 1", "missing", "i ? 1 : 2", "(1", "l.what(x, x)", "i.x", "'a", "#"])
def test_what_cant_be_compiled(source):
    with pytest.raises(CelError):
        compile_check(source, {k: Typed(F.lit(None), v) for k, v in SCOPE.items()})


@pytest.mark.parametrize(("source", "expected"), [("pow(i, 2.0) + 1", 50.0), ("i / 2", 3.5), ("ln(0.0 * i)", None), ("n + 1.0", None), ("log2(8)", 3.0), ("i / 0.0", None), ("min2(i, d)", 2.5), ("abs(-i) + sqrt(16)", 11.0), ("n > 0.0 ? 1.0 : 2.0", None)])
def test_metrics(row, source, expected):
    assert row.select(compile_metric(source, {k: F.col(k) for k in ("i", "d", "n")})).first()[0] == expected


def test_macros_and_order():
    assert expand_defs("big && 'big' == s", {"big": "x > lim", "lim": "3"}) == "(x > (3)) && 'big' == s"
    with pytest.raises(CelError):
        expand_defs("a", {"a": "b", "b": "a"})
    order = topological({"double_len": "length * 2.0", "length": "n1 + n2"})
    assert order.index("length") < order.index("double_len")
    with pytest.raises(CelError):
        topological({"a": "b", "b": "a"})
    assert parse("a.b(c)[0]").kind == "index"


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (87.69999999999999, -1.2345, 0.00123456, 0.0, None, float("inf"), float("nan"), 2666.0)], "x double")
    assert [r[0] for r in df.select(truncated(F.col("x"))).collect()] == [87.699, -1.234, 0.00123, 0.0, 0.0, 0.0, 0.0, 2666.0]
    powers = spark.range(1, 62).select(exact_log2(F.pow(F.lit(2.0), F.col("id"))).alias("l"), "id").collect()
    assert all(r["l"] == r["id"] for r in powers)
    shown = spark.createDataFrame([(x,) for x in (999.0, 1200.0, 3400000.0, 2.5, 7e9)], "x double").select(abbreviated(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["999", "1.2K", "3.4M", "2.5", "7B"]
    assert [parse_number(t) for t in ("1_000", "2.5K", "3M", 4)] == [1000.0, 2500.0, 3e6, 4.0]


def test_paths(spark):
    one = spark.createDataFrame([("a/b/.hidden",), ("x.tar.gz",), ("/work/deep/y",)], "p string")
    split = [tuple(r) for r in one.select(*parts(F.col("p")).values()).collect()]
    assert split[0] == (".hidden", ".hidden", "", "a/b") and split[1] == ("x.tar.gz", "x.tar", "gz", "")
    assert [r[0] for r in one.select(relativized(F.col("p"), {"t": "/work", "d": "/work/deep/"})).collect()] == ["a/b/.hidden", "x.tar.gz", "{d}/y"]
    assert one.select(normalized(F.lit("a/./b/../../c//d"))).first()[0] == "c/d"
    import re

    assert re.match(glob_regex("**/*.{py,rs}"), "a/b.rs") and not re.match(glob_regex("a?c"), "abbc") and re.match(glob_regex("[!x]*"), "yz")
