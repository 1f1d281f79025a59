import json

from lodegraph.operators.drift import _matching, read_drifting, unified_records

SCHEMA = "feed_id bigint, file_no int, entity string, payload string, ingested_at int, field string, change string"


def run(spark, files, feed=1, noise=()):
    rows = [(feed, n, e, p if isinstance(p, str) or p is None else json.dumps(p), 1, "", "") for n, recs in files.items() for e, p in recs.items()]
    df = spark.createDataFrame([*rows, *noise], SCHEMA)
    changes, values = read_drifting(df)
    return {(r["file_no"], r["change"], r["field"], r["old_field"]) for r in changes.collect()}, values


def test_all_kinds_of_change(spark):
    one = {f"e{i}": {"ms": i, "deep": {"x": f"v{i}"}, "gone": True, "kind": i} for i in range(6)}
    two = {f"e{i}": {"millis": float(i), "deep": {"x": f"v{i}"}, "new": [1], "kind": f"{i}"} for i in range(6)}
    got, values = run(spark, {1: one, 3: two})
    assert got == {(3, "renamed", "millis", "ms"), (3, "added", "new", "new"), (3, "removed", "gone", "gone"), (3, "type_changed", "kind", "kind")}
    unified = {(r["file_no"], r["field"], r["unified"]) for r in values.collect()}
    assert (3, "millis", "ms") in unified and (1, "ms", "ms") in unified and (3, "deep.x", "deep.x") in unified


def test_renames_need_two_thirds_of_common_entities(spark):
    one = {f"e{i}": {"a": f"v{i}"} for i in range(6)} | {"only": {"a": "q"}}
    got, _ = run(spark, {1: one, 2: {f"e{i}": {"b": f"v{i}" if i < 4 else "other"} for i in range(6)}})
    assert got == {(2, "renamed", "b", "a")}
    got, _ = run(spark, {1: one, 2: {f"e{i}": {"b": f"v{i}" if i < 3 else "other"} for i in range(6)}})
    assert got == {(2, "added", "b", "b"), (2, "removed", "a", "a")}


def test_chain_of_renames_keeps_the_first_name(spark):
    files = {n: {f"e{i}": {name: f"v{i}"} for i in range(4)} for n, name in ((1, "a"), (2, "b"), (3, "c"), (4, "c"))}
    got, values = run(spark, files)
    assert got == {(2, "renamed", "b", "a"), (3, "renamed", "c", "b")}
    assert {r["unified"] for r in values.collect()} == {"a"}


def test_matching_takes_each_field_once(spark):
    one = {f"e{i}": {"size": 5, "count": 5} for i in range(4)}
    got, _ = run(spark, {1: one, 2: {f"e{i}": {"sizes": 5, "counts": 5} for i in range(4)}})
    assert got == {(2, "renamed", "sizes", "size"), (2, "renamed", "counts", "count")}


def test_dirty_rows(spark):
    noise = [(None, 1, "e", "{}", 1, "", ""), (2, None, "e", "{}", 1, "", ""), (2, 1, None, '{"a": 1}', 1, "", ""), (2, 2, None, "no json", 1, "", ""), (2, 2, "x", None, None, "", ""), (2, 2, "x", "[1]", None, "", "")]
    got, _ = run(spark, {1: {"e": {"a": 1, "b": None, "c": {}}}, 2: {"e": '{"a": 2}'}}, noise=noise)
    assert got == {(2, "removed", "a", "a")}  # of feed 2
    assert run(spark, {})[0] == set()


def test_deep_payloads(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}
    assert {r["field"] for r in run(spark, {1: {"e": deep}})[1].collect()} == {"a.b.c.d.e.f"}


def test_matching_is_the_heaviest():
    import pandas as pd

    rows = [("x", "p", 1.0), ("x", "q", 0.9), ("y", "p", 0.95)]
    out = _matching(pd.DataFrame([(1, 2, o, n, w, 2) for o, n, w in rows], columns=["feed", "file", "old", "new", "weight", "crowd"]))
    assert set(zip(out["old"], out["new"], strict=True)) == {("x", "q"), ("y", "p")}


def test_few_common_entities_in_large_files(spark):
    for seed in range(3):
        one = {f"e{i}": {"a": f"v{seed}{i}"} for i in range(20_000)}
        got, _ = run(spark, {1: one, 2: {f"e{i}": {"zzz": f"v{seed}{i}"} for i in range(3)}})
        assert got == {(2, "renamed", "zzz", "a")}


def test_a_field_between_two_renames_counts_the_entities_of_each_step(spark):
    one = {f"e{i}": {"a": f"v{i}"} for i in range(4)}
    two = {f"e{i}": {"b": f"v{i}"} for i in range(8)}
    got, _ = run(spark, {1: one, 2: two, 3: {f"e{i}": {"c": f"v{i}" if i > 5 else "q"} for i in range(4, 8)}})
    assert got == {(2, "renamed", "b", "a"), (3, "added", "c", "c"), (3, "removed", "b", "b")}


def test_large_whole_numbers_are_told_apart(spark):
    one = {f"e{i}": {"a": 2**53 + 2 * i} for i in range(4)}
    got, _ = run(spark, {1: one, 2: {f"e{i}": {"b": 2**53 + 2 * i + 1} for i in range(4)}})
    assert got == {(2, "added", "b", "b"), (2, "removed", "a", "a")}
    got, _ = run(spark, {1: one, 2: {f"e{i}": {"b": 2**53 + 2 * i} for i in range(4)}})
    assert got == {(2, "renamed", "b", "a")}


def test_a_name_given_to_another_field_is_told_apart(spark):
    one = {f"e{i}": {"a": f"v{i}"} for i in range(4)}
    two = {f"e{i}": {"b": f"v{i}"} for i in range(4)}
    three = {f"e{i}": {"b": f"v{i}", "a": i} for i in range(4)}
    _, values = run(spark, {1: one, 2: two, 3: three})
    assert {(r["file_no"], r["field"], r["unified"]) for r in values.collect()} == {(1, "a", "a"), (2, "b", "a"), (3, "b", "a"), (3, "a", "a@3")}


def test_unified_records_have_one_type_per_field(spark):
    files = {1: {"e": {"a": 1, "t": "x\"y", "l": [1], "ok": True}}, 2: {"e": {"a": "1", "t": "z", "l": [2], "ok": False, "d": {"n": 2}}}}
    _, values = run(spark, files)
    records, fields = unified_records(values, spark.createDataFrame([(1, "k"), (2, "other")], "feed_id bigint, record_kind string"))
    got = {r["file_no"]: json.loads(r["record"]) for r in records.collect()}
    assert got == {1: {"a": "1.0", "t": 'x"y', "l": [1], "ok": True}, 2: {"a": "1", "t": "z", "l": [2], "ok": False, "d.n": 2}}
    assert {(r["field"], r["type"]) for r in fields.collect()} == {("a", "string"), ("t", "string"), ("l", "array"), ("ok", "boolean"), ("d.n", "number")}
    assert {r["clashes"] for r in records.collect()} == {0}
