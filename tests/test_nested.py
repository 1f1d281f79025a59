import json

from lodegraph.operators.nested import flat_tables

SCHEMA = "snap_id bigint, payload string, ingested_at int, node string, language string"


def tables(spark, *payloads):
    df = spark.createDataFrame([(i, p if isinstance(p, str) or p is None else json.dumps(p), 1, "", "") for i, p in enumerate(payloads)], SCHEMA)
    return flat_tables(df)


GRAPH = {"nodes": [{"id": "a", "loc": 3.0, "x": 7}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "kind": "uses", "line": 2}], "cycles": [{"kind": "mutual", "nodes": ["a", "b"]}]}


def test_maps_lists_and_bare_values_read_alike(spark):
    new = {"git": {"commit": "c1", "dirty_files": 2}, "languages": {"rust": {"graphs": {"files": GRAPH}, "principles": [{"id": "P", "connections": ["Q"]}]}}}
    old = {"git": {"commit": "c1", "dirty_files": 2}, "languages": [{"name": "rust", "graphs": [GRAPH | {"level": "files"}], "principles": {"id": "P", "connections": "Q"}}]}
    bare = {"git": {"commit": "c1", "dirty_files": 2}, "languages": {"name": "rust", "graphs": GRAPH | {"level": "files"}, "principles": {"id": "P", "connections": "Q"}}}
    found = tables(spark, new, old, bare, json.dumps(json.dumps(new)))
    for name, df in found.items():
        rows = {}
        for r in df.collect():
            rows.setdefault(r["snap_id"], []).append(str(r)[len("Row(snap_id=0") :])
        if rows:
            assert len({tuple(sorted(v)) for v in rows.values()}) == 1 and len(rows) == 4, name
    node = found["node"].filter("snap_id = 0 and place = 0").first()
    assert (node["node"], node["loc"], node["attributes"]) == ("a", 3.0, {"x": "7"})
    assert found["cycle_node"].filter("snap_id = 1").select("cycle_no", "place", "node").collect()[1][:] == (0, 1, "b")
    assert found["edge"].first()["line"] == 2


def test_absent_null_empty_and_unreadable_parts(spark):
    found = tables(spark, {}, {"languages": None, "git": None}, {"languages": {"go": {"graphs": None, "principles": []}}}, "no", None, "[1]", '"text"', {"languages": [{"graphs": {}}, None, 3]})
    assert {k: df.count() for k, df in found.items() if df.count()} == {"language": 1}


def test_a_redelivery_counts_once(spark):
    payload = json.dumps({"git": {"commit": "x"}})
    df = spark.createDataFrame([(1, payload, 1, "", ""), (1, payload, 2, "", ""), (None, payload, 1, "", "")], SCHEMA)
    assert flat_tables(df)["git"].count() == 2
    assert flat_tables(spark.createDataFrame([], SCHEMA))["node"].count() == 0
