import random

from lodegraph.operators.hierarchy import descendants, resolve_hierarchy


def brute(rows):
    parent = {}
    for i, p, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if i is not None:
            parent.setdefault(i, p)
    out = {}
    for i in parent:
        path, x, seen = [i], i, {i}
        while parent[x] is not None and parent[x] in parent:
            x = parent[x]
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
        out[i] = path[::-1] if path else None
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, parent bigint, name string, root string, depth string")
    expected = brute(rows)
    got = resolve_hierarchy(df, name="name", lineage=True)
    result = {r["id"]: r for r in got.collect()}
    assert result.keys() == expected.keys()
    below = {}
    for path in expected.values():
        for x in (path or [])[:-1]:
            below[x] = below.get(x, 0) + 1
    names = {r[0]: r[2] or "" for r in rows}
    for i, path in expected.items():
        r = result[i]
        assert r["rooted"] == (path is not None), i
        if path is None:
            assert r["root"] is None and r["depth"] is None and r["path"] is None and r["n_descendants"] is None
        else:
            assert (r["root"], r["depth"], r["lineage"], r["n_descendants"]) == (path[0], len(path) - 1, path, below.get(i, 0))
            assert r["path"] == "/".join(names[x] for x in path)
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendants(got).collect()}
    assert pairs == {(x, p[-1], len(p) - 1 - k) for p in expected.values() if p for k, x in enumerate(p[:-1])}


def test_chain_loop_forest_and_hub(spark):
    rows = [(i, i - 1 if i else None, f"n{i}", "", "") for i in range(120)]  # a deep chain
    rows += [(200 + i, 200 + (i + 1) % 7, "loop", "", "") for i in range(7)]  # a loop
    rows += [(300, 203, "below", "", ""), (301, 300, "deeper", "", ""), (302, 302, "self", "", ""), (303, 302, None, "", "")]
    rows += [(400 + i, 400 if i else 99999, "hub", "", "") for i in range(60)]  # an unknown parent, and a hub
    check(spark, rows)


def test_random_forest(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.randrange(300), i - 1, i - 1, i - 1]), None, "", "") for i in range(300)]
    rows = [(i, p, f"x{i % 5}", "", "") for i, p, *_ in rows]
    check(spark, rows)


def test_nulls_repeats_and_empty(spark):
    check(spark, [(1, None, "a", "", ""), (1, None, "a", "", ""), (2, 1, "b", "", ""), (2, 1, "b", "", ""), (None, 1, "lost", "", "")])
    check(spark, [])
