import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm.leakage import leaked_items, leaked_passages, shingle_similarity, words_of
from lodegraph.llm.lookalike import canonical_texts, lookalike_pairs
from lodegraph.llm.mixing import capped_mean, mix_sources, plan_rates, poisson_mean

WORDS = [f"w{i}" for i in range(60)]


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    return {tuple(r) for r in leaked_items(d, q, **more).collect()}


def brute_leaks(docs, items, passage=15):
    out = set()
    for i, item in items:
        w = words_of(item)
        n = min(passage, len(w))
        wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            t = words_of(text)
            if any(tuple(t[k : k + n]) in wanted for k in range(len(t) - n + 1)) and n:
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 14, 15, 16, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "?!")]
    docs = []
    for d in range(120):
        body = rng.choices(WORDS, k=rng.choice([0, 5, 30, 200]))
        if d % 3 == 0:
            w = words_of(rng.choice(items[:25])[1])
            k = rng.randrange(len(w))
            body[3:3] = w[k : k + rng.choice([2, 14, 15, 30])]
        docs.append((d, rng.choice([" ", ", ", "_", " — "]).join(body).upper() if d % 2 else "\n".join(body)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1])]
    expected = brute_leaks(docs, items)
    assert expected and leaks(spark, docs, items) == expected
    assert leaks(spark, docs, items, radius=3) == expected


def test_more_item_windows_than_a_bitmap_serves(spark, monkeypatch):
    from lodegraph.llm import leakage

    monkeypatch.setattr(leakage, "MAP_WINDOWS", 0)
    item = " ".join(WORDS[:30])
    docs = [(1, " ".join(WORDS[:8])), (2, " ".join(WORDS[8:30])), (3, " ".join(WORDS[:14])), (4, " ".join(["filler"] * 50 + WORDS[5:25])), (5, "")]
    assert leaks(spark, docs, [(7, item), (8, "w1 w2 w3")]) == {(2, 7), (4, 7), (1, 8), (3, 8)}


def test_windows_cross_no_documents_and_long_texts_are_whole(spark):
    item = " ".join(WORDS[:30])
    long = " ".join(["filler"] * 80_000 + WORDS[5:25] + ["filler"] * 10)
    docs = [(1, " ".join(WORDS[:8])), (2, " ".join(WORDS[8:30])), (3, " ".join(WORDS[:14])), (4, long)]
    assert leaks(spark, docs, [(7, item)]) == {(2, 7), (4, 7)}


def test_edited_passages_against_brute_force(spark):
    """Of the documents whose windows reach a similarity of 0.8 with an item's, at least 0.9 are found; and nothing else is."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(i, rng.choices(vocabulary, k=rng.choice([13, 14, 15, 20, 40]))) for i in range(60)]
    docs = []
    for d in range(600):
        w = list(rng.choice(items)[1])
        at = rng.randrange(max(len(w) - 14, 1))
        part = w[at : at + 15]
        part[rng.choice([0, -1, 0, -1, 1, 7])] = "edited"
        docs.append((d, rng.choices(vocabulary, k=20) + part + rng.choices(vocabulary, k=20)))
    known = [(i, " ".join(w[k : k + min(15, len(w))])) for i, w in items for k in range(max(len(w) - 14, 1))]
    holders = {}
    for i, passage in known:
        p = passage.split(" ")
        for k in range(len(p) - 4):
            holders.setdefault(tuple(p[k : k + 5]), set()).add((i, passage))
    expected = {}
    for d, w in docs:
        for size in {len(p.split(" ")) for _, p in known}:
            for k in range(len(w) - size + 1):
                part = w[k : k + size]
                for i, passage in set().union(*(holders.get(tuple(part[j : j + 5]), set()) for j in range(size - 4))):
                    if passage.count(" ") + 1 == size and (score := shingle_similarity(" ".join(part), passage)) >= 0.8:
                        expected[d, i] = max(score, expected.get((d, i), 0))
    frames = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaked_passages(*frames).collect()}
    assert set(got) <= set(expected) and all(got[k] <= expected[k] + 1e-12 for k in got)
    assert len(expected) > 200 and len(got) >= 0.9 * len(expected), (len(got), len(expected))
    print("recall", len(got), len(expected))
    assert leaked_passages(*frames).filter("exact").count() == 0
    with pytest.raises(ValueError):
        leaked_passages(*frames, radius=6)


def test_fingerprints_within_the_radius_share_a_block_value():
    from lodegraph.llm.leakage import _bitmap, _slots

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 32, (200, 3), dtype=np.uint32)
    bits, size = _bitmap(prints)
    for p in prints:
        q = p.copy()
        for k in rng.choice(96, 5, replace=False):
            q[k // 32] ^= np.uint32(1 << (k % 32))
        slots = [int(_slots(q[b : b + 1], b, size)[0]) for b in range(3)]
        assert any(bits[s >> 3] >> (s & 7) & 1 for s in slots)


def test_leaks_of_nothing(spark):
    assert leaks(spark, [], [(7, "a b")]) == set() == leaks(spark, [(1, "a b")], [])


ALIKE = [("paper", "рареr"), ("café", "cafe\u0301"), ("A B", "Ａ\u00a0Ｂ"), ("ab", "a\u200bb"), ("find", "ﬁnd"), ("x-y", "x\u2011y"), ("TOP", "ΤΟΡ"), ("й", "и\u0306"), ("clove", "сӏоѵе"), ("ГПФ", "ΓΠΦ"), ("jC", "ϳϹ")]
UNLIKE = [("paper", "Paper"), ("cafe", "café"), ("Maße", "Masse"), ("aA", "Aa"), ("a b", "ab"), ("l", "1"), ("o", "ö"), ("и", "u"), ("rn", "m"), ("a\nb", "a b")]


@pytest.fixture(scope="module")
def pairs(spark):
    rows, i = [], 0
    for n, (a, b) in enumerate(ALIKE + UNLIKE):
        rows += [(i, f"{n} {a} {n}"), (i + 1, f"{n} {b} {n}")]
        i += 2
    rows += [(1000, ""), (1001, "\u200b"), (1002, None), (1003, None), (1004, ""), (2000, "0 paper 0")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, class_key string")
    return df, {tuple(r) for r in lookalike_pairs(df).collect()}


def test_lookalike_pairs(pairs):
    expected = {(2 * n, 2 * n + 1) for n in range(len(ALIKE))} | {(1, 2000), (1000, 1001), (1001, 1004)}
    assert pairs[1] == expected


def test_canonical_texts_are_equal_within_a_class(spark, pairs):
    rows = {r["doc_id"]: r for r in canonical_texts(pairs[0]).collect()}
    assert len(rows) == pairs[0].count()
    for a, b in pairs[1]:
        assert rows[a]["canonical_text"] == rows[b]["canonical_text"]
    assert rows[1002]["canonical_text"] is None and rows[2 * len(ALIKE)]["canonical_text"] == rows[2 * len(ALIKE)]["text"]


def test_lookalike_of_all_accented_letters(spark):
    letters = [chr(c) for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    rows = [(2 * i, f"{i}:{c}") for i, c in enumerate(letters)] + [(2 * i + 1, f"{i}:{unicodedata.normalize('NFD', c)}") for i, c in enumerate(letters)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == {(2 * i, 2 * i + 1) for i in range(len(letters))}
    assert lookalike_pairs(df.limit(0)).count() == 0


def test_poisson_means():
    for rate, cap in ((0.01, 1), (0.5, 1), (0.99, 1), (1.9, 2), (3.0, 5)):
        assert math.isclose(capped_mean(poisson_mean(rate, cap), cap), rate, rel_tol=1e-9)
    assert poisson_mean(2.0, 2) == math.inf
    # A mean whose first terms are below the least double.
    assert math.isclose(capped_mean(poisson_mean(900.0, 1000), 1000), 900.0, rel_tol=1e-9) and poisson_mean(900.0, 1000) < 1000


def test_draws_of_a_large_mean(spark):
    from lodegraph.llm.mixing import _draws

    got = [r[0] for r in spark.range(400).select(_draws(F.col("id"), F.lit(800.0), F.lit(1000), 3)).collect()]
    assert abs(sum(got) / 400 - 800) < 6 and max(got) < 1000 and len(set(got)) > 50
    assert mix_sources(spark.createDataFrame([(1, "a", "s")], "doc_id int, text string, source string"), spark.createDataFrame([], "source string, target_share double, max_repeats int"))[0].count() == 0


def test_plan_meets_shares_within_caps():
    plan = {r[0]: r for r in plan_rates({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2)])}
    assert plan["b"][3] == 3.0 and plan["c"][3] == 0.0
    assert math.isclose(1000 * plan["a"][3] / (100 * 3), 5 / 4)
    assert plan_rates({}, [("a", 1.0, 2)])[0][3] == 0.0


def test_mix_reaches_shares_and_is_stable(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), rng.choice(["Big-Source ", "big_source", "big_source", "small", None, "unknown"]), "x") for i in range(6000)]
    rows += [(9001, None, "small", "x"), (9002, "", "small", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, targets)
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["big_source"]["actual_share"] - 2 / 3) < 0.03 and abs(shares["small"]["actual_share"] - 1 / 3) < 0.03
    assert shares["absent"]["actual_share"] == 0
    got = mix.collect()
    assert len(got) == sum(r["copies"] for r in shares.values()) and sum(r["n_tokens"] for r in got) == sum(r["tokens_taken"] for r in shares.values())
    for source, cap in (("big_source", 1), ("small", 4)):
        assert max(r["copy"] for r in got if r["source"] == source) <= cap
    assert {(r["doc_id"], r["copy"]) for r in mix_sources(docs.repartition(7), targets)[0].collect()} == {(r["doc_id"], r["copy"]) for r in got}
    places = [r["place"] for r in got]
    assert places == sorted(places) and [r["doc_id"] for r in got] != sorted(r["doc_id"] for r in got)
    empty = mix_sources(docs.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].filter(F.col("tokens_taken") > 0).count() == 0
