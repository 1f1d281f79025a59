import math
import random

import pytest

from lodegraph.llm.topn import top_n_per_group

SCHEMA = "g string, w double, loc string, id bigint, rank_ string"


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[1] is not None and not math.isnan(r[1]):
            groups.setdefault(r[0], []).append(r)
    out = []
    for rs in groups.values():
        rs.sort(key=lambda r: (-r[1], (r[2] is None, (r[2] or "").encode()), (r[3] is None, r[3] or 0)))
        out += rs[:n]
    return sorted(out, key=repr)


def found(spark, rows, n, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r)[:5] for r in top_n_per_group(df, ["g"], "w", ["loc", "id"], n, **more).collect()), key=repr)


def test_random_groups_with_ties_nulls_and_hot_group(spark):
    rng = random.Random(5)
    texts = ["", "a", "ab", "b", "é", "{target}/x", "{target}/x/y", "\u0001", None, "z" * 300]
    rows = [(rng.choice(["hot", "hot", "hot", None, f"g{rng.randint(0, 60)}"]), rng.choice([0.0, -0.0, 1.5, -2.0, 1e300, float("nan"), None, float("inf"), 3.0]), rng.choice(texts), i - 700, "x") for i in range(1500)]
    assert found(spark, rows, 3) == brute(rows, 3)
    assert found(spark, rows, 1) == brute(rows, 1)
    # The same with cutoffs joined by salted keys.
    assert found(spark, rows, 3, broadcast_bytes=0, large=100) == brute(rows, 3)


def test_equal_scores_only_identifiers_decide(spark):
    rows = [("g", 1.0, f"{{target}}/common/prefix/{i % 50:03d}", -i, "") for i in range(400)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_repeated_rows_are_all_kept(spark):
    rows = [("g", 2.0, "a", 1, "x")] * 5 + [("g", 1.0, "b", 2, "x")]
    assert found(spark, rows, 3) == sorted([("g", 2.0, "a", 1, "x")] * 5, key=repr)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["rank"] for r in top_n_per_group(df, ["g"], "w", ["loc", "id"], 3).collect()} == {1}


def test_empty_table_and_rank(spark):
    assert found(spark, [], 3) == []
    df = spark.createDataFrame([("g", 1.0, "b", 1, ""), ("g", 1.0, "a", 2, "")], SCHEMA)
    assert {(r["id"], r["rank"]) for r in top_n_per_group(df, ["g"], "w", ["loc", "id"], 3).collect()} == {(2, 1), (1, 2)}


def test_ascending_and_whole_number_scores(spark):
    df = spark.createDataFrame([("g", 2**60 + i, str(i)) for i in range(50)], "g string, w bigint, loc string")
    assert {r["w"] - 2**60 for r in top_n_per_group(df, ["g"], "w", ["loc"], 2, descending=False).collect()} == {0, 1}


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], "w", ["id"], 0)
    with pytest.raises(ValueError):
        top_n_per_group(df, [], "w", ["id"], 1)


def test_no_task_gets_a_hot_group(spark):
    """With half the rows in one group, and adaptive execution off, its rows are spread when cutoffs aren't broadcast."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 997).cast("string"))).alias("g"), F.lit(1.0).alias("w"), "id")
        best = top_n_per_group(df, ["g"], "w", ["id"], 20_000, rank=None, broadcast_bytes=0, large=1000)
        sizes = [r[0] for r in best.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
