from lodegraph.operators.latest import latest


def test_latest_takes_the_newest_whatever_the_order(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 3, "z"), (None, None, "n"), (2, None, "x")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, t int, v string")
        assert sorted((tuple(r) for r in latest(df, ["k"], "t").collect()), key=repr) == sorted([(1, 5, "b"), (None, None, "n"), (2, None, "x")], key=repr)
