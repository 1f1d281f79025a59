"""Files whose schemas drift, read into one table, with every change of a field reported."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.variants import members, read_object
from lodegraph.operators.latest import latest
from lodegraph.workspace import mark, materialize, release

#: Smallest share of equal values that makes a field the renamed form of another.
RENAME_SHARE = 2 / 3
#: Types in the order that settles ties.
TYPES = ("string", "number", "boolean", "array")


def _kind(value: Column) -> Column:
    """object, array, string, boolean or number; null for a null."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), None)
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def _value(value: Column, kind: Column) -> Column:
    """A form in which equal values are equal texts: numbers by value, arrays as JSON.

    Numbers are doubles where those are exact to the unit, beyond that decimals as far as they go.
    """
    number = value.try_cast("double") + F.lit(0.0)
    large = F.when(F.abs(number) >= float(1 << 53), value.try_cast("decimal(38,6)").cast("string"))
    return F.when(kind == "number", F.coalesce(large, number.cast("string"))).otherwise(value.try_cast("string"))


def leaves(records: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, field, type, value) of each leaf of a JSON payload that isn't null, of any depth.

    A field is named by its dotted path, an array is one leaf, objects have no row of their own.
    Payloads that hold no JSON object give nothing.
    """
    level = records.select(*keys, F.lit("").alias("prefix"), F.explode(F.map_entries(read_object(F.col(payload)))).alias("e"))
    parts = []
    while True:
        kind = _kind(F.col("e.value"))
        rows = level.select(*keys, F.concat("prefix", "e.key").alias("field"), kind.alias("type"), _value(F.col("e.value"), kind).alias("value")).filter("type is not null")
        rows = materialize(rows)
        parts.append(rows.filter("type <> 'object'"))
        inner = rows.filter("type = 'object'")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        level = inner.select(*keys, F.concat("field", F.lit(".")).alias("prefix"), F.explode(F.map_entries(members(F.try_parse_json("value")))).alias("e"))


def read_drifting(df: DataFrame, *, feed: str = "feed_id", file: str = "file_no", entity: str = "entity", payload: str = "payload", at: str = "ingested_at") -> tuple[DataFrame, DataFrame]:
    """(changes, values) of all feeds.

    ``changes`` is (feed, file, change, field, old_field): a change of a field from one file of a
    feed to its next one (by number, whatever the arrival): added, removed, type_changed (field and
    old_field both its name) or renamed (field the new, old_field the old name).
    ``values`` is (feed, file, entity, field, type, value, unified): each leaf of each record, with
    ``unified``, the first name of the field along the renames; a name that is given to another
    field after it was renamed away is told apart as name@file.

    Fields are profiled per file by their majority type. Fields that go and fields that come are the
    sides of a bipartite graph whose edges are the pairs with equal values in the entities of both
    files, found by an exact join; an edge stays if, over the entities in both files that hold either field, the values are equal for
    RENAME_SHARE of them. Where fields have several edges, the heaviest matching decides. Of
    repeated records (feed, file, entity) the latest counts. Records with a null feed or file are
    left out; a null entity is an entity; other columns are ignored.
    """
    start = mark()
    keys = ["feed", "file", "entity"]
    rows = df.filter(F.col(feed).isNotNull() & F.col(file).isNotNull()).select(F.col(feed).alias("feed"), F.col(file).alias("file"), F.coalesce(F.col(entity).cast("string"), F.lit("\u0000")).alias("entity"), F.col(at).alias("at"), F.col(payload).alias("payload"))
    rows = materialize(latest(rows, keys, "at").drop("at"))
    series = Window.partitionBy("feed").orderBy("file")
    files = materialize(rows.select("feed", "file").distinct().select("feed", "file", F.row_number().over(series).alias("i"), F.lead("file").over(series).alias("next")))
    values = materialize(leaves(rows, keys, "payload"))

    # Profiles: presence and majority type of a field in a file.
    counts = values.groupBy("feed", "file", "field").agg(*[F.count(F.when(F.col("type") == t, 1)).alias(t) for t in TYPES])
    first = F.array_max(F.array(*[F.struct(F.col(t).alias("n"), F.lit(-k).alias("rank"), F.lit(t).alias("type")) for k, t in enumerate(TYPES)]))["type"]
    line = Window.partitionBy("feed", "field").orderBy("i")
    profile = counts.select("feed", "file", "field", first.alias("type")).join(files, ["feed", "file"])
    profile = profile.withColumns({"back": F.lag("i").over(line), "back_type": F.lag("type").over(line), "back_file": F.lag("file").over(line), "ahead": F.lead("i").over(line)})
    i, back, ahead = F.col("i"), F.col("back"), F.col("ahead")
    event = lambda f, c: F.struct(F.col(f).alias("file"), F.lit(c).alias("change"), F.col("file").alias("held"))
    came = F.when((i > 1) & (back.isNull() | (back < i - 1)), event("file", "added")).when((back == i - 1) & (F.col("back_type") != F.col("type")), event("file", "type_changed"))
    went = F.when(F.col("next").isNotNull() & (ahead.isNull() | (ahead > i + 1)), event("next", "removed"))
    events = materialize(profile.select("feed", "field", "type", F.explode(F.array_compact(F.array(came, went))).alias("e")).select("feed", "e.*", "field", "type"))

    renames = materialize(_renames(rows, values, events))
    both = events.filter("change = 'type_changed'").select("feed", "file", "change", "field", F.col("field").alias("old_field"))
    new = events.filter("change = 'added'").join(renames.select("feed", "file", F.col("new").alias("field")), ["feed", "file", "field"], "left_anti")
    gone = events.filter("change = 'removed'").join(renames.select("feed", "file", F.col("old").alias("field")), ["feed", "file", "field"], "left_anti")
    changes = both.unionByName(new.unionByName(gone).select("feed", "file", "change", "field", F.col("field").alias("old_field")))
    changes = changes.unionByName(renames.select("feed", "file", F.lit("renamed").alias("change"), F.col("new").alias("field"), F.col("old").alias("old_field")))
    values = _unify(values, events, renames)
    names = {"feed": feed, "file": file}
    changes, values = changes.withColumnsRenamed(names), values.withColumnsRenamed(names | {"entity": entity})
    kept = changes.unionByName(values, allowMissingColumns=True)
    release(start, keep=kept)
    return changes, values


def _renames(rows: DataFrame, values: DataFrame, events: DataFrame) -> DataFrame:
    """(feed, file, old, new) of the matched pairs of fields that go and come."""
    side = lambda change, name: events.filter(F.col("change") == change).select("feed", "file", "held", F.col("field").alias(name), F.col("type").alias(f"{name}_type"))
    gone, came = side("removed", "old"), side("added", "new")
    # Values of the entities that both files of a step hold, for steps in which fields go and come.
    steps = gone.select("feed", "file", F.col("held").alias("before")).join(came.select("feed", "file"), ["feed", "file"], "left_semi").distinct()
    there = rows.select("feed", F.col("file").alias("held"), "entity")
    common = steps.join(there.withColumnRenamed("held", "before"), ["feed", "before"]).join(there.withColumnRenamed("held", "file"), ["feed", "file", "entity"], "left_semi").select("feed", "file", "entity")
    sides = gone.select("feed", "file", "held", F.col("old").alias("field"), F.lit(True).alias("goes")).unionByName(came.select("feed", "file", "held", F.col("new").alias("field"), F.lit(False).alias("goes")))
    moved = values.withColumnRenamed("file", "held").join(sides.join(steps, ["feed", "file"], "left_semi"), ["feed", "held", "field"]).join(common, ["feed", "file", "entity"], "left_semi")
    moved = materialize(moved.groupBy("feed", "file", "goes", "field", "entity").agg(F.max(F.struct("type", "value")).alias("v")))
    olds = moved.filter("goes").select("feed", "file", F.col("field").alias("old"), "entity", F.col("v").alias("old_value"))
    news = moved.filter("not goes").select("feed", "file", F.col("field").alias("new"), "entity", F.col("v").alias("new_value"))
    # Equal values are counted exactly. A pair whose equal values are too few for its larger side is no rename.
    equal = olds.join(news.withColumnRenamed("new_value", "old_value"), ["feed", "file", "entity", "old_value"]).groupBy("feed", "file", "old", "new").agg(F.count(F.lit(1)).alias("shared"))
    held = lambda x, name: x.groupBy("feed", "file", name).agg(F.count(F.lit(1)).alias(f"{name}_held"))
    pairs = equal.join(held(olds, "old"), ["feed", "file", "old"]).join(held(news, "new"), ["feed", "file", "new"])
    pairs = pairs.filter(F.col("shared") >= F.greatest("old_held", "new_held") * (RENAME_SHARE - 1e-12)).select("feed", "file", "old", "new")
    pairs = pairs.join(gone.select("feed", "file", "old", "old_type"), ["feed", "file", "old"]).join(came.select("feed", "file", "new", "new_type"), ["feed", "file", "new"])
    similar = 1 - F.levenshtein("old", "new") / F.greatest(F.length("old"), F.length("new"))
    pairs = materialize(pairs.withColumn("similar", similar))

    # Share of equal values over the entities of both files that hold either field.
    pair = ["feed", "file", "old", "new"]
    before, after = pairs.select(*pair).join(olds, pair[:3]), pairs.select(*pair).join(news, ["feed", "file", "new"])
    each = before.select(*pair, "entity", "old_value").unionByName(after.select(*pair, "entity", "new_value"), allowMissingColumns=True)
    each = each.groupBy(*pair, "entity").agg(F.max("old_value").alias("a"), F.max("new_value").alias("b"))
    share = each.groupBy(*pair).agg((F.count(F.when(F.col("a") == F.col("b"), 1)) / F.count(F.lit(1))).alias("share"))
    edges = pairs.join(share, pair).filter(F.col("share") >= RENAME_SHARE - 1e-12)
    edges = edges.withColumn("weight", F.col("share") + 0.1 * (F.col("old_type") == F.col("new_type")).cast("int") + 0.1 * F.col("similar"))
    crowd = lambda c: F.count(F.lit(1)).over(Window.partitionBy("feed", "file", c))
    edges = materialize(edges.withColumn("crowd", F.greatest(crowd("old"), crowd("new"))).select(*pair, "weight", "crowd"))
    alone = edges.filter("crowd = 1").select(*pair)
    # One step of one feed holds few candidate fields, however many its records are.
    return alone.unionByName(edges.filter("crowd > 1").groupBy("feed", "file").applyInPandas(_matching, alone.schema))


def _matching(edges: pd.DataFrame) -> pd.DataFrame:
    """The heaviest matching of one file's candidate renames, by shortest augmenting paths."""
    edges = edges.sort_values(["old", "new"])
    olds, news = sorted(edges["old"].unique()), sorted(edges["new"].unique())
    n = max(len(olds), len(news))
    most = edges["weight"].max() + 1
    cost = [[most] * n for _ in range(n)]
    for old, new, weight in zip(edges["old"], edges["new"], edges["weight"], strict=True):
        cost[olds.index(old)][news.index(new)] = most - 1 - weight
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for r in range(1, n + 1):
        row_of[0], column = r, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[column] = True
            row, delta, nearest = row_of[column], float("inf"), 0
            for c in range(1, n + 1):
                if not used[c]:
                    slack = cost[row - 1][c - 1] - u[row] - v[c]
                    if slack < least[c]:
                        least[c], way[c] = slack, column
                    if least[c] < delta:
                        delta, nearest = least[c], c
            for c in range(n + 1):
                if used[c]:
                    u[row_of[c]] += delta
                    v[c] -= delta
                else:
                    least[c] -= delta
            column = nearest
            if row_of[column] == 0:
                break
        while column:
            row_of[column] = row_of[way[column]]
            column = way[column]
    held = {(old, new) for old, new in zip(edges["old"], edges["new"], strict=True)}
    pairs = [(olds[row_of[c] - 1], news[c - 1]) for c in range(1, n + 1) if row_of[c] <= len(olds) and c <= len(news)]
    pairs = [p for p in pairs if p in held]
    return pd.DataFrame({"feed": edges["feed"].iloc[0], "file": edges["file"].iloc[0], "old": [p[0] for p in pairs], "new": [p[1] for p in pairs]})[["feed", "file", "old", "new"]]


def _unify(values: DataFrame, events: DataFrame, renames: DataFrame) -> DataFrame:
    """``values`` with the first name of each field along the renames that led to it.

    A name's life begins where the field is added; a renamed one continues the life of its old name.
    """
    born = events.filter("change = 'added'").select("feed", F.col("field").alias("name"), F.col("file").alias("since"))
    # Lives that began by a rename point to the life of the old name: the one begun last before it.
    links = renames.select("feed", F.col("new").alias("name"), F.col("file").alias("since"), "old")
    earlier = born.select("feed", F.col("name").alias("old"), F.col("since").alias("old_since"))
    links = links.join(earlier, ["feed", "old"], "left").groupBy("feed", "name", "since", "old").agg(F.max(F.when(F.col("old_since") < F.col("since"), F.col("old_since"))).alias("old_since"))
    links = materialize(links.withColumn("open", F.col("old_since").isNotNull()))
    while not links.filter("open").isEmpty():
        up = links.select("feed", F.col("name").alias("old"), F.col("since").alias("old_since"), F.col("old").alias("up"), F.col("old_since").alias("up_since"))
        links = links.join(up, ["feed", "old", "old_since"], "left")
        links = materialize(links.select("feed", "name", "since", F.coalesce("up", "old").alias("old"), F.when(F.col("up").isNotNull(), F.col("up_since")).alias("old_since"), (F.col("up_since").isNotNull() & F.col("up").isNotNull()).alias("open")))
    lives = links.select("feed", F.col("name").alias("field"), "since", F.col("old").alias("first"))
    used = values.select("feed", "file", "field").distinct()
    last = used.join(lives, ["feed", "field"], "left").filter("since is null or since <= file").groupBy("feed", "file", "field").agg(F.max_by("first", "since").alias("first"), F.max("since").alias("since"))
    # A life that began anew without a rename after that isn't the renamed one.
    anew = used.join(born.withColumnRenamed("name", "field"), ["feed", "field"]).filter("since <= file").groupBy("feed", "file", "field").agg(F.max("since").alias("anew"))
    last = last.join(anew, ["feed", "file", "field"], "left").withColumn("first", F.when(F.col("anew").isNull() | (F.col("anew") == F.col("since")), F.col("first")))
    # A name that begins anew after its field lives on under another one is a field of its own.
    left = renames.groupBy("feed", F.col("old").alias("field")).agg(F.min("file").alias("left"))
    again = F.when(F.col("first").isNull() & (F.col("anew") >= F.col("left")), F.concat("field", F.lit("@"), F.col("anew").cast("string")))
    last = last.join(left, ["feed", "field"], "left").withColumn("first", F.coalesce("first", again))
    out = values.join(last.select("feed", "file", "field", "first"), ["feed", "file", "field"], "left")
    return materialize(out.select("feed", "file", "entity", "field", "type", "value", F.coalesce("first", "field").alias("unified")))


def unified_records(values: DataFrame, kinds: DataFrame, *, feed: str = "feed_id", file: str = "file_no", entity: str = "entity", kind: str = "record_kind") -> tuple[DataFrame, DataFrame]:
    """(records, fields) of the values of ``read_drifting`` and the (feed, kind) of each feed.

    ``fields`` is (kind, field, type, types, feeds, values): the one type of each unified field of a
    kind, its own if all values share it, otherwise string. ``records`` is (kind, feed, file, entity, record,
    clashes): the record as JSON text whose values have those types; where two fields of a record have one
    unified name the greater value stands, and ``clashes`` counts the others. A feed without a kind is
    left out, one with several counts for each of them.
    """
    start = mark()
    rows = values.join(kinds.select(feed, kind).distinct(), feed)
    fields = rows.groupBy(kind, F.col("unified").alias("field")).agg(F.collect_set("type").alias("t"), F.count_distinct(feed).alias("feeds"), F.count(F.lit(1)).alias("values"))
    fields = fields.select(kind, "field", F.when(F.size("t") == 1, F.col("t")[0]).otherwise("string").alias("type"), F.array_join(F.array_sort("t"), ",").alias("types"), "feeds", "values")
    fields = materialize(fields)
    # The types of fields are few beside the values; AQE broadcasts them if their bytes are.
    typed = rows.join(fields.select(kind, F.col("field").alias("unified"), F.col("type").alias("wide")), [kind, "unified"])
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    plain = (F.col("wide") != "string") & ~((F.col("wide") == "number") & F.col("value").isin("NaN", "Infinity", "-Infinity"))
    one = typed.groupBy(kind, feed, file, entity, "unified").agg(F.max(F.when(plain, F.col("value")).otherwise(quoted(F.col("value")))).alias("literal"), (F.count(F.lit(1)) - 1).alias("more"))
    member = F.concat(quoted(F.col("unified")), F.lit(":"), "literal")
    records = one.groupBy(kind, feed, file, entity).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(member)), ","), F.lit("}")).alias("record"), F.sum("more").alias("clashes"))
    release(start, keep=fields)
    return records, fields
