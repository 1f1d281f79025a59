"""Roots, depths, paths and descendants of parent-child rows by tree contraction.

Forward, every round rakes all leaves into their parents and splices an independent set of nodes
with a single child out of their chains; each removal is recorded with the node it hung from at
that time and the distance to it. A tree of any depth shrinks to its root in a number of rounds
that grows with the logarithm of the node count. What is left and can't be contracted, a node that
has become its own parent, is the core of a loop. Backward, the recorded rounds are replayed in
reverse: the node a removed one hung from is resolved by then, which gives its root, depth and path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.workspace import mark, materialize, release

#: Rounds after which a contraction is given up; 2**63 nodes need fewer.
MAX_ROUNDS = 400


def resolve_hierarchy(nodes: DataFrame, id: str = "id", parent: str = "parent", name: str | None = None, *, lineage: bool = False) -> DataFrame:
    """(id, rooted, root, depth, n_descendants[, path][, lineage]) of each distinct non-null id.

    A node whose parent is null or no id of the table is a root. ``rooted`` is false for nodes
    from which following parents never reaches a root: those on a loop (a node may be its own
    parent) and those below one; their other columns are null. Of several rows with one id that
    with the smallest (parent, name) counts, nulls first. With ``name`` the ``path`` joins the
    names from the root to the node by "/" (a null name counts as empty); with ``lineage`` the ids
    from the root to the node are given as an array, from which ``descendants`` makes pairs.
    An empty table gives an empty table; other columns of ``nodes`` are ignored.
    """
    start = mark()
    label = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias("path")] if name else []
    rows = nodes.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(parent).alias("parent"), *label)
    rows = rows.groupBy("id").agg(F.min(F.struct("parent", *["path"] * bool(name))).alias("row"))
    rows = materialize(rows.select("id", "row.*"))
    known = rows.select(F.col("id").alias("known"))
    live = rows.join(known, rows["parent"] == known["known"], "left").withColumn("parent", F.col("known")).drop("known")
    if lineage:
        live = live.withColumn("lineage", F.array("id"))
    # The round is a column, not a literal: so all rounds share one compiled plan.
    live = materialize(live.withColumns({"dist": F.lit(1), "weight": F.lit(1).cast("bigint"), "carry": F.lit(0).cast("bigint"), "turn": F.lit(0)}))
    texts = (["path"] if name else []) + (["lineage"] if lineage else [])
    rounds: list[DataFrame] = []
    while not live.filter("parent is not null and parent <> id").isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("the contraction doesn't end")
        step = materialize(_contract(live, texts))
        rounds.append(step.filter("gone <> 0"))
        live = step.filter("gone = 0").select(*live.columns)
    out = _reverse(live, rounds, texts)
    clear = lambda c: F.when(F.col("rooted"), F.col(c)).alias(c)
    out = out.select("id", "rooted", clear("root"), clear("depth"), F.when(F.col("rooted"), F.col("size") - 1).alias("n_descendants"), *[clear(c) for c in texts])
    release(start, keep=out)
    return out


def _contract(live: DataFrame, texts: list[str]) -> DataFrame:
    """One round: rows keep their place with gone = 0, leaves get 1, spliced nodes 2."""
    linked = F.col("parent").isNotNull()
    degree = live.filter(linked).groupBy(F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("children"))
    rows = live.join(degree, live["id"] == degree["up"], "left").drop("up").withColumn("leaf", F.col("children").isNull() & linked).drop("children")
    rest = ~F.col("leaf")
    gathered = rows.filter(linked).groupBy(F.col("parent").alias("up")).agg(
        F.sum(F.when(F.col("leaf"), F.col("weight") + F.col("carry"))).alias("raked"), F.count(F.when(rest, 1)).alias("rest"),
        F.max(F.when(rest, F.col("id"))).alias("only"), F.max(F.when(rest, F.col("carry"))).alias("only_carry"),
    )
    rows = rows.join(gathered, rows["id"] == gathered["up"], "left").drop("up")
    rows = rows.withColumn("weight", F.col("weight") + F.coalesce("raked", F.lit(0)))

    def draw(c: str) -> Column:
        return F.xxhash64("turn", c)

    # A node is spliced if its draw is below that of both neighbours; so no two neighbours are.
    spliced = rest & (F.col("rest") == 1) & linked & (F.col("parent") != F.col("id")) & (draw("id") < draw("parent")) & (draw("id") < draw("only"))
    rows = rows.withColumn("gone", F.when(F.col("leaf"), 1).when(F.coalesce(spliced, F.lit(False)), 2).otherwise(0)).drop("leaf", "rest", "raked")
    bridge = rows.filter("gone = 2").select(F.col("only").alias("heir"), F.col("parent").alias("b_parent"), F.col("dist").alias("b_dist"), (F.col("weight") + F.col("carry")).alias("b_carry"), *[F.col(t).alias(f"b_{t}") for t in texts])
    rows = rows.join(bridge, rows["id"] == bridge["heir"], "left")
    heir = F.col("heir").isNotNull()
    new = {
        "parent": F.when(heir, F.col("b_parent")).otherwise(F.col("parent")),
        "dist": F.when(heir, F.col("b_dist") + F.col("dist")).otherwise(F.col("dist")),
        "carry": F.when(heir, F.col("b_carry") + F.col("carry")).otherwise(F.col("carry")),
        "turn": F.col("turn") + 1,
    }
    for t in texts:
        new[t] = F.when(heir, _joined(t, f"b_{t}", t)).otherwise(F.col(t))
    return rows.withColumns(new).select(*live.columns, "gone", "only", "only_carry")


def _joined(kind: str, above: str, below: str) -> Column:
    return F.concat(above, F.lit("/"), below) if kind == "path" else F.concat(above, below)


def _reverse(core: DataFrame, rounds: list[DataFrame], texts: list[str]) -> DataFrame:
    """Undo the recorded removals: every node learns what it hung from until the core is reached.

    A removal of round r hung from a node that was removed later or never, so the records form
    trees no deeper than twice the rounds. Each pass doubles the number of removals undone: a node takes over
    the record of the one it hung from, and a spliced one the size below the child it was bridged to.
    """
    records = [r.select("id", F.col("parent").alias("up"), "dist", F.when(F.col("gone") == 2, F.col("only")).alias("below"), (F.col("weight") + F.when(F.col("gone") == 2, F.col("only_carry")).otherwise(0)).alias("size"), *texts) for r in rounds]
    base = core.select("id", F.lit(None).cast(core.schema["id"].dataType).alias("up"), F.lit(0).alias("dist"), F.lit(None).cast(core.schema["id"].dataType).alias("below"), F.col("weight").alias("size"), *texts)
    rows = materialize(reduce(DataFrame.unionByName, records, base).withColumn("moving", F.col("up").isNotNull()))
    while not rows.filter("moving or below is not null").isEmpty():
        above = rows.filter("up is not null").select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("dist").alias("a_dist"), F.col("moving").alias("a_moving"), *[F.col(t).alias(f"a_{t}") for t in texts])
        under = rows.select(F.col("id").alias("u_id"), F.col("below").alias("u_below"), F.col("size").alias("u_size"))
        rows = rows.join(above, rows["up"] == above["a_id"], "left").join(under, rows["below"] == under["u_id"], "left")
        lifted = F.col("a_id").isNotNull()
        new = {
            "up": F.coalesce("a_up", "up"),
            "dist": F.col("dist") + F.coalesce("a_dist", F.lit(0)),
            "below": F.col("u_below"),
            "size": F.col("size") + F.coalesce("u_size", F.lit(0)),
            "moving": F.coalesce("a_moving", F.lit(False)),
        } | {t: F.when(lifted, _joined(t, f"a_{t}", t)).otherwise(F.col(t)) for t in texts}
        rows = materialize(rows.withColumns(new).select("id", "up", "dist", "below", "size", *texts, "moving"))
    ends = core.select(F.col("id").alias("root"), F.col("parent").isNull().alias("rooted"), *[F.col(t).alias(f"a_{t}") for t in texts])
    rows = rows.withColumn("end", F.coalesce("up", "id")).join(ends, F.col("end") == F.col("root"))
    return rows.select("id", "rooted", "root", F.col("dist").alias("depth"), "size", *[F.when(F.col("up").isNull(), F.col(t)).otherwise(_joined(t, f"a_{t}", t)).alias(t) for t in texts])


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all rooted nodes, from a result with ``lineage``."""
    pairs = resolved.filter("rooted").select(F.col("id").alias("descendant"), "depth", F.posexplode("lineage").alias("level", "ancestor"))
    return pairs.filter("level < depth").select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
