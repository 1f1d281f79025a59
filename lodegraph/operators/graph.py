"""Operators on graphs: nodes (by, id, kind, external, …) and edges (by, source, target, kind, line, visibility).

``by`` are the columns that keep graphs apart, such as the repository; all operators run on any
number of graphs at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import glob_regex
from lodegraph.model import FLOW_KINDS
from lodegraph.workspace import materialize

#: Flow edges of one graph up to which its cycles are found by one task.
LOCAL_EDGES = 200_000


def is_external(kind: str = "kind", external: str = "external") -> Column:
    """Whether a node stands for a library outside the project."""
    return F.coalesce(F.col(kind) == "external", F.lit(False)) | F.coalesce(F.col(external).cast("boolean"), F.lit(False))


def flow_edges(edges: DataFrame, kinds: tuple[str, ...] = FLOW_KINDS) -> DataFrame:
    """Edges of the kinds that carry flow."""
    return edges.filter(F.col("kind").isin(*kinds))


def first_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Without self-loops, one edge of each (source, target, kind): that with the least line, no line coming last."""
    first = F.min(F.struct(F.col("line").isNull().alias("none"), "line", "visibility")).alias("first")
    kept = edges.filter("source <> target").groupBy(*by, "source", "target", "kind").agg(first)
    return kept.select(*by, "source", "target", "kind", "first.line", "first.visibility")


def finalize(nodes: DataFrame, edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The canonical graph: ``first_edges``, and external nodes only if some edge targets them."""
    kept = first_edges(edges, by)
    targets = kept.select(*by, F.col("target").alias("id")).distinct()
    inner = nodes.filter(~is_external())
    return inner.unionByName(nodes.filter(is_external()).join(targets, [*by, "id"], "left_semi")), kept


def ignore(nodes: DataFrame, edges: DataFrame, by: list[str], globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without the nodes whose id, its root left out, matches a glob, and without their edges."""
    if not globs:
        return nodes, edges
    bare = F.regexp_replace("id", r"^\{[^}]*\}/", "")
    hit = bare.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    gone = nodes.filter(hit).select(*by, "id")
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), [*by, end], "left_anti")
    return nodes.filter(~F.coalesce(hit, F.lit(False))), edges


def coupling(nodes: DataFrame, edges: DataFrame, by: list[str], kinds: tuple[str, ...] = FLOW_KINDS) -> DataFrame:
    """(by, id, fan_in, fan_out, fan_out_external): distinct partners over flow edges, null for none.

    Edges from external nodes don't count; those to them count only as fan_out_external. Edges without nodes don't count.
    """
    ends = nodes.select(*by, "id", is_external().alias("outer"))
    pairs = flow_edges(edges, kinds).filter("source <> target").select(*by, "source", "target").distinct()
    pairs = pairs.join(ends.filter("not outer").select(*by, F.col("id").alias("source")), [*by, "source"])
    pairs = pairs.join(ends.withColumnRenamed("id", "target"), [*by, "target"])
    # The pairs are distinct, so counting rows counts partners; one aggregation serves both ends.
    inner = pairs.filter("not outer").select(*by, F.col("target").alias("id"), F.lit("fan_in").alias("what"))
    outer = pairs.select(*by, F.col("source").alias("id"), F.when(F.col("outer"), "fan_out_external").otherwise("fan_out").alias("what"))
    counted = inner.unionByName(outer).groupBy(*by, "id")
    return counted.agg(*[F.nullif(F.count(F.when(F.col("what") == w, 1)), F.lit(0)).alias(w) for w in ("fan_in", "fan_out", "fan_out_external")])


def adjacency(nodes: DataFrame, edges: DataFrame, by: list[str], label: str = "id") -> DataFrame:
    """(by, id, deps, rdeps): sorted labels of neighbours over edges of all kinds; an unknown node's label is its id."""
    labels = nodes.select(*by, F.col("id").alias("far"), F.col(label).alias("label"))
    out = edges.select(*by, F.col("source").alias("id"), F.col("target").alias("far"), F.lit(True).alias("out"))
    back = edges.select(*by, F.col("target").alias("id"), F.col("source").alias("far"), F.lit(False).alias("out"))
    both = out.unionByName(back).distinct().join(labels, [*by, "far"], "left").withColumn("label", F.coalesce("label", "far"))
    lists = both.groupBy(*by, "id").agg(F.array_sort(F.collect_set(F.when(F.col("out"), F.col("label")))).alias("deps"), F.array_sort(F.collect_set(F.when(~F.col("out"), F.col("label")))).alias("rdeps"))
    empty = F.array().cast("array<string>")
    return nodes.select(*by, "id").join(lists, [*by, "id"], "left").withColumns({c: F.coalesce(c, empty) for c in ("deps", "rdeps")})


def strong_components(nodes: DataFrame, edges: DataFrame, by: list[str], kinds: tuple[str, ...] = FLOW_KINDS, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(by, id, component) of nodes on a cycle of flow edges; the component is its least id.

    Edges without nodes and self-loops don't count. Nodes that no cycle can contain are trimmed
    first. A graph with at most ``local_edges`` edges left, a size that is counted, is solved by one task; larger ones by colouring:
    the greatest id is carried along the edges, and what reaches a colour's source against them, within the colour, is one component.
    """
    known = nodes.select(*by, "id").distinct()
    pairs = flow_edges(edges, kinds).filter("source <> target").select(*by, "source", "target").distinct()
    for end in ("source", "target"):
        pairs = pairs.join(known.withColumnRenamed("id", end), [*by, end], "left_semi")
    pairs = _trimmed(materialize(pairs), by, 2)
    sizes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # Sizes are one row per graph; most often none is large, and then nothing is split.
    sizes = materialize(sizes)
    if sizes.filter(F.col("n") > local_edges).isEmpty():
        small, large = pairs, None
    else:
        small, large = (materialize(pairs.join(sizes.filter(test).select(*by), by, "left_semi")) for test in (F.col("n") <= local_edges, F.col("n") > local_edges))
    shape = pairs.select(*by, F.col("source").alias("id"), F.col("source").alias("component")).schema
    found = small.groupBy(*by).applyInPandas(_local_components(by), shape)
    while large is not None and not large.isEmpty():
        part, large = _coloured(large, by)
        found = found.unionByName(part)
    sizes = found.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return found.join(sizes, [*by, "component"], "left_semi").select(*by, "id", "component")


def _trimmed(pairs: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """Without edges from nodes that none leads to, or to nodes that none leaves, round by round."""
    for _ in range(rounds):
        entered = pairs.select(*by, F.col("target").alias("source")).distinct()
        left = pairs.select(*by, F.col("source").alias("target")).distinct()
        pairs = pairs.join(entered, [*by, "source"], "left_semi").join(left, [*by, "target"], "left_semi")
        pairs = materialize(pairs)
    return pairs


def _coloured(pairs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round of colouring: (components found, edges between the other nodes)."""
    ids = pairs.select(*by, F.col("source").alias("id")).unionByName(pairs.select(*by, F.col("target").alias("id"))).distinct()
    colours = materialize(ids.withColumn("colour", F.col("id")).withColumn("fresh", F.lit(True)))
    while not (fresh := colours.filter("fresh")).isEmpty():
        sent = fresh.select(*by, F.col("id").alias("source"), "colour").join(pairs, [*by, "source"]).groupBy(*by, F.col("target").alias("id")).agg(F.max("colour").alias("sent"))
        better = F.col("sent") > F.col("colour")
        colours = materialize(colours.join(sent, [*by, "id"], "left").select(*by, "id", F.when(better, F.col("sent")).otherwise(F.col("colour")).alias("colour"), F.coalesce(better, F.lit(False)).alias("fresh")))
    colours = colours.drop("fresh")
    ends = lambda c: colours.select(*by, F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
    within = materialize(pairs.join(ends("source"), [*by, "source"]).join(ends("target"), [*by, "target"]).filter("source_colour = target_colour").select(*by, "source", "target"))
    reached = colours.filter("id = colour").withColumn("fresh", F.lit(True))
    while not (fresh := reached.filter("fresh")).isEmpty():
        back = fresh.select(*by, F.col("id").alias("target"), "colour").join(within, [*by, "target"]).select(*by, F.col("source").alias("id"), "colour").distinct()
        back = back.join(reached.select(*by, "id"), [*by, "id"], "left_anti")
        reached = materialize(reached.withColumn("fresh", F.lit(False)).unionByName(back.withColumn("fresh", F.lit(True))))
    least = reached.groupBy(*by, "colour").agg(F.min("id").alias("component"))
    found = materialize(reached.join(least, [*by, "colour"]).select(*by, "id", "component"))
    gone = found.select(*by, "id")
    for end in ("source", "target"):
        pairs = pairs.join(gone.withColumnRenamed("id", end), [*by, end], "left_anti")
    return found, _trimmed(materialize(pairs), by, 2)


def _local_components(by: list[str]):  # noqa: ANN202
    """Components of one graph: a depth-first search that needs no recursion."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for a, b in zip(edges["source"], edges["target"], strict=True):
            out.setdefault(a, []).append(b)
        order, low, stack, held, found = {}, {}, [], set(), []
        for root in sorted(out):
            if root in order:
                continue
            trail = [(root, iter(out[root]))]
            order[root] = low[root] = len(order)
            stack.append(root)
            held.add(root)
            while trail:
                node, rest = trail[-1]
                for far in rest:
                    if far not in order:
                        order[far] = low[far] = len(order)
                        stack.append(far)
                        held.add(far)
                        trail.append((far, iter(out.get(far, ()))))
                        break
                    if far in held:
                        low[node] = min(low[node], order[far])
                else:
                    trail.pop()
                    if trail:
                        low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                    if low[node] == order[node]:
                        at = stack.index(node) if len(stack) < 64 else max(i for i in range(len(stack)) if stack[i] == node)
                        members, stack[at:] = stack[at:], []
                        held.difference_update(members)
                        least = min(members)
                        found += [(m, least) for m in members]
        keys = [edges[c].iloc[0] for c in by]
        return pd.DataFrame([(*keys, a, b) for a, b in found], columns=[*by, "id", "component"])

    return run


def cycles(components: DataFrame, nodes: DataFrame, by: list[str], *, drop_multi_crate: bool = True) -> DataFrame:
    """(by, component, kind, size, nodes): ``mutual`` of two nodes, ``chain`` of more, members sorted.

    A cycle whose members all have a crate, of which there are two or more, is dropped. The crate is the
    attribute, else the id before its last "/src/".
    """
    named = F.coalesce(F.nullif(F.col("crate"), F.lit("")), F.nullif(F.regexp_extract("id", r"^(.*)/src/", 1), F.lit("")))
    crates = nodes.select(*by, "id", named.alias("crate"))
    groups = components.join(crates, [*by, "id"], "left").groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("id")).alias("nodes"), F.count("crate").alias("known"), F.count_distinct("crate").alias("crates"))
    if drop_multi_crate:
        groups = groups.filter(~((F.col("known") == F.col("size")) & (F.col("crates") > 1)))
    return groups.select(*by, "component", F.when(F.col("size") == 2, "mutual").otherwise("chain").alias("kind"), "size", "nodes")


def break_points(groups: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, source, target, line): the first edge of any kind, by (source, target, kind), inside each cycle."""
    members = groups.select(*by, "component", F.explode("nodes").alias("id"))
    inside = edges.join(members.withColumnRenamed("id", "source"), [*by, "source"]).join(members.select(*by, F.col("component").alias("far"), F.col("id").alias("target")), [*by, "target"]).filter("component = far")
    first = inside.groupBy(*by, "component").agg(F.min(F.struct("source", "target", "kind", F.coalesce("line", F.lit(2**31 - 1)).alias("at"))).alias("e"))
    return first.select(*by, "component", "e.source", "e.target", F.nullif("e.at", F.lit(2**31 - 1)).alias("line"))


def group_edges(edges: DataFrame, groups: DataFrame, by: list[str], kinds: tuple[str, ...] = FLOW_KINDS) -> DataFrame:
    """(by, source_group, target_group, flow): edges between groups of (by, id, group), once each.

    Edges within a group are dropped; a pair with a flow edge has no row for other kinds.
    """
    ends = lambda c: groups.select(*by, F.col("id").alias(c), F.col("group").alias(f"{c}_group"))
    rows = edges.join(ends("source"), [*by, "source"]).join(ends("target"), [*by, "target"]).filter("source_group <> target_group")
    return rows.groupBy(*by, "source_group", "target_group").agg(F.bool_or(F.col("kind").isin(*kinds)).alias("flow"))


def shared_ids(nodes: DataFrame, by: list[str], language: str = "language") -> DataFrame:
    """(by, id) of inner nodes that occur in several languages; a sound project has none."""
    return nodes.filter(~is_external()).groupBy(*by, "id").agg(F.count_distinct(language).alias("n")).filter("n > 1").select(*by, "id")
