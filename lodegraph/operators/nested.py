"""Deeply nested reports as related flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.variants import as_list, as_named, get, members, read_object, text
from lodegraph.operators.latest import latest
from lodegraph.workspace import materialize


def _rest(m: Column, *known: str) -> Column:
    """The scalar members of an object but the known ones, as texts."""
    kept = F.map_filter(F.transform_values(m, lambda k, v: text(v)), lambda k, v: v.isNotNull() & ~k.isin(*known))
    return kept.alias("attributes")


def _node(v: Column) -> Column:
    m = members(v)
    return F.struct(text(get(m, "id")).alias("id"), text(get(m, "kind")).alias("kind"), text(get(m, "name")).alias("name"), text(get(m, "parent")).alias("parent"), text(get(m, "loc")).try_cast("double").alias("loc"), _rest(m, "id", "kind", "name", "parent", "loc"))


def _edge(v: Column) -> Column:
    m = members(v)
    return F.struct(text(get(m, "source")).alias("source"), text(get(m, "target")).alias("target"), text(get(m, "kind")).alias("kind"), text(get(m, "line")).try_cast("bigint").alias("line"), _rest(m, "source", "target", "kind", "line"))


def _cycle(v: Column) -> Column:
    m = members(v)
    return F.struct(text(get(m, "kind")).alias("kind"), F.transform(as_list(get(m, "nodes")), text).alias("nodes"))


def _principle(v: Column) -> Column:
    m = members(v)
    return F.struct(*[text(get(m, c)).alias(c) for c in ("id", "label", "title", "sort_metric", "doc_url")], F.transform(as_list(get(m, "connections")), text).alias("connections"))


def _language(named: Column) -> Column:
    graphs = F.transform(
        as_named(get(named["object"], "graphs"), "level"),
        lambda g: F.struct(
            g["name"].alias("level"),
            F.transform(as_list(get(g["object"], "nodes")), _node).alias("nodes"),
            F.transform(as_list(get(g["object"], "edges")), _edge).alias("edges"),
            F.transform(as_list(get(g["object"], "cycles")), _cycle).alias("cycles"),
        ),
    )
    return F.struct(named["name"].alias("language"), graphs.alias("graphs"), F.transform(as_list(get(named["object"], "principles")), _principle).alias("principles"))


def read_reports(df: DataFrame, id: str = "snap_id", payload: str = "payload", at: str = "ingested_at") -> DataFrame:
    """(id, git, timings, languages) of each readable report, in one typed shape.

    Languages and graph levels come as maps or as lists of named objects, lists of one as bare
    values, whole reports as JSON inside a JSON string: all read alike. Absent, null and empty parts
    are empty. A payload that holds no JSON object (or one that repeats a key) is left out. Of an id delivered more than
    once the latest counts; a null id is an id. Other columns are ignored.
    """
    rows = latest(df.select(id, payload, at), [id], at).withColumn("_lg", read_object(F.col(payload))).filter("_lg is not null")
    git = members(get(F.col("_lg"), "git"))
    timings = F.transform(as_list(get(F.col("_lg"), "timings")), lambda t: F.struct(text(get(members(t), "stage")).alias("stage"), text(get(members(t), "ms")).try_cast("double").alias("ms"), text(get(members(t), "detail")).alias("detail")))
    return rows.select(
        id,
        F.when(git.isNotNull(), F.struct(*[text(get(git, c)).alias(c) for c in ("branch", "commit", "origin")], text(get(git, "dirty_files")).try_cast("bigint").alias("dirty_files"))).alias("git"),
        timings.alias("timings"),
        F.transform(as_named(get(F.col("_lg"), "languages"), "name"), _language).alias("languages"),
    )


def flat_tables(df: DataFrame, id: str = "snap_id", payload: str = "payload", at: str = "ingested_at") -> dict[str, DataFrame]:
    """The reports of ``read_reports`` as tables by name, each with the keys of its ancestors.

    git, timing, language, graph (id, language, level), node, edge and cycle (with their place
    in the graph), cycle_node (cycle_no and place), principle, connection (principle id). Each table is one inline of arrays
    that nested transforms fill with ancestor keys and indices. Nulls inside elements stay nulls.
    """
    reports = materialize(read_reports(df, id, payload, at))

    def table(array: str) -> DataFrame:
        return reports.select(id, F.expr(f"inline({array})"))

    graph = "flatten(transform(languages, l -> {}))"
    in_graph = graph.format("flatten(transform(l.graphs, g -> transform(g.{part}, (x, i) -> {row})))")
    keys = "l.language as language, g.level as level"

    def part(name: str, row: str) -> str:
        return in_graph.replace("{part}", name).replace("{row}", row)

    cycle_nodes = graph.format(f"flatten(transform(l.graphs, g -> flatten(transform(g.cycles, (x, i) -> transform(x.nodes, (n, j) -> struct({keys}, i as cycle_no, j as place, n as node))))))")
    principles = graph.format("transform(l.principles, (p, i) -> struct(l.language as language, i as place, p.id as principle, p.label as label, p.title as title, p.sort_metric as sort_metric, p.doc_url as doc_url))")
    connections = graph.format("flatten(transform(l.principles, p -> transform(p.connections, (c, i) -> struct(l.language as language, p.id as principle, i as place, c as connection))))")
    return {
        "git": reports.filter("git is not null").select(id, "git.*"),
        "timing": table("transform(timings, (t, i) -> struct(i as place, t.stage as stage, t.ms as ms, t.detail as detail))"),
        "language": table("transform(languages, (l, i) -> struct(i as place, l.language as language))"),
        "graph": table(graph.format(f"transform(l.graphs, g -> struct({keys}))")),
        "node": table(part("nodes", f"struct({keys}, i as place, x.id as node, x.kind as kind, x.name as name, x.parent as parent, x.loc as loc, x.attributes as attributes)")),
        "edge": table(part("edges", f"struct({keys}, i as place, x.source as source, x.target as target, x.kind as kind, x.line as line, x.attributes as attributes)")),
        "cycle": table(part("cycles", f"struct({keys}, i as cycle_no, x.kind as kind)")),
        "cycle_node": table(cycle_nodes),
        "principle": table(principles),
        "connection": table(connections),
    }
