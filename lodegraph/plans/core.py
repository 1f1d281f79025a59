"""The pN_ queries of the general problems, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.drift import read_drifting, unified_records
from lodegraph.operators.hierarchy import descendants, resolve_hierarchy
from lodegraph.operators.latest import latest, trimmed
from lodegraph.operators.nested import flat_tables
from lodegraph.operators.snapshots import content_hash, numeric_entries, snapshot_changes
from lodegraph.workspace import table


def _hierarchy(spark: SparkSession, sf_dir: str, **more: object) -> DataFrame:
    rows = latest(table(spark, sf_dir, "nodes").select("repo", "id", "seen_at", "node_key", "parent", "name"), ["repo", "id"], "seen_at")
    rows = rows.withColumn("parent", F.regexp_replace(trimmed(F.col("parent")), "/+$", ""))
    above = rows.select(F.col("repo").alias("p_repo"), F.col("id").alias("p_id"), F.col("node_key").alias("parent_key"))
    rows = rows.join(above, (F.col("repo") == F.col("p_repo")) & (F.col("parent") == F.col("p_id")) & (F.col("parent") != ""), "left")
    return resolve_hierarchy(rows, "node_key", "parent_key", **more)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from which following parents never reaches a root."""
    return _hierarchy(spark, sf_dir).filter("not rooted").select(F.col("id").alias("node_key"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, path of names and number of descendants of every node."""
    out = _hierarchy(spark, sf_dir, name="name")
    return out.select(F.col("id").alias("node_key"), F.col("root").alias("root_key"), "depth", "path", "n_descendants")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a node and a node below it."""
    return descendants(_hierarchy(spark, sf_dir, lineage=True)).select(F.col("ancestor").alias("ancestor_key"), F.col("descendant").alias("descendant_key"), "distance")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field from one file of a feed to its next."""
    return read_drifting(table(spark, sf_dir, "drift_records"))[0]


def _unified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "drift_records")
    return unified_records(read_drifting(records)[1], records.select("feed_id", "record_kind").filter("record_kind is not null").distinct())


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all files by kind, with one name and one type for each field."""
    return _unified(spark, sf_dir)[0]


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified fields of each kind of record with their types."""
    return _unified(spark, sf_dir)[1]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added, removed or changed from one snapshot of a repo to its next."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    content = content_hash(F.col("kind"), F.col("path"), zero("loc"), zero("items"), F.coalesce(F.col("visibility"), F.lit("")), numeric_entries(F.col("attrs")))
    return snapshot_changes(table(spark, sf_dir, "node_snapshots"), ["repo"], "snap_no", ["id"], content, "ingested_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct elements of every readable report with the keys of their parents."""
    tables = flat_tables(table(spark, sf_dir, "snapshot_docs"))
    level, words = F.concat_ws("/", "language", "level"), F.concat_ws
    rows = {
        "git": ("git", F.lit("$"), F.when(F.col("commit") != "", F.col("commit"))),
        "graph": ("graph", F.col("language"), F.col("level")),
        "node": ("node", level, F.col("node")),
        "edge": ("edge", level, words("|", *[F.coalesce(c, F.lit("")) for c in ("source", "target", "kind")])),
        "cycle_node": ("cycle_node", F.concat(level, F.lit("#"), "cycle_no"), F.col("node")),
        "principle": ("principle", F.col("language"), F.col("principle")),
        "connection": ("connection", F.concat("language", F.lit(":"), "principle"), F.col("connection")),
    }
    parts = [tables[name].select("snap_id", F.lit(entity).alias("entity"), parent.alias("parent_key"), item.alias("item_key")) for name, (entity, parent, item) in rows.items()]
    return reduce(DataFrame.unionByName, parts).filter("parent_key is not null and item_key is not null").distinct()


def p7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all reports as a flat table."""
    return flat_tables(table(spark, sf_dir, "snapshot_docs"))["node"].drop("attributes")


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_unified": p3_unified, "p3_fields": p3_fields, "p5_found": p5_found, "p7_found": p7_found, "p7_nodes": p7_nodes}

_P2 = r"""
WITH RECURSIVE n AS (
  SELECT repo, id, node_key, name, regexp_replace(regexp_replace(parent, '^\s+|\s+$', '', 'g'), '/+$', '') AS parent
  FROM nodes QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY seen_at DESC, node_key DESC) = 1
), e AS (
  SELECT n.node_key, n.name, p.node_key AS parent_key FROM n LEFT JOIN n p ON n.repo = p.repo AND n.parent = p.id AND n.parent <> ''
), t AS (
  SELECT node_key, node_key AS root_key, 0 AS depth, coalesce(name, '') AS path, [node_key] AS lineage FROM e WHERE parent_key IS NULL
  UNION ALL
  SELECT e.node_key, t.root_key, t.depth + 1, t.path || '/' || coalesce(e.name, ''), list_append(t.lineage, e.node_key) FROM e JOIN t ON e.parent_key = t.node_key
), pairs AS (
  SELECT unnest(lineage) AS ancestor_key, generate_subscripts(lineage, 1) AS place, node_key AS descendant_key, depth FROM t
), below AS (
  SELECT ancestor_key, count(*) - 1 AS n FROM pairs GROUP BY 1
)
"""

_P3 = r"""
WITH RECURSIVE r AS (
  SELECT feed_id, file_no, coalesce(entity, '') AS entity, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j
  FROM drift_records WHERE feed_id IS NOT NULL AND file_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, entity ORDER BY ingested_at DESC) = 1
), o AS (
  SELECT feed_id, file_no, entity, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM r
), t AS (
  SELECT feed_id, file_no, entity, '' AS prefix, j FROM o WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT feed_id, file_no, entity, prefix || k || '.', v FROM (
    SELECT feed_id, file_no, entity, prefix, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM t)
  ) WHERE json_type(v) = 'OBJECT'
), l AS (
  SELECT feed_id, file_no, entity, field, CASE y WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
    CASE WHEN y IN ('VARCHAR', 'ARRAY', 'BOOLEAN') THEN v ->> '$' ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END AS value
  FROM (SELECT *, json_type(v) AS y FROM (
    SELECT feed_id, file_no, entity, prefix || k AS field, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM t)
  )) WHERE y NOT IN ('NULL', 'OBJECT')
), f AS (
  SELECT feed_id, file_no, lag(file_no) OVER (PARTITION BY feed_id ORDER BY file_no) AS before FROM (SELECT DISTINCT feed_id, file_no FROM r)
), s AS (SELECT * FROM f WHERE before IS NOT NULL),
p AS (
  SELECT feed_id, file_no, field, kind FROM (SELECT feed_id, file_no, field, kind, count(*) AS n FROM l GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, field ORDER BY n DESC, CASE kind WHEN 'string' THEN 0 WHEN 'number' THEN 1 WHEN 'boolean' THEN 2 ELSE 3 END) = 1
), a AS (SELECT s.*, p.field, p.kind FROM s JOIN p USING (feed_id, file_no)),
b AS (SELECT s.*, p.field, p.kind FROM s JOIN p ON p.feed_id = s.feed_id AND p.file_no = s.before),
came AS (SELECT a.* FROM a ANTI JOIN b USING (feed_id, file_no, field)),
went AS (SELECT b.* FROM b ANTI JOIN a USING (feed_id, file_no, field)),
e AS (SELECT s.feed_id, s.file_no, s.before, x.entity FROM s JOIN r x USING (feed_id, file_no) SEMI JOIN r y ON y.feed_id = s.feed_id AND y.file_no = s.before AND y.entity IS NOT DISTINCT FROM x.entity),
e2 AS (SELECT feed_id, file_no, before, coalesce(entity, '') AS entity FROM e),
u AS (SELECT w.feed_id, w.file_no, w.field AS name, l.entity, l.kind, l.value FROM went w JOIN l ON l.feed_id = w.feed_id AND l.file_no = w.before AND l.field = w.field SEMI JOIN e2 ON e2.feed_id = w.feed_id AND e2.file_no = w.file_no AND e2.entity = l.entity),
v AS (SELECT w.feed_id, w.file_no, w.field AS name, l.entity, l.kind, l.value FROM came w JOIN l USING (feed_id, file_no, field) SEMI JOIN e2 ON e2.feed_id = w.feed_id AND e2.file_no = w.file_no AND e2.entity = l.entity),
un AS (SELECT feed_id, file_no, name, count(*) AS n FROM u GROUP BY ALL), vn AS (SELECT feed_id, file_no, name, count(*) AS n FROM v GROUP BY ALL),
c AS (
  SELECT u.feed_id, u.file_no, u.name AS old, v.name AS new, count(*) AS in_both, count(*) FILTER (u.kind = v.kind AND u.value = v.value) AS same
  FROM u JOIN v USING (feed_id, file_no, entity) GROUP BY ALL
), m AS (
  SELECT c.feed_id, c.file_no, old, new, same / (un.n + vn.n - in_both) AS share FROM c
  JOIN un ON un.feed_id = c.feed_id AND un.file_no = c.file_no AND un.name = old JOIN vn ON vn.feed_id = c.feed_id AND vn.file_no = c.file_no AND vn.name = new
), q AS (
  SELECT feed_id, file_no, old, new FROM m WHERE share >= 2 / 3 - 1e-12
  QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, old ORDER BY share DESC, new) = 1 AND row_number() OVER (PARTITION BY feed_id, file_no, new ORDER BY share DESC, old) = 1
)
SELECT feed_id, file_no, 'renamed' AS change, new AS field, old AS old_field FROM q
UNION ALL SELECT feed_id, file_no, 'added', field, field FROM came ANTI JOIN q ON q.feed_id = came.feed_id AND q.file_no = came.file_no AND q.new = came.field
UNION ALL SELECT feed_id, file_no, 'removed', field, field FROM went ANTI JOIN q ON q.feed_id = went.feed_id AND q.file_no = went.file_no AND q.old = went.field
UNION ALL SELECT a.feed_id, a.file_no, 'type_changed', a.field, a.field FROM a JOIN b USING (feed_id, file_no, field) WHERE a.kind <> b.kind
"""

_P5 = r"""
WITH r AS (
  SELECT *, list_sort(map_entries(coalesce(CAST(CAST(attrs AS JSON) AS MAP(VARCHAR, DOUBLE)), MAP {}))) AS entries
  FROM node_snapshots QUALIFY row_number() OVER (PARTITION BY repo, snap_no, id ORDER BY ingested_at DESC) = 1
), s AS (
  SELECT repo, snap_no, lag(snap_no) OVER (PARTITION BY repo ORDER BY snap_no) AS before FROM (SELECT DISTINCT repo, snap_no FROM r)
), b AS (SELECT s.repo, s.snap_no, r.id, r.kind, r.path, r.loc, r.items, r.visibility, r.entries FROM s JOIN r ON r.repo = s.repo AND r.snap_no = s.before),
c AS (SELECT r.repo, r.snap_no, r.id, r.kind, r.path, r.loc, r.items, r.visibility, r.entries FROM s JOIN r USING (repo, snap_no) WHERE s.before IS NOT NULL)
SELECT coalesce(b.repo, c.repo) AS repo, coalesce(b.snap_no, c.snap_no) AS snap_no, coalesce(b.id, c.id) AS id,
  CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM b FULL JOIN c ON b.repo = c.repo AND b.snap_no = c.snap_no AND b.id = c.id
WHERE b.id IS NULL OR c.id IS NULL OR b.kind IS DISTINCT FROM c.kind OR b.path IS DISTINCT FROM c.path OR coalesce(b.loc, 0) <> coalesce(c.loc, 0)
  OR coalesce(b.items, 0) <> coalesce(c.items, 0) OR coalesce(b.visibility, '') <> coalesce(c.visibility, '') OR b.entries <> c.entries
"""

def _listed(value: str) -> str:
    """The elements of a JSON array; a bare value is a list of one, null is none."""
    return f"CASE WHEN coalesce(json_type({value}), 'NULL') = 'NULL' THEN [] WHEN json_type({value}) = 'ARRAY' THEN CAST({value} AS JSON[]) ELSE [{value}] END"


def _named(keys: str, value: str, key: str, source: str) -> str:
    """(keys, name, o) of named objects, from a map or from a list of objects with their name under ``key``."""
    mapped = f"SELECT {keys}, name, {value} -> name AS o FROM (SELECT {keys}, {value}, unnest(json_keys({value})) AS name FROM {source} WHERE json_type({value}) = 'OBJECT' AND coalesce(json_type({value} -> '{key}'), '') <> 'VARCHAR')"
    listed = f"SELECT {keys}, x ->> '{key}' AS name, x AS o FROM (SELECT {keys}, unnest({_listed(value)}) AS x FROM {source} WHERE json_type({value}) = 'ARRAY' OR json_type({value} -> '{key}') = 'VARCHAR')"
    return f"{mapped} UNION ALL {listed}"


_P7 = f"""
WITH d AS (SELECT DISTINCT snap_id, CASE WHEN json_valid(payload) THEN payload END AS t FROM snapshot_docs),
s AS (SELECT snap_id, CASE json_type(t) WHEN 'OBJECT' THEN t WHEN 'VARCHAR' THEN CASE WHEN json_valid(CAST(t AS JSON) ->> '$') THEN CAST(t AS JSON) ->> '$' END END AS t FROM d),
p AS (SELECT snap_id, CAST(t AS JSON) AS j, CAST(t AS JSON) -> 'languages' AS ls FROM s WHERE json_type(t) = 'OBJECT'),
l0 AS ({_named("snap_id", "ls", "name", "p")}),
l AS (SELECT snap_id, name AS language, o -> 'graphs' AS gs, o -> 'principles' AS ps FROM l0 WHERE json_type(o) = 'OBJECT'),
g0 AS ({_named("snap_id, language", "gs", "level", "l")}),
g AS (SELECT snap_id, language, language || '/' || name AS k, name, o FROM g0 WHERE json_type(o) = 'OBJECT'),
c AS (SELECT snap_id, k, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM (SELECT snap_id, k, {_listed("(o -> 'cycles')")} AS cs FROM g)),
r AS (SELECT snap_id, language, unnest({_listed("ps")}) AS p FROM l),
e AS (SELECT snap_id, k, unnest({_listed("(o -> 'edges')")}) AS e FROM g)
SELECT DISTINCT * FROM (
  SELECT snap_id, 'git' AS entity, '$' AS parent_key, nullif(j -> 'git' ->> 'commit', '') AS item_key FROM p
  UNION ALL SELECT snap_id, 'graph', language, name FROM g
  UNION ALL SELECT snap_id, 'node', k, n ->> 'id' FROM (SELECT snap_id, k, unnest({_listed("(o -> 'nodes')")}) AS n FROM g)
  UNION ALL SELECT snap_id, 'edge', k, concat(e ->> 'source', '|', e ->> 'target', '|', e ->> 'kind') FROM e
  UNION ALL SELECT snap_id, 'cycle_node', k || '#' || i, m ->> '$' FROM (SELECT snap_id, k, i, unnest({_listed("(c -> 'nodes')")}) AS m FROM c)
  UNION ALL SELECT snap_id, 'principle', language, p ->> 'id' FROM r
  UNION ALL SELECT snap_id, 'connection', language || ':' || (p ->> 'id'), x ->> '$' FROM (SELECT snap_id, language, p, unnest({_listed("(p -> 'connections')")}) AS x FROM r)
) WHERE parent_key IS NOT NULL AND item_key IS NOT NULL
"""

_NODES = (
    _P7[: _P7.index("c AS (SELECT snap_id, k, unnest(cs)")]
    + f"""n AS (SELECT snap_id, language, name AS level, unnest(ns) AS n, CAST(generate_subscripts(ns, 1) - 1 AS INTEGER) AS place FROM (SELECT snap_id, language, name, list_filter({_listed("(o -> 'nodes')")}, lambda x: coalesce(json_type(x), 'NULL') <> 'NULL') AS ns FROM g))
SELECT DISTINCT snap_id, language, level, place, n ->> 'id' AS node, n ->> 'kind' AS kind, n ->> 'name' AS name, n ->> 'parent' AS parent, TRY_CAST(n ->> 'loc' AS BIGINT) AS loc FROM n"""
)

ORACLE = {
    "p7_nodes": _NODES,
    "p3_found": _P3,
    "p7_found": _P7,
    "p2_found": _P2 + "SELECT node_key FROM e WHERE node_key NOT IN (SELECT node_key FROM t)",
    "p2_paths": _P2 + "SELECT e.node_key, root_key, depth, path, n AS n_descendants FROM e LEFT JOIN t USING (node_key) LEFT JOIN below ON e.node_key = ancestor_key",
    "p2_descendants": _P2 + "SELECT ancestor_key, descendant_key, CAST(depth - place + 1 AS INTEGER) AS distance FROM pairs WHERE ancestor_key <> descendant_key",
    "p5_found": _P5,
}
