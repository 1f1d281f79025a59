"""Queries for source files, from the texts of documents, and for what a browser and advice show; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import pipeline
from lodegraph.functions.paths import parts
from lodegraph.model import CheckDef
from lodegraph.operators import advice, graph, hier, rank, viewer
from lodegraph.operators.latest import latest
from lodegraph.plans.graphs import BY, edges_final, groups_of, measured, nodes_of
from lodegraph.plans.graphs_sql import _BASE, _DIR, _LONG, _folder_key, _lcp
from lodegraph.sources import imports, markdown
from lodegraph.sources.dialects import measure_sources
from lodegraph.workspace import table

_CODE = r"\.(py|rs|go|[cm]?js|[cm]?ts|c|h|cs)$"


def files_of(spark: SparkSession, sf_dir: str, pattern: str = _CODE) -> DataFrame:
    """(repo, path, text): the newest text of every path of a kind of file."""
    docs = table(spark, sf_dir, "documents").select("repo", F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", "").alias("path"), "crawled_at", "doc_id", "text")
    docs = docs.filter(F.col("repo").isNotNull() & F.lower("path").rlike(pattern))
    return latest(docs, ["repo", "path"], "crawled_at").select("repo", "path", "text")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"sloc": 25.0, "cyclomatic": 5.0, "fan_in": 2.0}
    checks = [CheckDef("long", "sloc > 10.0 && cloc < 1.0", "{name} has {sloc} lines", why="{name} has no comment")]
    return pipeline.check(files_of(spark, sf_dir), BY, limits=limits, budgets={"mutual": 0, "chain": 0}, checks=checks)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = viewer.summary_stats(measured(spark, sf_dir), BY, ["sloc", "cyclomatic", "fan_in"])
    return rows.select("repo", "metric", *[F.round(c, 6).alias(c) for c in ("avg", "min", "p50", "p90", "max", "sum")])


def _deepest(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~graph.is_external()).join(hier.depth_extremes(nodes, BY), "repo")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "import_edges": lambda s, d: pipeline.import_edges(files_of(s, d), BY).drop("visibility"),
    "import_edges_c": lambda s, d: imports.c_includes(files_of(s, d, r"\.(c|h)$"), BY).select("repo", "source", "target", "line"),
    "import_edges_go": lambda s, d: imports.go_imports(files_of(s, d, r"\.go$"), BY).select("repo", "source", "target", "line"),
    "import_edges_csharp": lambda s, d: imports.csharp_usings(files_of(s, d, r"\.cs$"), BY).select("repo", "source", "target", "line"),
    "source_lines": lambda s, d: imports.line_counts(files_of(s, d), BY).select("repo", "path", "loc", "blank"),
    "link_kinds": lambda s, d: markdown.classify_links(files_of(s, d, r"\.(md|markdown)$"), BY, "path", "text"),
    "measured_sources": lambda s, d: measure_sources(files_of(s, d), BY, "path"),
    "pipeline_nodes": lambda s, d: pipeline.analyze(files_of(s, d), BY).nodes.select("repo", "id", "kind", "sloc", "cyclomatic", "volume", "fan_in", "fan_out", "fan_out_external", "hk", "cycle"),
    "pipeline_functions": lambda s, d: pipeline.analyze(files_of(s, d), BY).functions.select("repo", "id", "parent", "kind", "cyclomatic", "cognitive", "args"),
    "pipeline_check": lambda s, d: _hits(s, d).select("repo", "rule", "location", "message", "why"),
    "shown_nodes": lambda s, d: viewer.shown(measured(s, d), "hk").select("repo", "id").unionByName(viewer.shown(measured(s, d), "cycle").select("repo", "id")),
    "local_graph": lambda s, d: viewer.local_graph(measured(s, d), edges_final(s, d), BY)[1].select("repo", "source", "target", "kind"),
    "table_search": lambda s, d: viewer.search(measured(s, d), " OR ", "name").select("repo", "id"),
    "table_sort": lambda s, d: measured(s, d).orderBy(viewer.sort_order("cloc", False), "repo", "id").limit(50).select("repo", "id", "cloc"),
    "files_dig": lambda s, d: _deepest(measured(s, d)).groupBy("repo", viewer.files_dig(F.col("path"), F.col("id"), 4, F.col("file_depth")).alias("key")).agg(F.count(F.lit(1)).alias("members")),
    "dig_crate_out": lambda s, d: measured(s, d).filter(~graph.is_external() & F.col("crate").isNotNull()).groupBy("repo", hier.dig_key(F.col("path"), F.col("crate"), -1).alias("key")).agg(F.count(F.lit(1)).alias("members")),
    "auto_focus": lambda s, d: viewer.auto_focus(measured(s, d), BY),
    "crates_of_folders": lambda s, d: viewer.crates_of_folders(measured(s, d).filter(~graph.is_external()).select("repo", hier.folder(F.col("path")).alias("folder")), hier.crate_roots(measured(s, d), BY), BY),
    "landing_depth": lambda s, d: viewer.landing_depth(measured(s, d), BY, range(0, 5)),
    "neighbour_popup": lambda s, d: viewer.neighbour_popup(measured(s, d), edges_final(s, d), BY, rank.rank_by(measured(s, d), BY, "hk", 5)),
    "edge_lines": lambda s, d: viewer.edge_lines(edges_final(s, d), BY),
    "cycle_member_rank": lambda s, d: viewer.ranked_members(groups_of(s, d), measured(s, d), BY),
    "depth_below_crates": lambda s, d: viewer.depth_below_crates(measured(s, d), hier.crate_roots(measured(s, d), BY), BY),
    "summary_stats": _summary,
    "narrowed_rows": lambda s, d: advice.narrowed(measured(s, d), BY, "cyclomatic", (20.0, 40.0), 10),
    "facts_join": lambda s, d: advice.facts(nodes_of(s, d), BY, ["kind", "visibility", "crate"]),
    "extension_owners": lambda s, d: advice.extension_owners(table(s, d, "lang_rules")),
    "crate_roll_up": lambda s, d: advice.roll_up(latest(table(s, d, "nodes").select("repo", "id", "seen_at", "parent", "loc"), ["repo", "id"], "seen_at"), BY),
    "collapsed_edges": lambda s, d: advice.collapse(edges_final(s, d), nodes_of(s, d).select("repo", "id", parts(F.col("path"))["dir"].alias("file")), BY),
    "root_files": lambda s, d: advice.root_files(nodes_of(s, d).filter("crate is not null"), BY),
}

_FILES = r"""
WITH d AS (SELECT repo, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, crawled_at, doc_id, text FROM documents WHERE repo IS NOT NULL),
f AS (SELECT repo, path, coalesce(text, '') AS text FROM d WHERE regexp_matches(lower(path), '%s') QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY crawled_at DESC NULLS LAST, doc_id DESC) = 1),
l AS (SELECT repo, path, unnest(ls) AS code, generate_subscripts(ls, 1) AS line FROM (SELECT repo, path, regexp_split_to_array(text, '\r?\n') AS ls FROM f)),
"""
_ENDS = "SELECT repo, path AS source, target, CAST(min(line) AS INTEGER) AS line FROM t WHERE path <> target GROUP BY ALL"

ORACLE = {
    "import_edges_c": (_FILES % r"\.(c|h)$") + rf"""
u AS (SELECT repo, path, line, regexp_extract(code, '^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1) AS spec FROM l),
one AS (SELECT repo, regexp_extract(path, '[^/]*$') AS name, min(path) AS only_path FROM f GROUP BY ALL HAVING count(*) = 1),
t AS (SELECT u.repo, u.path, u.line, CASE WHEN a.path IS NOT NULL THEN a.path WHEN b.path IS NOT NULL THEN b.path ELSE coalesce(only_path, 'ext:' || spec) END AS target
  FROM u LEFT JOIN f a ON a.repo = u.repo AND a.path = CASE WHEN contains(u.path, '/') THEN regexp_extract(u.path, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || spec
  LEFT JOIN f b ON b.repo = u.repo AND b.path = spec LEFT JOIN one ON one.repo = u.repo AND one.name = regexp_extract(spec, '[^/]*$') WHERE spec <> '')
{_ENDS}""",
    "import_edges_go": (_FILES % r"\.go$") + rf"""
t AS (SELECT repo, path, line, 'ext:' || spec AS target FROM (SELECT *, coalesce(nullif(regexp_extract(code, '^\s*import\s+([\w.]+\s+)?"([^"]+)"', 2), ''), nullif(regexp_extract(code, '^\s+([\w.]+\s+)?"([\w.\-/]+)"\s*$', 2), '')) AS spec FROM l) WHERE spec IS NOT NULL)
{_ENDS}""",
    "import_edges_csharp": (_FILES % r"\.cs$") + rf"""
u AS (SELECT repo, path, line, regexp_extract(code, '^\s*(global\s+)?using\s+(static\s+)?(\w+\s*=\s*)?([\w.]+)\s*;', 4) AS space FROM l),
n AS (SELECT DISTINCT repo, path AS file, regexp_extract(code, '^\s*namespace\s+([\w.]+)', 1) AS space FROM l),
t AS (SELECT u.repo, u.path, line, coalesce(file, 'ext:' || u.space) AS target FROM u LEFT JOIN n ON n.repo = u.repo AND n.space = u.space AND n.space <> '' WHERE u.space <> '')
{_ENDS}""",
    "source_lines": (_FILES % _CODE) + "x AS (SELECT 1) SELECT repo, path, CAST(count(*) AS INTEGER) AS loc, CAST(count(*) FILTER (trim(code, ' ') = '') AS INTEGER) AS blank FROM l GROUP BY ALL",
    "shown_nodes": _BASE + "SELECT repo, id FROM me WHERE hk > 0 UNION ALL SELECT repo, id FROM me WHERE cycle IS NOT NULL",
    "local_graph": _BASE + "SELECT e.repo, source, target, e.kind FROM e JOIN me a ON a.repo = e.repo AND a.id = source AND NOT a.ext JOIN me b ON b.repo = e.repo AND b.id = target AND NOT b.ext",
    "table_search": _BASE + "SELECT repo, id FROM me WHERE contains(lower(coalesce(name, '')), 'or')",
    "table_sort": _BASE + "SELECT repo, id, cloc FROM me ORDER BY cloc NULLS FIRST, repo, id LIMIT 50",
    "files_dig": _BASE + f", x AS (SELECT repo, max(CASE WHEN {_DIR} = '' THEN 0 ELSE len(string_split({_DIR}, '/')) END) AS deepest FROM me WHERE NOT ext GROUP BY repo) SELECT repo, CASE WHEN 4 > deepest THEN id ELSE {_folder_key(4)} END AS key, count(*) AS members FROM me JOIN x USING (repo) WHERE NOT ext GROUP BY ALL",
    "dig_crate_out": _BASE + "SELECT repo, coalesce(nullif(array_to_string(list_slice(string_split(crate, '/'), 1, greatest(len(string_split(crate, '/')) - 1, 0)), '/'), ''), '_root') AS key, count(*) AS members FROM me WHERE NOT ext AND crate IS NOT NULL GROUP BY ALL",
    "auto_focus": _BASE + f", x AS (SELECT * FROM me WHERE NOT ext) SELECT repo, root FROM {_lcp('repo', 'x')}",
    "crates_of_folders": _BASE + f""", x AS (SELECT * FROM me WHERE NOT ext AND crate IS NOT NULL), y AS (SELECT repo, crate, regexp_replace(root, '((^|/)(src|tests|benches|lib|bin))+$', '') AS root FROM {_lcp('repo, crate', 'x')}),
      z AS (SELECT DISTINCT repo, {_DIR} AS folder FROM me WHERE NOT ext)
      SELECT z.repo, folder, max({{'n': length(root), 'crate': crate}}).crate AS crate FROM z LEFT JOIN y ON y.repo = z.repo AND (root = '' OR folder = root OR starts_with(folder, root || '/')) GROUP BY ALL""",
    "landing_depth": _BASE + ", x AS (" + " UNION ALL ".join(f"SELECT repo, {d} AS depth, count(DISTINCT {_folder_key(d)}) AS groups FROM me WHERE NOT ext GROUP BY repo" for d in range(5)) + ") SELECT repo, CAST(coalesce(max(depth) FILTER (groups < 20), min(depth)) AS INTEGER) AS depth FROM x GROUP BY repo",
    "neighbour_popup": _BASE + """, s AS (SELECT repo, id, coalesce(crate, '') AS own_crate FROM me WHERE hk IS NOT NULL AND coalesce(kind <> 'external', true) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY hk DESC, coalesce(sloc, 0) DESC, coalesce(items, 0) DESC, id) <= 5),
      b AS (SELECT DISTINCT repo, source AS id, target AS far, 'out' AS side FROM e WHERE kind = 'uses' UNION ALL SELECT DISTINCT repo, target, source, 'in' FROM e WHERE kind = 'uses')
      SELECT b.repo, b.id, side, coalesce(m.crate, '') AS crate, coalesce(m.crate, '') = own_crate AS own, count(*) AS n FROM b JOIN s USING (repo, id) JOIN me m ON m.repo = b.repo AND m.id = b.far GROUP BY ALL""",
    "edge_lines": _BASE + "SELECT repo, source, target, coalesce(min(line) FILTER (kind = 'uses'), max(line)) AS line FROM e GROUP BY ALL",
    "cycle_member_rank": _BASE + "SELECT repo, component, id, CAST(row_number() OVER (PARTITION BY repo, component ORDER BY coalesce(hk, 0) DESC, id) AS INTEGER) AS place FROM (SELECT g.repo, g.component, unnest(g.nodes) AS id FROM g) JOIN me USING (repo, id)",
    "depth_below_crates": _BASE + f""", x AS (SELECT * FROM me WHERE NOT ext AND crate IS NOT NULL), y AS (SELECT repo, crate, regexp_replace(root, '((^|/)(src|tests|benches|lib|bin))+$', '') AS root FROM {_lcp('repo, crate', 'x')}),
      z AS (SELECT x.repo, CASE WHEN root = '' THEN {_DIR} WHEN starts_with({_DIR}, root || '/') THEN {_DIR}[length(root) + 2:] ELSE '' END AS rest FROM x JOIN y USING (repo, crate))
      SELECT repo, CAST(max(CASE WHEN rest = '' THEN 0 ELSE len(string_split(rest, '/')) END) AS INTEGER) AS depth FROM z GROUP BY repo""",
    "summary_stats": _BASE + f"SELECT repo, metric, round(avg(value), 6) AS avg, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS max, round(sum(value), 6) AS sum FROM {_LONG} WHERE NOT ext AND value > 0 AND metric IN ('sloc', 'cyclomatic', 'fan_in') GROUP BY ALL",
    "narrowed_rows": _BASE + "SELECT repo, id, cyclomatic AS value, CASE WHEN cyclomatic > 40 THEN 'warning' WHEN cyclomatic > 20 THEN 'info' ELSE '-' END AS tier, CAST(row_number() OVER (PARTITION BY repo ORDER BY cyclomatic DESC, coalesce(sloc, 0) DESC, coalesce(items, 0) DESC, id) AS INTEGER) AS rank FROM me WHERE cyclomatic IS NOT NULL AND coalesce(kind <> 'external', true) QUALIFY rank <= 10",
    "facts_join": _BASE + "SELECT repo, " + ", ".join(f"nullif(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ','), '') AS {c}" for c in ("kind", "visibility", "crate")) + " FROM n0 GROUP BY repo",
    "extension_owners": "SELECT ext, count(DISTINCT language) AS owners FROM (SELECT language, lower(unnest(extensions)) AS ext FROM lang_rules) GROUP BY ext",
    "crate_roll_up": "SELECT repo, parent AS id, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT repo, id, parent, loc FROM nodes QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY seen_at DESC, parent DESC NULLS LAST, loc DESC NULLS LAST) = 1) WHERE parent IS NOT NULL GROUP BY ALL",
    "collapsed_edges": _BASE + f", x AS (SELECT repo, id, {_DIR} AS file FROM n0) SELECT e.repo, coalesce(a.file, source) AS source, coalesce(b.file, target) AS target, kind, min(line) AS line FROM e LEFT JOIN x a ON a.repo = e.repo AND a.id = source LEFT JOIN x b ON b.repo = e.repo AND b.id = target WHERE coalesce(a.file, source) <> coalesce(b.file, target) GROUP BY ALL",
    "link_kinds": (_FILES % r"\.(md|markdown)$") + r"""
k AS (SELECT DISTINCT repo, path, unnest(list_transform(regexp_extract_all(text, '(.?)\[[^\]]*\]\([^()\s]+[^()]*\)'), lambda m: CASE WHEN NOT starts_with(m, '!') THEN regexp_extract(m, '\[[^\]]*\]\(([^()\s]+)', 1) END)) AS link FROM f),
t AS (SELECT *, regexp_replace(link, '[#?].*$', '') AS target FROM k WHERE link IS NOT NULL),
n AS (SELECT *, array_to_string(list_filter(string_split(CASE WHEN starts_with(target, '/') THEN target ELSE CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END || '/' || target END, '/'), lambda x: x <> '' AND x <> '.'), '/') AS far FROM t)
SELECT n.repo, n.path, link, CASE WHEN regexp_matches(link, '^[a-zA-Z][\w+.-]*:') THEN 'external' WHEN starts_with(link, '#') THEN 'local' WHEN f.path IS NULL THEN 'broken' WHEN regexp_matches(lower(far), '\.(md|markdown)$') THEN 'doc' ELSE 'local' END AS kind
FROM n LEFT JOIN f ON f.repo = n.repo AND f.path = far""",
    "root_files": _BASE + "SELECT repo, crate, min({'r': CASE WHEN regexp_matches(path, '(^|/)lib\\.rs$') THEN 0 WHEN regexp_matches(path, '(^|/)main\\.rs$') THEN 1 ELSE 2 END, 'path': path}).path AS path FROM n1 WHERE crate IS NOT NULL GROUP BY ALL",
}
