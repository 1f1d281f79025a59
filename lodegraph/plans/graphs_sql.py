"""SQL equivalents of the graph queries."""

from __future__ import annotations

from lodegraph.plans.graphs import INPUT_SQL, LIMITS, PRINCIPLES, THRESHOLDS


def _truncated(x: str) -> str:
    small = f"(sign({x}) * floor(abs({x}) * pow(10, 2 - floor(log10(abs({x}))))) / pow(10, 2 - floor(log10(abs({x})))))"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN 0 WHEN abs({x}) >= 1 THEN sign({x}) * floor(abs({x}) * 1000) / 1000 ELSE {small} END"


_INPUTS = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in INPUT_SQL.items())
_MEASURED = ", ".join(f"CASE WHEN NOT ext AND {'sloc > 0 AND ' if k in ('sloc', 'lloc', 'cloc', 'blank') else ''}{k} <> 0 THEN {k} END AS {k}" for k in INPUT_SQL)

_BASE = f"""
WITH RECURSIVE n0 AS (
  SELECT repo, id, node_key, kind, name, external, crate, visibility, coalesce(path, CASE WHEN starts_with(id, '{{target}}/') THEN id[10:] ELSE id END) AS path, loc, items,
    coalesce(loc, 0) AS l, coalesce(items, 0) AS m, coalesce(kind = 'external', false) OR coalesce(external, false) AS ext
  FROM nodes QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY seen_at DESC, node_key DESC) = 1
), n1 AS (SELECT *, {_INPUTS} FROM n0),
e AS (
  SELECT repo, source, target, kind, line, visibility FROM edges WHERE source <> target
  QUALIFY row_number() OVER (PARTITION BY repo, source, target, kind ORDER BY line NULLS LAST, visibility NULLS FIRST) = 1
), n AS (SELECT * FROM n1 WHERE NOT ext OR EXISTS (SELECT 1 FROM e WHERE e.repo = n1.repo AND e.target = n1.id)),
f AS (SELECT DISTINCT e.repo, source, target, t.ext AS outer_end FROM e JOIN n s ON s.repo = e.repo AND s.id = source AND NOT s.ext JOIN n t ON t.repo = e.repo AND t.id = target WHERE e.kind = 'uses'),
fi AS (SELECT repo, target AS id, count(*) AS fan_in FROM f WHERE NOT outer_end GROUP BY ALL),
fo AS (SELECT repo, source AS id, nullif(count(*) FILTER (NOT outer_end), 0) AS fan_out, nullif(count(*) FILTER (outer_end), 0) AS fan_out_external FROM f GROUP BY ALL),
c AS (SELECT coalesce(fi.repo, fo.repo) AS repo, coalesce(fi.id, fo.id) AS id, fan_in, fan_out, fan_out_external FROM fi FULL JOIN fo ON fi.repo = fo.repo AND fi.id = fo.id),
u AS (SELECT DISTINCT e.repo, source, target FROM e WHERE kind = 'uses' AND EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = source) AND EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = target)),
r AS (SELECT repo, source AS a, target AS b FROM u UNION SELECT r.repo, r.a, u.target FROM r JOIN u ON u.repo = r.repo AND u.source = r.b),
k AS (SELECT x.repo, x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.repo = y.repo AND x.a = y.b AND x.b = y.a GROUP BY x.repo, x.a),
g AS (SELECT repo, component, CASE WHEN count(*) = 2 THEN 'mutual' ELSE 'chain' END AS kind, count(*) AS size, list_sort(list(id)) AS nodes FROM k GROUP BY repo, component HAVING count(*) > 1),
me0 AS (
  SELECT n.repo, n.id, n.node_key, n.kind, n.name, n.crate, n.path, n.loc, n.items, n.ext, {_MEASURED},
    CASE WHEN NOT ext AND spaces + branches <> 1 THEN spaces + branches END AS cyclomatic, fan_in, fan_out, fan_out_external
  FROM n LEFT JOIN c USING (repo, id)
), me AS (
  SELECT me0.*, CASE WHEN NOT ext THEN nullif(coalesce(sloc, 0) * pow(coalesce(fan_in, 0) * coalesce(fan_out, 0), 2), 0) END AS hk, g.kind AS cycle
  FROM me0 LEFT JOIN (SELECT repo, unnest(nodes) AS id, kind FROM g) g USING (repo, id)
)
"""

_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
_LONG = "(SELECT repo, id, ext, kind, unnest([" + ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in ("hk", "sloc", "cyclomatic", "fan_out", "fan_in")) + "], recursive := true) FROM me)"
_LIMIT = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items()) + " END"
_OVER = f"(SELECT repo, id AS location, metric, value, {_LIMIT} AS bound FROM {_LONG} WHERE NOT ext AND value > {_LIMIT})"
_GROUP = "CASE metric WHEN 'sloc' THEN 'SIZ' WHEN 'hk' THEN 'CPL' WHEN 'fan_out' THEN 'CPL' ELSE 'CPX' END"
_ADJ = """adj AS (SELECT n.repo, n.id, (SELECT list_sort(list(DISTINCT coalesce(t.path, e.target))) FROM e LEFT JOIN n t ON t.repo = e.repo AND t.id = e.target WHERE e.repo = n.repo AND e.source = n.id) AS deps,
  (SELECT list_sort(list(DISTINCT coalesce(t.path, e.source))) FROM e LEFT JOIN n t ON t.repo = e.repo AND t.id = e.source WHERE e.repo = n.repo AND e.target = n.id) AS rdeps FROM n)"""
_INFO = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in THRESHOLDS.items()) + " END"
_WARN = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in THRESHOLDS.items()) + " END"
_VOL = "(eta1 + eta2 > 0)"
_DERIVED = f"""{_BASE}, d1 AS (SELECT repo, id, eta1, eta2, n1, n2, cloc, span_sloc, eta1 + eta2 AS vocabulary, n1 + n2 AS length, spaces + branches AS cyclomatic,
  CASE WHEN {_VOL} THEN (n1 + n2) * log2(eta1 + eta2) ELSE 0 END AS volume FROM n1 WHERE NOT ext),
d2 AS (SELECT *, CASE WHEN eta2 > 0 THEN (eta1 / 2) * (n2 / eta2) * volume ELSE 0 END AS effort FROM d1)"""
_CYC = f"""cyc AS (SELECT g.*, count(*) OVER (PARTITION BY repo, kind) AS found FROM g),
bad AS (SELECT * FROM cyc WHERE found > CASE kind WHEN 'chain' THEN 1 ELSE 0 END),
bp AS (SELECT m.repo, m.component, e.source, e.target, e.line FROM (SELECT repo, component, unnest(nodes) AS id FROM g) m JOIN e ON e.repo = m.repo AND e.source = m.id
  JOIN (SELECT repo, component, unnest(nodes) AS id FROM g) t ON t.repo = m.repo AND t.component = m.component AND t.id = e.target
  QUALIFY row_number() OVER (PARTITION BY m.repo, m.component ORDER BY e.source, e.target, e.kind) = 1)"""
_CHK = f"""p AS (SELECT repo, quantile_cont(sloc, 0.9) AS p90 FROM me WHERE NOT ext GROUP BY repo),
chk AS (
  SELECT me.repo, 'check.hub' AS rule, 'LNT' AS rule_group, id AS location, CAST(1 AS DOUBLE) AS weight FROM me WHERE NOT ext AND fan_in > 3 AND fan_out > 3
  UNION ALL SELECT me.repo, 'check.tangle', 'SIZ', id, CAST(1 AS DOUBLE) FROM me JOIN p USING (repo) WHERE NOT ext AND sloc > p90
  UNION ALL SELECT NULL, 'check.broken', 'LNT', '', CAST('inf' AS DOUBLE)
)"""
_ALL = f"""{_BASE}, {_CYC}, {_CHK}, va AS (
  SELECT repo, 'threshold.file.' || metric AS rule, {_GROUP} AS rule_group, location, value / bound AS weight FROM {_OVER}
  UNION ALL SELECT b.repo, 'cycle.' || b.kind, 'CYC', coalesce(bp.source, b.nodes[1]), CAST(b.size AS DOUBLE) FROM bad b LEFT JOIN bp USING (repo, component)
  UNION ALL SELECT * FROM chk
)"""
_DIFF = f"""{_BASE}, seen AS (SELECT repo, id FROM nodes GROUP BY repo, id HAVING min(seen_at) < TIMESTAMPTZ '2025-07-01 00:00:00+00'),
bn AS (SELECT n0.* FROM n0 SEMI JOIN seen USING (repo, id)),
be AS (SELECT e.* FROM e JOIN seen ON seen.repo = e.repo AND seen.id = e.source),
ed AS (SELECT coalesce(b.repo, e.repo) AS repo, coalesce(b.source, e.source) AS source, coalesce(b.target, e.target) AS target, coalesce(b.kind, e.kind) AS kind,
  CASE WHEN b.repo IS NULL THEN 'added' WHEN e.repo IS NULL THEN 'removed' ELSE 'unchanged' END AS status
  FROM be b FULL JOIN e ON b.repo = e.repo AND b.source = e.source AND b.target = e.target AND b.kind = e.kind),
touched AS (SELECT repo, source AS id FROM ed WHERE status <> 'unchanged' UNION SELECT repo, target FROM ed WHERE status <> 'unchanged'),
nd0 AS (SELECT coalesce(b.repo, n.repo) AS repo, coalesce(b.id, n.id) AS id, CASE WHEN b.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed' ELSE 'unchanged' END AS status
  FROM bn b FULL JOIN n ON b.repo = n.repo AND b.id = n.id),
nd AS (SELECT nd0.repo, nd0.id, CASE WHEN status = 'unchanged' AND t.id IS NOT NULL THEN 'affected' ELSE status END AS status FROM nd0 LEFT JOIN touched t USING (repo, id)),
ed2 AS (SELECT ed.repo, source, target, kind, CASE WHEN status = 'unchanged' AND (EXISTS (SELECT 1 FROM nd WHERE nd.repo = ed.repo AND nd.id = source AND nd.status <> 'unchanged')
  OR EXISTS (SELECT 1 FROM nd WHERE nd.repo = ed.repo AND nd.id = target AND nd.status <> 'unchanged')) THEN 'affected' ELSE status END AS status FROM ed),
vb AS (SELECT repo, id AS location FROM bn WHERE NOT ext AND coalesce(loc, 0) > 600), vc AS (SELECT repo, id AS location FROM me WHERE NOT ext AND sloc > 600),
ch AS (SELECT repo, 'threshold.file.sloc' AS rule, location, 'resolved' AS status FROM vb ANTI JOIN vc USING (repo, location) UNION ALL SELECT repo, 'threshold.file.sloc', location, 'new' FROM vc ANTI JOIN vb USING (repo, location))"""


def _folder_key(depth: int) -> str:
    return f"coalesce(nullif(array_to_string(list_slice(string_split({_DIR}, '/'), 1, {depth}), '/'), ''), '_root')"


def _lcp(keys: str, source: str) -> str:
    """The common folder of a group: names equal, place by place, in its least and greatest folder."""
    return f"""(SELECT {keys}, array_to_string(CASE WHEN len(list_filter(same, lambda x: NOT x)) = 0 THEN a ELSE a[1:list_position(same, false) - 1] END, '/') AS root FROM (
      SELECT {keys}, a, list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i] = b[i], false)) AS same FROM (
        SELECT {keys}, string_split(min({_DIR}), '/') AS a, string_split(max({_DIR}), '/') AS b FROM {source} GROUP BY {keys})))"""


def _q(x: str) -> str:
    return f"round(quantile_cont(value, {x}), 6)"


ORACLE = {
    "finalize_edges": _BASE + "SELECT * FROM e",
    "external_prune": _BASE + "SELECT repo, id, kind FROM n",
    "flow_edges": _BASE + "SELECT repo, source, target FROM e WHERE kind = 'uses'",
    "coupling": _BASE + "SELECT * FROM c",
    "hk": _BASE + "SELECT repo, id, hk FROM me WHERE hk IS NOT NULL",
    "top_hk": _BASE + "SELECT repo, id, hk AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM me WHERE hk IS NOT NULL AND coalesce(kind <> 'external', true) WINDOW w AS (PARTITION BY repo ORDER BY hk DESC, coalesce(sloc, 0) DESC, coalesce(items, 0) DESC, id) QUALIFY rank <= 15",
    "derived_halstead": _DERIVED + "SELECT repo, id, round(vocabulary, 6) AS vocabulary, round(length, 6) AS length, round(volume, 6) AS volume, round(effort, 6) AS effort, round(effort / 18, 6) AS time, round(CASE WHEN eta2 > 0 THEN pow(effort, 2.0 / 3.0) / 3000 ELSE 0 END, 6) AS bugs FROM d2",
    "derived_mi": _DERIVED + "SELECT repo, id, round(cyclomatic, 6) AS cyclomatic, CASE WHEN volume > 0 AND span_sloc > 0 THEN round(171 - 5.2 * ln(volume) - 0.23 * cyclomatic - 16.2 * ln(span_sloc), 6) END AS mi, CASE WHEN volume > 0 AND span_sloc > 0 THEN round(171 - 5.2 * log2(volume) - 0.23 * cyclomatic - 16.2 * log2(span_sloc) + 50 * sin(sqrt(cloc / span_sloc * 2.4)), 6) END AS mi_sei FROM d2",
    "omit_at_floor": _BASE + "SELECT repo, id, cyclomatic, cognitive, sloc, cloc, tloc FROM me",
    "round_sig3": _BASE + f"SELECT repo, id, {_truncated('(loc / 7)')} AS by_seven, {_truncated('(items / 4096)')} AS small FROM n1",
    "stats_mean": _BASE + "SELECT repo, metric AS key, floor(avg(value) * 1000) / 1000 AS value FROM (SELECT repo, unnest([" + ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in ("sloc", "cloc", "cyclomatic", "fan_in", "fan_out", "hk")) + "], recursive := true) FROM me WHERE NOT ext) WHERE value > 0 GROUP BY ALL",
    "agg_basic": _BASE + "SELECT repo, round(sum(sloc), 6) AS sloc_sum, round(avg(sloc), 6) AS sloc_avg, min(sloc) AS sloc_min, max(sloc) AS sloc_max, CAST(nullif(count(sloc), 0) AS DOUBLE) AS sloc_count FROM me WHERE NOT ext GROUP BY repo",
    "agg_percentiles": _BASE + "SELECT repo, round(quantile_cont(sloc, 0.5), 6) AS sloc_median, round(quantile_cont(sloc, 0.9), 6) AS sloc_p90, round(quantile_cont(sloc, 0.99), 6) AS sloc_p99, round(quantile_cont(sloc, 0.999), 6) AS sloc_p999 FROM me WHERE NOT ext GROUP BY repo",
    "agg_top10_avg": _BASE + "SELECT repo, round(avg(sloc), 6) AS value FROM (SELECT repo, sloc FROM me WHERE NOT ext AND sloc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY sloc DESC) <= 10) GROUP BY repo",
    "agg_population_all": _BASE + "SELECT repo, round(avg(coalesce(sloc, 0)), 6) AS sloc_avg, round(quantile_cont(coalesce(sloc, 0), 0.5), 6) AS sloc_median, CAST(count(*) AS DOUBLE) AS sloc_count FROM me WHERE NOT ext GROUP BY repo",
    "graph_metric_compose": _BASE + f"SELECT repo, nullif(round(big, 3), 0) AS big, nullif(round(floor(big / n * 1000) / 1000, 2), 0) AS spread FROM (SELECT repo, max(sloc) - min(sloc) AS big, count(sloc) AS n FROM me WHERE NOT ext GROUP BY repo)",
    "user_metric_ratio": _BASE + "SELECT repo, id, nullif(cloc * 8 / 16, 0) AS ratio, nullif(cloc * 8 / 16, 0) * 2 AS twice FROM me WHERE NOT ext AND sloc > 0 AND nullif(cloc, 0) IS NOT NULL",
    "user_metric_path_branch": _BASE + "SELECT repo, id, nullif(CASE WHEN path ~ '[^/]\\.py$' THEN sloc * 2 WHEN contains(path, '/core/') THEN sloc * 3 ELSE sloc END, 0) AS weighted FROM me WHERE NOT ext AND sloc IS NOT NULL",
    "threshold_violations": _BASE + f"SELECT repo, 'threshold.file.' || metric AS rule, {_GROUP} AS rule_group, location, round(value / bound, 6) AS weight FROM {_OVER}",
    "threshold_messages": _BASE + f"SELECT repo, location, metric || ' ' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ' > ' || CAST(CAST(bound AS BIGINT) AS VARCHAR) AS message FROM {_OVER} WHERE metric IN ('sloc', 'fan_out')",
    "cycle_members": _BASE + "SELECT repo, id, component FROM k",
    "cycle_groups": _BASE + "SELECT repo, component, kind, size, array_to_string(nodes, ',') AS members FROM g",
    "cycle_budget": _BASE + f", {_CYC} SELECT b.repo, 'cycle.' || b.kind AS rule, coalesce(bp.source, b.nodes[1]) AS location, bp.line, CAST(b.size AS DOUBLE) AS weight FROM bad b LEFT JOIN bp USING (repo, component)",
    "multi_crate_drop": _BASE + """, cr AS (SELECT k.repo, k.component, coalesce(nullif(n.crate, ''), nullif(regexp_extract(n.id, '^(.*)/src/', 1), '')) AS crate FROM k JOIN n USING (repo, id))
      SELECT repo, component, CASE WHEN count(*) = 2 THEN 'mutual' ELSE 'chain' END AS kind, count(*) AS size FROM cr GROUP BY repo, component HAVING NOT (count(crate) = count(*) AND count(DISTINCT crate) > 1)""",
    "break_point": _BASE + f", {_CYC} SELECT * FROM bp",
    "cycle_rank": _BASE + "SELECT repo, component, kind, size, CAST(row_number() OVER (PARTITION BY repo ORDER BY CASE kind WHEN 'chain' THEN 0 ELSE 1 END, size DESC, component) AS INTEGER) AS rank FROM g QUALIFY rank <= 3",
    "check_relative_p90": _BASE + ", p AS (SELECT repo, quantile_cont(sloc, 0.9) AS p90 FROM me WHERE NOT ext GROUP BY repo) SELECT repo, id AS location, coalesce(name, '{name}') AS message FROM (SELECT me.repo, id, regexp_extract(path, '[^/]*$') AS name, sloc, p90, ext FROM me JOIN p USING (repo)) WHERE NOT ext AND sloc > p90",
    "check_depends_on": _BASE + f", {_ADJ} SELECT me.repo, me.id AS location, regexp_extract(path, '[^/]*$') AS message FROM me JOIN adj USING (repo, id) WHERE NOT ext AND len(list_filter(coalesce(deps, []), lambda x: contains(x, 'valve'))) > 0 AND len(list_filter(coalesce(rdeps, []), lambda x: contains(x, '.py'))) = 0",
    "check_siblings": _BASE + f", s AS (SELECT repo, {_DIR} AS dir, list_sort(list(DISTINCT path)) AS everyone FROM me WHERE coalesce(kind <> 'external', true) GROUP BY ALL) SELECT me.repo, id AS location, regexp_extract(path, '[^/]*$') AS message FROM me JOIN s ON s.repo = me.repo AND s.dir = {_DIR} WHERE NOT ext AND len(list_filter(everyone, lambda x: x <> path)) > 1 AND len(list_filter(everyone, lambda x: x <> path AND x LIKE '%.go')) > 0",
    "check_exists_macro": _BASE + f", {_ADJ} SELECT me.repo, me.id AS location, regexp_extract(path, '[^/]*$') AS message FROM me JOIN adj USING (repo, id) WHERE NOT ext AND (len(list_filter(coalesce(deps, []), lambda x: contains(x, 'planner'))) > 0 OR (len(rdeps) > 0 AND len(list_filter(rdeps, lambda x: NOT starts_with(x, 'ext:'))) = 0))",
    "check_regex": _BASE + "SELECT repo, id AS location, regexp_extract(path, '[^/]*$') AS message FROM me WHERE NOT ext AND regexp_matches(path, '[aeiou]r[a-z]*_[0-9a-z]+\\.(rs|go)$')",
    "defs_macro": _BASE + "SELECT repo, id AS location, CASE WHEN nm ~ '^.+\\.[^.]*$' THEN regexp_extract(nm, '^(.+)\\.[^.]*$', 1) || '.' || regexp_extract(nm, '^.+\\.([^.]*)$', 1) ELSE nm || '.' END AS message FROM (SELECT *, regexp_extract(path, '[^/]*$') AS nm FROM me) WHERE NOT ext AND sloc > 500 AND fan_in > 1",
    "message_interpolation": _BASE + "SELECT repo, id AS location, regexp_extract(path, '[^/]*$') || ' of ' || coalesce(kind, '{kind}') || ': ' || CAST(fan_in AS VARCHAR) || ' in, ' || coalesce(CAST(CAST(cloc AS BIGINT) AS VARCHAR), '{cloc}') || ' comments, {nothing}' AS message FROM me WHERE NOT ext AND fan_in >= 3",
    "violations_all": _ALL + "SELECT repo, rule, rule_group, location, CASE WHEN NOT isinf(weight) THEN round(weight, 6) END AS weight FROM va",
    "violation_breakdown": _ALL + "SELECT repo, rule_group, count(*) AS findings FROM va GROUP BY ALL",
    "findings_top": _BASE + f"SELECT repo, location, 'threshold.file.' || metric AS rule FROM {_OVER} ORDER BY value / bound DESC, location, metric LIMIT 20",
    "rule_focus": _BASE + f"SELECT repo, 'threshold.file.' || metric AS rule, location FROM {_OVER} WHERE metric IN ('sloc', 'fan_out')",
    "sarif_rules_dedup": _ALL + "SELECT rule, min(rule_group) AS rule_group FROM va GROUP BY rule",
    "suggest_config_max": _BASE + f"SELECT repo, metric, max(value) AS most FROM {_LONG} WHERE NOT ext AND value IS NOT NULL AND metric <> 'fan_out' GROUP BY ALL",
    "scorecard_principles": _BASE + f"SELECT repo, CASE metric WHEN 'hk' THEN 'coupling' WHEN 'sloc' THEN 'size' ELSE 'complexity' END AS principle, count(*) FILTER (value > {_WARN}) AS warnings, count(*) FILTER (value > {_INFO} AND value <= {_WARN}) AS infos FROM {_LONG} WHERE metric IN ({', '.join(repr(p.sort_metric) for p in PRINCIPLES[:3])}) AND coalesce(kind <> 'external', true) GROUP BY ALL",
    "breach_rows": _BASE + f""", b AS (SELECT repo, id, metric, value > {_WARN} AS warning, value / CASE WHEN value > {_WARN} THEN {_WARN} ELSE {_INFO} END AS ratio FROM {_LONG} WHERE value > {_INFO}
      UNION ALL SELECT repo, id, 'cycle', true, 1.0 FROM me WHERE cycle IS NOT NULL),
      x AS (SELECT repo, id, count(*) FILTER (warning) AS warnings, count(*) FILTER (NOT warning) AS infos, max({{'ratio': ratio, 'metric': metric}}) AS w FROM b GROUP BY ALL)
      SELECT repo, id, warnings, infos, w.metric AS worst, round(w.ratio, 6) AS ratio, CAST(row_number() OVER (PARTITION BY repo ORDER BY warnings DESC, infos DESC, coalesce(hk, 0) DESC, id) AS INTEGER) AS rank FROM x JOIN me USING (repo, id) QUALIFY rank <= 15""",
    "rank_metric": _BASE + "SELECT repo, id, cyclomatic AS value, CAST(row_number() OVER (PARTITION BY repo ORDER BY cyclomatic DESC, coalesce(sloc, 0) DESC, coalesce(items, 0) DESC, id) AS INTEGER) AS rank FROM me WHERE cyclomatic IS NOT NULL AND coalesce(kind <> 'external', true) QUALIFY rank <= 10",
    "tier_counts": _BASE + f"SELECT repo, metric, count(*) FILTER (value > {_WARN}) AS warnings, count(*) FILTER (value > {_INFO}) AS infos FROM {_LONG} WHERE value IS NOT NULL AND metric IN ('hk', 'sloc', 'cyclomatic') GROUP BY ALL",
    "warning_types": _BASE + "SELECT repo, " + " + ".join(f"CAST(coalesce(bool_or({m} > {v}), false) AS INTEGER)" for m, v in LIMITS.items()) + " + CAST(bool_or(cycle IS NOT NULL) AS INTEGER) AS types FROM me WHERE NOT ext GROUP BY repo",
    "connections": _BASE + ", s AS (SELECT repo, id FROM me WHERE hk IS NOT NULL AND coalesce(kind <> 'external', true) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY hk DESC, coalesce(sloc, 0) DESC, coalesce(items, 0) DESC, id) <= 5) SELECT e.repo, source, target, e.kind, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'common' WHEN b.id IS NOT NULL THEN 'in' ELSE 'out' END AS side FROM e LEFT JOIN s a ON a.repo = e.repo AND a.id = source LEFT JOIN s b ON b.repo = e.repo AND b.id = target WHERE a.id IS NOT NULL OR b.id IS NOT NULL",
    "diff_nodes": _DIFF + "SELECT * FROM nd",
    "diff_edges": _DIFF + "SELECT * FROM ed2",
    "diff_cycles": _DIFF + """, bu AS (SELECT DISTINCT be.repo, source, target FROM be WHERE kind = 'uses' AND EXISTS (SELECT 1 FROM bn WHERE bn.repo = be.repo AND bn.id = source) AND EXISTS (SELECT 1 FROM bn WHERE bn.repo = be.repo AND bn.id = target)),
      br AS (SELECT repo, source AS a, target AS b FROM bu UNION SELECT br.repo, br.a, bu.target FROM br JOIN bu ON bu.repo = br.repo AND bu.source = br.b),
      bk AS (SELECT DISTINCT x.repo, x.a AS id FROM br x WHERE x.a = x.b), ck AS (SELECT DISTINCT repo, id FROM k)
      SELECT coalesce(bk.repo, ck.repo) AS repo, coalesce(bk.id, ck.id) AS id, CASE WHEN bk.id IS NULL THEN 'current' WHEN ck.id IS NULL THEN 'baseline' ELSE 'both' END AS status FROM bk FULL JOIN ck ON bk.repo = ck.repo AND bk.id = ck.id""",
    "new_violations": _DIFF + "SELECT * FROM ch",
    "verdict": _DIFF + "SELECT repo, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'resolved') AS resolved, CASE WHEN count(*) FILTER (status = 'new') > 0 THEN 'degraded' ELSE 'improved' END AS verdict FROM ch GROUP BY repo",
    "group_status": _DIFF + "SELECT repo, coalesce(split_part(id, '/', 2), '') AS kind, CASE WHEN bool_or(status IN ('unchanged', 'affected')) OR (bool_or(status = 'removed') AND bool_or(status = 'added')) THEN 'both' WHEN bool_or(status = 'removed') THEN 'baseline' ELSE 'current' END AS status FROM nd GROUP BY ALL",
    "ignore_glob": _BASE + ", i AS (SELECT repo, id FROM (SELECT repo, id, regexp_replace(id, '^\\{[^}]*\\}/', '') AS b FROM n) WHERE b LIKE '%core/%' OR b LIKE 'ext:a%' OR b LIKE '%/%.py' OR b LIKE '%/%.go') SELECT repo, source, target, kind FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.repo = e.repo AND i.id IN (e.source, e.target))",
    "focus_path": _BASE + "SELECT repo, id FROM me WHERE path IN ('area00', 'src/core') OR starts_with(path, 'area00/') OR starts_with(path, 'src/core/')",
    "relativize": _BASE + "SELECT repo, id, CASE WHEN a = '/work/area00' THEN '{area}' WHEN starts_with(a, '/work/area00/') THEN '{area}' || a[13:] WHEN a = '/work' THEN '{target}' WHEN starts_with(a, '/work/') THEN '{target}' || a[6:] WHEN starts_with(a, '/') THEN '{top}' || a ELSE a END AS short FROM (SELECT repo, id, regexp_replace(id, '^\\{target\\}', '/work') AS a FROM n1)",
    "path_parts": _BASE + "SELECT repo, id, nm AS p_name, CASE WHEN nm ~ '^.+\\.[^.]*$' THEN regexp_extract(nm, '^(.+)\\.[^.]*$', 1) ELSE nm END AS p_stem, regexp_extract(nm, '^.+\\.([^.]*)$', 1) AS p_ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS p_dir FROM (SELECT *, regexp_extract(path, '[^/]*$') AS nm FROM n1)",
    "path_normalize": _BASE + "SELECT repo, source, target, kind, array_to_string(list_filter(string_split(CASE WHEN contains(source, '/') THEN regexp_replace(source, '/[^/]*$', '') ELSE '' END || '/' || target, '/'), lambda x: x <> '' AND x <> '.'), '/') AS joined FROM e",
    "test_paths": _BASE + "SELECT repo, id FROM n1 WHERE len(list_intersect(string_split(path, '/')[1:-2], ['tests', 'valve', 'src', 'area00'])) > 0 OR regexp_extract(path, '[^/]*$') LIKE 'map%' OR path LIKE '%\\_3.py' ESCAPE '\\'",
    "adjacency_lists": _BASE + "SELECT n.repo, n.id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT target)), ',') FROM e WHERE e.repo = n.repo AND e.source = n.id), '') AS deps, coalesce((SELECT array_to_string(list_sort(list(DISTINCT source)), ',') FROM e WHERE e.repo = n.repo AND e.target = n.id), '') AS rdeps FROM n",
    "dig_in": _BASE + f"SELECT repo, coalesce(nullif(concat_ws('/', nullif(crate, ''), nullif(string_split({_DIR}, '/')[1], '')), ''), '_root') AS key, count(*) AS members FROM me WHERE NOT ext GROUP BY ALL",
    "dig_out": _BASE + f"SELECT repo, {_folder_key(2)} AS key, count(*) AS members FROM me WHERE NOT ext GROUP BY ALL",
    "group_counts": _BASE + " UNION ALL ".join(f"SELECT repo, {d} AS depth, count(DISTINCT {_folder_key(d)}) AS groups FROM me WHERE NOT ext GROUP BY repo" for d in range(5)),
    "grouping_sets_rollup": _BASE + f", x AS (SELECT repo, id, {_DIR} AS folder, coalesce(crate, '') AS crate, cycle, sloc, CAST(fan_in AS DOUBLE) AS fan_in FROM me WHERE NOT ext) SELECT repo, CASE WHEN grouping(id) = 0 THEN 'file' WHEN grouping(folder) = 0 THEN 'folder' ELSE 'crate' END AS level, coalesce(id, folder, crate) AS key, count(*) AS members, count(cycle) AS in_cycle, sum(sloc) AS sloc, sum(fan_in) AS fan_in FROM x GROUP BY GROUPING SETS ((repo, id), (repo, folder), (repo, crate))",
    "group_edges": _BASE + f", x AS (SELECT repo, id, {_folder_key(1)} AS grp FROM me) SELECT e.repo, a.grp AS source_group, b.grp AS target_group, bool_or(e.kind = 'uses') AS flow FROM e JOIN x a ON a.repo = e.repo AND a.id = source JOIN x b ON b.repo = e.repo AND b.id = target WHERE a.grp <> b.grp GROUP BY ALL",
    "group_stats_lcp": _BASE + f", x AS (SELECT * REPLACE (coalesce(crate, '') AS crate) FROM me WHERE NOT ext) SELECT a.*, b.root FROM (SELECT repo, crate, count(*) AS files, count(DISTINCT {_DIR}) AS folders, sum(coalesce(sloc, CAST(loc AS DOUBLE), 0)) AS sloc, sum(coalesce(hk, 0)) AS hk, count(cycle) AS in_cycle FROM x GROUP BY repo, crate) a JOIN {_lcp('repo, crate', 'x')} b USING (repo, crate)",
    "crate_roots": _BASE + f", x AS (SELECT * FROM me WHERE NOT ext AND crate IS NOT NULL) SELECT repo, crate, regexp_replace(root, '((^|/)(src|tests|benches|lib|bin))+$', '') AS root FROM {_lcp('repo, crate', 'x')}",
    "summary_distribution": _BASE + f"SELECT repo, metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, {_q('0.01')} AS p1, {_q('0.1')} AS p10, {_q('0.5')} AS p50, {_q('0.9')} AS p90, {_q('0.99')} AS p99 FROM {_LONG} WHERE value > 0 AND metric IN ('sloc', 'fan_in', 'cyclomatic') GROUP BY ALL",
    "summary_counts": _BASE + f", i AS (SELECT * FROM me WHERE NOT ext), l AS (SELECT e.repo, count(*) AS edges FROM e JOIN i a ON a.repo = e.repo AND a.id = source JOIN i b ON b.repo = e.repo AND b.id = target GROUP BY e.repo) SELECT i.repo, count(*) AS nodes, count(DISTINCT {_DIR}) AS folders, count(DISTINCT crate) AS crates, count(cycle) AS in_cycles, sum(coalesce(sloc, 0)) AS sloc, coalesce(any_value(l.edges), 0) AS edges FROM i LEFT JOIN l USING (repo) GROUP BY i.repo",
    "upper_median": _BASE + "SELECT repo, list_sort(list(sloc))[CAST(floor(count(sloc) / 2) AS BIGINT) + 1] AS median FROM me WHERE sloc > 0 GROUP BY repo",
    "depth_extremes": _BASE + f"SELECT repo, CAST(max(CASE WHEN {_DIR} = '' THEN 0 ELSE len(string_split({_DIR}, '/')) END) AS INTEGER) AS file_depth, CAST(max(CASE WHEN coalesce(crate, '') = '' THEN 0 ELSE len(string_split(crate, '/')) END) AS INTEGER) AS crate_depth FROM me WHERE NOT ext GROUP BY repo",
    "neighbour_groups": _BASE + ", x AS (SELECT repo, id, coalesce(crate, '') AS crate, regexp_matches(path, '^[a-m]') AS inside FROM me WHERE NOT ext), y AS (SELECT e.repo, CASE WHEN b.inside THEN 'caller' ELSE 'dependency' END AS side, CASE WHEN b.inside THEN a.crate ELSE b.crate END AS crate, CASE WHEN e.kind = 'uses' THEN CASE WHEN b.inside THEN e.source ELSE e.target END END AS file FROM e JOIN x a ON a.repo = e.repo AND a.id = source JOIN x b ON b.repo = e.repo AND b.id = target WHERE a.inside <> b.inside), z AS (SELECT repo, side, crate, count(DISTINCT file) AS files FROM y GROUP BY ALL) SELECT * FROM z WHERE side = 'caller' OR NOT EXISTS (SELECT 1 FROM z q WHERE q.repo = z.repo AND q.crate = z.crate AND q.side = 'caller')",
    "function_split": _BASE + "SELECT repo, id FROM n0 WHERE contains(id, '#')",
    "orphan_functions": "WITH l AS (SELECT repo, id, parent FROM nodes QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY seen_at DESC, parent DESC NULLS LAST) = 1) SELECT a.repo, a.id FROM l a WHERE contains(a.id, '#') AND EXISTS (SELECT 1 FROM l b WHERE b.repo = a.repo AND NOT contains(b.id, '#') AND b.id = a.parent)",
    "reachable": _BASE + ", w AS (SELECT repo, id FROM n0 WHERE kind = 'module' UNION SELECT w.repo, e.target FROM w JOIN e ON e.repo = w.repo AND e.source = w.id AND e.kind = 'uses') SELECT repo, id FROM w",
    "present_columns": _BASE + "SELECT repo, unnest(['kind', 'external', 'crate', 'visibility', 'items']) AS column, unnest([count(kind), count(external), count(crate), count(visibility), count(items)]) AS rows FROM n0 GROUP BY repo",
    "used_roots": _BASE + "SELECT DISTINCT repo, root FROM (SELECT repo, regexp_extract(id, '^\\{([^}]+)\\}', 1) AS root FROM n0 UNION ALL SELECT repo, 'target' FROM n0) WHERE root <> ''",
    "abbreviations": _BASE + "SELECT repo, id, CASE WHEN hk >= 1e9 THEN regexp_replace(printf('%.1f', round(hk / 1e9, 1)), '\\.0$', '') || 'B' WHEN hk >= 1e6 THEN regexp_replace(printf('%.1f', round(hk / 1e6, 1)), '\\.0$', '') || 'M' WHEN hk >= 1e3 THEN regexp_replace(printf('%.1f', round(hk / 1e3, 1)), '\\.0$', '') || 'K' WHEN hk = floor(hk) THEN printf('%.0f', hk) ELSE regexp_replace(printf('%.2f', hk), '0$', '') END AS shown FROM me WHERE hk IS NOT NULL",
    "disjoint_ids": _BASE + "SELECT id FROM n1 WHERE NOT ext GROUP BY id HAVING count(DISTINCT repo) > 1",
    "markdown_metrics": r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM documents WHERE regexp_matches(lower(path), '\.(md|markdown)$')),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
f AS (SELECT *, regexp_matches(line, '^\s{0,3}(```|~~~)') AS fence FROM x),
g AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS open FROM f),
h AS (SELECT *, NOT fence AND NOT open AS plain, length(regexp_extract(line, '^(#{1,6})\s', 1)) AS depth FROM g)
SELECT doc_id, count(*) FILTER (plain AND depth > 0) AS headings, CAST(coalesce(max(depth) FILTER (plain), 0) AS INTEGER) AS max_depth, count(*) FILTER (open AND NOT fence) AS code_lines,
  CAST(coalesce(sum(len(list_filter(regexp_extract_all(line, '(.?)\[[^\]]*\]\([^()\s]+[^()]*\)'), lambda m: NOT starts_with(m, '!')))) FILTER (plain), 0) AS BIGINT) AS links
FROM h GROUP BY doc_id""",
}
