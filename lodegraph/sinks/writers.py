"""Reports in several formats. Rows are written by Spark; a document is one text and holds all findings, unless a top is asked for."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from html import escape
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodegraph.operators.rules import sarif_rules

def findings(violations: DataFrame, top: int | None = None) -> Iterator[Row]:
    """The findings for a document, heaviest first: all of them unless ``top`` is given, fetched partition by partition."""
    rows = violations.orderBy(F.desc("weight"), "rule", "location", "message")
    return (rows if top is None else rows.limit(top)).toLocalIterator()


def write_findings(violations: DataFrame, path: str) -> None:
    """All findings as JSON lines, one file per partition."""
    violations.write.mode("overwrite").json(path)


def canonical_graph(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, key, json): nodes by id and edges by (source, target, kind) as JSON with sorted keys, ordered by range."""

    def rows(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
        return df.select(*by, F.lit(kind).alias("kind"), F.concat_ws("\u0000", *keys).alias("key"), F.to_json(F.struct(*sorted(c for c in df.columns if c not in by))).alias("json"))

    return rows(nodes, "node", ["id"]).unionByName(rows(edges, "edge", ["source", "target", "kind"])).orderBy(*by, F.desc("kind"), "key")


def canonical_json(value: Any, compact: bool = False) -> str:
    """JSON with keys in order."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2}))


def html_report(current: str, baseline: str | None = None, title: str = "Report") -> str:
    """One page that holds the reports as JSON."""
    safe = lambda text: text.replace("</", "<\\/")
    embed = lambda which, text: f'<script type="application/json" id="cs-{which}">{safe(text)}</script>'
    body = embed("current", current) + (embed("baseline", baseline) if baseline else "")
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>{body}</body></html>\n'


def _number(weight: float) -> float | None:
    return weight if weight == weight and abs(weight) != float("inf") else None


# Fixed values below: the keys of SARIF and of code quality reports, the syntax of annotations.
def sarif(violations: DataFrame, tool: str = "lodegraph", top: int | None = None, language: str = "") -> str:
    """SARIF 2.1.0: each rule once; results with a fingerprint of language, rule and location."""
    rules = [{"id": r["rule"], "properties": {"group": r["rule_group"]}, "fullDescription": {"text": r["why"] or r["rule"]}} for r in sarif_rules(violations).orderBy("rule").collect()]
    place = {r["id"]: i for i, r in enumerate(rules)}
    results = [
        {
            "ruleId": v["rule"], "ruleIndex": place[v["rule"]], "level": "warning", "message": {"text": v["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": v["location"]}, "region": {"startLine": v["line"] or 1}}}],
            "partialFingerprints": {"signature": f"{language}:{v['rule']}:{v['location']}"},
        }
        for v in findings(violations, top)
    ]
    return canonical_json({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def code_quality(violations: DataFrame, top: int | None = None, language: str = "") -> str:
    """A list of issues, each of severity major."""
    issues = [{"description": v["message"], "check_name": v["rule"], "fingerprint": f"{language}:{v['rule']}:{v['location']}", "severity": "major", "location": {"path": v["location"], "lines": {"begin": v["line"] or 1}}} for v in findings(violations, top)]
    return canonical_json(issues)


def diagnostics(violations: DataFrame, style: str = "human", top: int | None = None) -> str:
    """human, json, github or prompt."""
    rows = findings(violations, top)
    if style == "json":
        return canonical_json([r.asDict() | {"weight": _number(r["weight"])} for r in rows])
    make = {
        "human": lambda r: f"{r['rule']} [{r['rule_group']}] {r['location']}{':' + str(r['line']) if r['line'] else ''}: {r['message']}",
        "github": lambda r: f"::warning file={r['location']},line={r['line'] or 1},title={r['rule']}::{r['message']}",
        "prompt": lambda r: f"- `{r['location']}`: {r['message']}" + (f" {r['fix']}" if r["fix"] else ""),
    }[style]
    return "\n".join(map(make, rows))


def scorecard_text(scorecard: DataFrame, worst: DataFrame, top: int = 15) -> str:
    """Principles by breaches, then the worst modules."""
    rows = scorecard.orderBy(F.desc("warnings"), F.desc("infos"), "principle").collect()  # one row per principle
    lines = [f"{r['principle']:<16} {r['warnings']:>6} {r['infos']:>6}  {r['top'] or '-'}" for r in rows]
    modules = worst.orderBy("rank", "id").limit(top).collect()
    body = [f"{r['rank']:>3}. {r['id']} ({r['warnings']} warnings, {r['infos']} infos, {r['worst']} {r['ratio']:.1f}×)" for r in modules]
    return "\n".join([f"{'principle':<16} {'warn':>6} {'info':>6}  worst", *lines, "", "Worst modules", *(body or ["(none)"])])


def prompt_text(title: str, intro: str, modules: Iterable[Row], edges: Iterable[Row]) -> str:
    """A prompt on the worst modules with their connections by side."""
    edges = list(edges)
    lines = [f"# {title}", "", intro, "", "## Modules", *(f"{r['rank']}. `{r['id']}` ({r['value']:g})" for r in modules)]
    for side in ("common", "in", "out"):
        own = [f"- `{e['source']}` → `{e['target']}`" for e in edges if e["side"] == side]
        if own:
            lines += ["", f"## Connections: {side}", *own]
    return "\n".join(lines) + "\n"


def suggested_config(most: Iterable[Row], counts: dict[str, int]) -> str:
    """TOML limits that the present graph just meets."""
    lines = ["[rules.cycles]", *(f"{k} = {v}" for k, v in sorted(counts.items())), "", "[rules.thresholds.file]"]
    return "\n".join([*lines, *(f"{r['metric']} = {r['most']:g}" for r in sorted(most, key=lambda r: r["metric"]))]) + "\n"


def write(text: str, target: str) -> None:
    """A document into a file, whose folders are made, or for "stdout" and "-" onto the screen."""
    if target in ("stdout", "-"):
        print(text)
        return
    path = Path(target)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, "utf-8")


def file_name(template: str, *, project: str = "project", commit: str = "", at: datetime | None = None) -> str:
    """A name with {project-dir}, {ts}, {git-hash} and {git-hash-N} filled in."""
    import re

    stamp = (at or datetime.now(UTC)).strftime("%Y%m%d-%H%M%S")
    slug = re.sub(r"[^A-Za-z0-9._-]+", "-", project).strip("-") or "project"
    out = template.replace("{project-dir}", slug).replace("{ts}", stamp).replace("{git-hash}", commit or "nogit")
    return re.sub(r"\{git-hash-(\d+)\}", lambda m: commit[: int(m[1])] or "nogit", out)


def formats(flags: dict[str, bool], paths: dict[str, str | None], enabled: dict[str, bool]) -> list[str]:
    """Formats that are on: by flag or path, else by setting, else by a path in the settings; json and html if none is."""
    chosen = [f for f in ("json", "html", "sarif", "codequality", "scorecard") if flags.get(f) or paths.get(f) or enabled.get(f)]
    return chosen or ["json", "html"]
