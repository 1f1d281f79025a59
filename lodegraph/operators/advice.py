"""Advice on top of rules: tiers, what a prompt is about, rule texts, per-language rules, views."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.model import Metric, Principle
from lodegraph.operators.rules import ranked
from lodegraph.sources.config import merge, patch_list

Tiers = dict[str, tuple[float | None, float]]


def tiers(advice: Mapping[str, tuple[float | None, float | None]], gates: Mapping[str, float]) -> Tiers:
    """(info, warning) of each metric: a gate's limit is the warning, and an info limit stays only below it; without either a metric has none."""
    out: Tiers = {}
    for key in sorted({*advice, *gates}):
        info, warning = advice.get(key, (None, None))
        warning = gates.get(key, warning)
        if warning is None:
            warning = info
        if warning is not None:
            out[key] = (info if info is not None and info < warning else None, warning)
    return out


def auto_tier(warnings: int, infos: int, tier: str = "auto") -> tuple[str, int]:
    """The tier that is shown and its count: warnings if there are any, else infos."""
    if tier == "auto":
        tier = "warning" if warnings > 0 else "info"
    return tier, warnings if tier == "warning" else infos


def prompt_size(count: int, top: int | None = None, cycle_members: int | None = None) -> int:
    """How many modules a prompt names: all members of cycles, else ``top``, else the tier's count, at least one."""
    if cycle_members is not None:
        return cycle_members
    return top if top is not None else max(count, 1)


def narrowed(df: DataFrame, by: list[str], metric: str, limits: tuple[float | None, float], top: int) -> DataFrame:
    """(by, id, value, tier, rank): the worst nodes by one metric, with warning, info or "-"."""
    rows = df.filter(F.col(metric).isNotNull() & F.coalesce(F.col("kind") != "external", F.lit(True)))
    rows = rows.withColumn("rank", F.row_number().over(ranked(rows, by, metric))).filter(F.col("rank") <= top)
    info, warning = limits
    tier = F.when(F.col(metric) > warning, "warning")
    tier = tier.when(F.col(metric) > info, "info") if info is not None else tier
    return rows.select(*by, "id", F.col(metric).cast("double").alias("value"), tier.otherwise("-").alias("tier"), "rank")


def resolve_focus(name: str, principles: Sequence[Principle], metrics: Sequence[str]) -> tuple[str, str]:
    """("principle", id), ("metric", key) or ("cycle", "cycle") that a name stands for: an exact principle, else its last segment as a metric; otherwise an error that lists the options."""
    if any(p.id == name for p in principles):
        return "principle", name
    last = name.rsplit(".", 1)[-1].lower()
    if last == "cycle":
        return "cycle", "cycle"
    if last in metrics:
        return "metric", last
    raise ValueError(f"no principle or metric '{name}'; there are {', '.join([*(p.id for p in principles), *metrics, 'cycle'])}")


def resolve_report_language(asked: str | None, languages: Sequence[str], holders: Sequence[str] = ()) -> str:
    """The language of a report: the one asked for, the only one, the only one that holds a given id, else the first; several holders are an error."""
    if asked:
        if asked not in languages:
            raise ValueError(f"no such language: {asked}; there are {', '.join(languages)}")
        return asked
    if len(languages) == 1:
        return languages[0]
    if len(holders) > 1:
        raise ValueError(f"several languages hold it: {', '.join(sorted(holders))}; name one")
    if holders:
        return holders[0]
    if not languages:
        raise ValueError("there is no language")
    return languages[0]


def rule_text(rule: str, texts: Mapping[str, Mapping[str, str]], language: str = "") -> dict[str, str]:
    """why, fix and tune of a rule: its own, else those of its kind (its name up to the last dot), with {lang} filled in."""
    own = {**texts.get(rule.rsplit(".", 1)[0], {}), **texts.get(rule, {})}
    kind, _, key = rule.rpartition(".")
    hints = {"threshold.file": f"raise [rules.thresholds.file] {key} = <limit>", "cycle": f"set [rules.cycles] {key} = <budget>, or false", "check": f"change [rules.checks.{key}]"}
    own.setdefault("tune", hints.get(kind, ""))
    return {k: v.replace("{lang}", language) for k, v in own.items()}


def rules_of(config: Mapping[str, Any], language: str) -> dict[str, Any]:
    """The rules for a language: those for all, overlaid by its own under ``languages.<name>.rules``."""
    return merge(dict(config.get("rules", {})), config.get("languages", {}).get(language, {}).get("rules", {}))


def per_language(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of each language, evaluated with its own rules, tagged with it."""
    return reduce(DataFrame.unionByName, [rows.withColumn("language", F.lit(name)) for name, rows in sorted(parts.items())])


def merge_maps(maps: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """Roots or versions of several languages in one; the last writer of a key wins."""
    return reduce(lambda a, b: {**a, **b}, maps, {})


def export_config(defaults: Mapping[str, Any], project: Mapping[str, Any], plugins: Mapping[str, Mapping[str, Any]]) -> str:
    """The whole configuration in force, and the base of each language, as JSON with sorted keys."""
    return json.dumps({"config": merge(dict(defaults), project), "plugins": {k: dict(v) for k, v in plugins.items()}}, sort_keys=True, indent=2, ensure_ascii=False)


def view(base: Mapping[str, Any], patch: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A view (columns, card, size, filter, default_sort, stats) with its lists patched."""
    out = dict(base)
    for key, change in (patch or {}).items():
        out[key] = patch_list(base.get(key, []), change) if isinstance(base.get(key), list) else change
    return out


def specs(catalog: Sequence[Metric], overrides: Mapping[str, Mapping[str, str]], doc_base: str = "", language: str = "") -> dict[str, dict[str, Any]]:
    """What is shown of each metric: catalog entries with a language's fields laid over them, and the address of its documentation."""
    out = {}
    for m in catalog:
        spec = {"key": m.key, "formula": m.formula, "group": m.group, "direction": "higher" if m.higher_better else "lower", "omit_at": m.omit_at}
        own = overrides.get(m.key, {})
        if doc_base:
            spec["doc_url"] = f"{doc_base.rstrip('/')}/{language if own else 'base'}/{m.key}.md"
        out[m.key] = spec | dict(own)
    return out


def pruned(catalog: Mapping[str, Any], present: Sequence[str]) -> dict[str, Any]:
    """The entries of a dictionary that the graph has, in its order."""
    kept = set(present)
    return {k: v for k, v in catalog.items() if k in kept}


def summary_markdown(rows: Sequence[Row]) -> str:
    """The summary's statistics, with what changed, as a Markdown table."""
    lines = ["| metric | stat | value | delta |", "|---|---|---|---|"]
    return "\n".join([*lines, *(f"| {r['metric']} | {r['stat']} | {r['value']:g} | {r['delta']:+g} |" for r in sorted(rows, key=lambda r: (r["metric"], r["stat"])))]) + "\n"


def summary_json(rows: Sequence[Row]) -> str:
    """The same as JSON."""
    return json.dumps([r.asDict() for r in sorted(rows, key=lambda r: (r["metric"], r["stat"]))], sort_keys=True, indent=2)


def facts(df: DataFrame, by: list[str], columns: Sequence[str]) -> DataFrame:
    """(by, columns): the distinct values of each column, sorted and joined by commas; null for none. Facts of one node are few."""
    listed = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")).alias(c)
    return df.groupBy(*by).agg(*[listed(c) for c in columns])


def extension_owners(languages: DataFrame) -> DataFrame:
    """(ext, owners): how many languages of (language, extensions) claim an extension; more than one is an error of a configuration."""
    return languages.select("language", F.explode("extensions").alias("ext")).select("language", F.lower("ext").alias("ext")).groupBy("ext").agg(F.count_distinct("language").alias("owners"))


def roll_up(nodes: DataFrame, by: list[str], value: str = "loc", parent: str = "parent") -> DataFrame:
    """(by, id, value): the sum of the values of the nodes directly below each parent, such as the lines of a crate's modules."""
    return nodes.filter(F.col(parent).isNotNull()).groupBy(*by, F.col(parent).alias("id")).agg(F.sum(value).alias(value))


def collapse(edges: DataFrame, homes: DataFrame, by: list[str], crates: DataFrame | None = None) -> DataFrame:
    """Edges between modules as edges between the files of (by, id, file) they live in, one of each kind; those within a file, and between two ``crates``, go."""
    if crates is not None:
        marks = crates.select(*by, "id").distinct().withColumn("is", F.lit(True))
        edges = edges.join(marks.withColumnsRenamed({"id": "source", "is": "a"}), [*by, "source"], "left").join(marks.withColumnsRenamed({"id": "target", "is": "b"}), [*by, "target"], "left")
        edges = edges.filter("a is null or b is null").drop("a", "b")
    ends = lambda c: homes.select(*by, F.col("id").alias(c), F.col("file").alias(f"{c}_file"))
    rows = edges.join(ends("source"), [*by, "source"], "left").join(ends("target"), [*by, "target"], "left")
    rows = rows.select(*by, F.coalesce("source_file", "source").alias("source"), F.coalesce("target_file", "target").alias("target"), "kind", "line").filter("source <> target")
    return rows.groupBy(*by, "source", "target", "kind").agg(F.min("line").alias("line"))


def root_files(files: DataFrame, by: list[str], crate: str = "crate") -> DataFrame:
    """(by, crate, path): the root file of each crate: its lib.rs, else its main.rs, else its least path."""
    rank = F.when(F.col("path").rlike(r"(?:^|/)lib\.rs$"), 0).when(F.col("path").rlike(r"(?:^|/)main\.rs$"), 1).otherwise(2)
    return files.groupBy(*by, crate).agg(F.min(F.struct(rank.alias("rank"), "path")).alias("r")).select(*by, crate, "r.path")


def file_backed(modules: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """One row per path: the module that the file itself holds (no line) before inline ones, of those the first by line."""
    order = Window.partitionBy(*by, path).orderBy(F.col("line").asc_nulls_first(), "id")
    return modules.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")
