"""From source files to a measured graph, its report and its check, for all repositories at once.

Files are rows (by, path, text), from ``sources.files.walk`` or any table. Languages are plugins: a
table function for edges and one for counts; see ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.model import INPUTS, CheckDef
from lodegraph.operators import diff, graph, metrics, rules
from lodegraph.sources import imports
from lodegraph.sources.dialects import DIALECTS, measure_sources
from lodegraph.sources.markdown import measure as measure_markdown
from lodegraph.workspace import materialize

Extract = Callable[[DataFrame, list[str]], DataFrame]


@dataclass(frozen=True)
class Plugin:
    """A language: its extensions, other files it reads, and how edges come from files of (by, path, text)."""

    name: str
    extensions: tuple[str, ...]
    edges: Extract
    reads: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()


_registry: dict[str, Plugin] = {}


def register(plugin: Plugin) -> None:
    """Add a language; a name again replaces it, an extension that another language has is an error."""
    for other in _registry.values():
        shared = set(other.extensions) & set(plugin.extensions)
        if other.name != plugin.name and shared:
            raise ValueError(f"{other.name} and {plugin.name} both claim .{min(shared)}")
    _registry[plugin.name] = plugin


def registry() -> dict[str, Plugin]:
    """All languages by name."""
    return dict(sorted(_registry.items()))


_OF = {d.name: d.extensions for d in DIALECTS}
register(Plugin("python", ("py",), imports.python_imports, aliases=("py",)))
register(Plugin("script", (*_OF["js"], *_OF["ts"]), imports.script_imports, aliases=("js", "ts", "javascript", "typescript")))
register(Plugin("go", _OF["go"], imports.go_imports, reads=("go.mod",), aliases=("golang",)))
register(Plugin("c", _OF["c"], imports.c_includes, aliases=("cpp",)))
register(Plugin("csharp", _OF["csharp"], imports.csharp_usings, aliases=("cs",)))
register(Plugin("rust", _OF["rust"], imports.rust_uses, aliases=("rs",)))


@dataclass(frozen=True)
class Analysis:
    """nodes: files and externals with reported metrics; functions: units with their own; edges; cycles; raw: inputs of files."""

    nodes: DataFrame
    functions: DataFrame
    edges: DataFrame
    cycles: DataFrame


def import_edges(files: DataFrame, by: list[str], languages: list[str] | None = None) -> DataFrame:
    """(by, source, target, kind, line, visibility) of all languages, or those named."""
    known = registry()
    names = {a: p.name for p in known.values() for a in (p.name, *p.aliases)}
    unknown = sorted(set(languages or []) - set(names))
    if unknown:
        raise ValueError(f"no such language: {', '.join(unknown)}; known are {', '.join(known)}")
    chosen = [known[n] for n in dict.fromkeys(names[x] for x in languages)] if languages else list(known.values())
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.element_at(F.split("path", "/"), -1)
    parts = [p.edges(files.filter(end.isin(*p.extensions) | name.isin(*p.reads) if p.reads else end.isin(*p.extensions)), by) for p in chosen]
    return reduce(DataFrame.unionByName, parts).withColumn("visibility", F.lit(None).cast("string"))


def analyze(files: DataFrame, by: list[str], languages: list[str] | None = None) -> Analysis:
    """The measured graph of source files of (by, path, text).

    Each file is a node, and each external target of an import; nodes get their counts by a left
    join, so files that can't be measured stay, without metrics. Of several rows of one path the greatest text counts; a null path is left out.
    """
    files = materialize(files.filter("path is not null").groupBy(*by, "path").agg(F.max("text").alias("text")))
    edges = import_edges(files, by, languages)
    inner = files.select(*by, F.col("path").alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(False).alias("external"), "path")
    outer = edges.filter(F.startswith("target", F.lit("ext:"))).select(*by, F.col("target").alias("id")).distinct()
    outer = outer.select(*by, "id", F.lit("external").alias("kind"), F.substring("id", 5, 1 << 30).alias("name"), F.lit(True).alias("external"), F.lit(None).cast("string").alias("path"))
    nodes, edges = graph.finalize(inner.unionByName(outer), edges, by)
    edges = materialize(edges)
    measured = materialize(measure_sources(files.withColumn("id", F.col("path")), by))
    values = metrics.emitted(metrics.derive(measured))
    units = values.filter("kind <> 'file'").join(nodes.select(*by, F.col("id").alias("parent")), [*by, "parent"], "left_semi")
    counts = values.filter("kind = 'file'").drop("kind", "parent", "start_line", "end_line")
    nodes = nodes.join(counts, [*by, "id"], "left").join(graph.coupling(nodes, edges, by), [*by, "id"], "left")
    nodes = metrics.with_hk(nodes).withColumn("hk", F.when(~graph.is_external(), F.col("hk")))
    nodes = nodes.withColumns({"crate": F.lit(None).cast("string"), "items": F.lit(None).cast("bigint"), "loc": F.col("sloc").cast("bigint")})
    nodes = materialize(nodes)
    groups = materialize(graph.cycles(graph.strong_components(nodes, edges, by), nodes, by))
    members = groups.select(*by, F.explode("nodes").alias("id"), F.col("kind").alias("cycle"))
    return Analysis(nodes.join(members, [*by, "id"], "left"), units, edges, groups)


def report(files: DataFrame, by: list[str], stats_of: list[str] | None = None, **more: object) -> dict[str, DataFrame]:
    """nodes, functions, edges, cycles, stats of the graph, and counts of Markdown files."""
    done = analyze(files, by, **more)
    keys = stats_of or [k for k in (*INPUTS, "cyclomatic", "hk", "fan_in", "fan_out") if k in done.nodes.columns]
    pages = files.filter(F.lower("path").rlike(r"\.(?:md|markdown)$")).withColumn("_page", F.struct(*by, "path"))
    pages = measure_markdown(pages, "_page", "text").select("_page.*", "headings", "max_depth", "code_lines", "links")
    inner = done.nodes.filter(~graph.is_external())
    return {"nodes": done.nodes, "functions": done.functions, "edges": done.edges, "cycles": done.cycles, "stats": metrics.stats(inner, by, keys), "pages": pages}


def check(files: DataFrame, by: list[str], *, limits: dict[str, float], budgets: dict[str, int | None], checks: list[CheckDef] = (), baseline: DataFrame | None = None, **more: object) -> DataFrame:
    """Violations of all rules; with ``baseline``, the files of an earlier state, those that are new or resolved since."""
    run = lambda x: (lambda a: rules.all_violations(a.nodes, a.edges, a.cycles, by, limits=limits, budgets=budgets, checks=list(checks)))(analyze(x, by, **more))
    return diff.new_and_resolved(run(baseline), run(files), by) if baseline is not None else run(files)
