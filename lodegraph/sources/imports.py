"""Import edges of source files: each language's statements, resolved against the files of the repository.

All extractors take files (by, path, text) and give edges (by, source, target, kind, line); a
target outside is ``ext:<name>``. Python is read by its syntax trees, scripts by their tokens, the others by patterns on lines.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import normalized, parts


def _lines(files: DataFrame, by: list[str]) -> DataFrame:
    lines = files.select(*by, "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "code"))
    return lines.withColumn("line", F.col("at") + 1).drop("at")


def _modules(files: DataFrame, by: list[str], suffix: str, index: str) -> DataFrame:
    """(by, module, file): dotted module names of files; an index file stands for its folder."""
    bare = F.regexp_replace("path", suffix, "")
    return files.select(*by, F.replace(F.regexp_replace(bare, f"(^|/){index}$", ""), F.lit("/"), F.lit(".")).alias("module"), F.col("path").alias("file"))


def _first(candidates: DataFrame, known: DataFrame, by: list[str], key: str, one: list[str]) -> DataFrame:
    """The known candidate of least rank for each statement; all statements stay, the file is null for none."""
    found = candidates.join(known, [*by, key], "left")
    return found.groupBy(*one).agg(F.min(F.when(F.col("file").isNotNull(), F.struct("rank", "file"))).alias("hit")).select(*one, F.col("hit.file").alias("file"))


def _edges(rows: DataFrame, by: list[str]) -> DataFrame:
    """Edges without self-loops; of several lines the first."""
    return rows.filter("path <> target").groupBy(*by, F.col("path").alias("source"), "target").agg(F.min("line").alias("line")).select(*by, "source", "target", F.lit("uses").alias("kind"), "line")


def python_statements(text: str | None) -> list[tuple[int, str, str, int]]:
    """(line, module, name, dots) of every import of a text, from its syntax tree; of a text that doesn't parse, from its lines."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found = []
        for at, line in enumerate((text or "").split("\n"), 1):
            if m := re.match(r"\s*from\s+(\.*)([\w.]*)\s+import\s+\(?([^#()]*)", line):
                found += [(at, m[2], n, len(m[1])) for n in re.findall(r"(?:^|,)\s*(\w+|\*)", m[3])]
            elif m := re.match(r"\s*import\s+([^#]+)", line):
                found += [(at, n, "", 0) for n in re.findall(r"(?:^|,)\s*([\w.]+)", m[1])]
        return found
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [(node.lineno, a.name, "", 0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found += [(node.lineno, node.module or "", a.name, node.level) for a in node.names]
    return found


def _statements(files: DataFrame, by: list[str], find: Callable[[str | None], list[tuple]], shape: str) -> DataFrame:
    """(by, path, fields of ``shape``): a row for each statement that ``find`` gives for a text, in Arrow batches."""

    @F.pandas_udf(f"array<struct<{shape}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, row, strict=True)) for row in find(t)])

    names = [f.strip().split(":")[0] for f in shape.split(",")]
    return files.select(*by, "path", F.inline(found(F.col("text"))))


def python_imports(files: DataFrame, by: list[str]) -> DataFrame:
    """``import a.b`` and ``from .a import b, c``: a named submodule before the module itself; what is unknown is external by its first name, relative ones never are."""
    rows = _statements(files, by, python_statements, "line:int,base:string,name:string,dots:int")
    rows = rows.withColumn("name", F.when(F.col("name") == "*", "").otherwise(F.col("name")))
    folder = F.split(parts(F.col("path"))["dir"], "/")
    above = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - F.col("dots") + 1, F.lit(0))), ".")
    base = F.when(F.col("dots") == 0, F.col("base")).otherwise(F.concat_ws(".", F.nullif(above, F.lit("")), F.nullif("base", F.lit(""))))
    rows = rows.withColumn("whole", base)
    named = F.when(F.col("name") != "", F.concat_ws(".", F.nullif("whole", F.lit("")), "name"))
    one = [*by, "path", "line", "whole", "name", "dots"]
    options = rows.select(*one, F.posexplode(F.array_compact(F.array(named, F.col("whole")))).alias("rank", "module"))
    found = _first(options, _modules(files, by, r"\.py$", "__init__"), by, "module", one)
    outer = F.when((F.col("dots") == 0) & (F.col("whole") != ""), F.concat(F.lit("ext:"), F.substring_index("whole", ".", 1)))
    return _edges(found.withColumn("target", F.coalesce("file", outer)).filter("target is not null"), by)


_SCRIPT = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\.)*`|(?P<word>\b(?:from|import|require)\b)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<sign>[^\s\w])|\w+""")


def script_specifiers(text: str | None) -> list[tuple[int, str]]:
    """(line, specifier) of every import, export-from and require of a script, from its tokens: no comment or text counts."""
    found, last, start = [], ["", "", ""], 0
    for m in _SCRIPT.finditer(text or ""):
        token = m[0]
        if token.startswith(("//", "/*")):
            continue
        if m["word"] and last[-1] != ".":
            start = m.start() if token != "from" else start
        elif token in ("export",):
            start = m.start()
        if m["text"]:
            if last[-1] in ("from", "import") and last[-2] != ".":
                found.append((text.count("\n", 0, start) + 1, token[1:-1]))
            elif last[-1] == "(" and last[-2] in ("require", "import") and last[-3] != ".":
                found.append((text.count("\n", 0, start) + 1, token[1:-1]))
        last = [*last[-2:], token]
    return list(dict.fromkeys(found))


#: Endings tried in turn for a script's relative import.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.mjs")


def script_imports(files: DataFrame, by: list[str]) -> DataFrame:
    """``import … from``, ``export … from``, ``require`` and ``import()``: relative ones by their endings in turn, others by package name, with its scope."""
    rows = _statements(files, by, script_specifiers, "line:int,spec:string")
    near = rows.filter(F.startswith("spec", F.lit("."))).withColumn("far", normalized(F.concat(parts(F.col("path"))["dir"], F.lit("/"), "spec")))
    one = [*by, "path", "line", "far"]
    options = near.select(*one, F.posexplode(F.array(*[F.concat("far", F.lit(e)) for e in SCRIPT_ENDINGS])).alias("rank", "candidate"))
    known = files.select(*by, F.col("path").alias("candidate"), F.col("path").alias("file"))
    inner = _first(options, known, by, "candidate", one).filter("file is not null").select(*by, "path", "line", F.col("file").alias("target"))
    package = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    outer = rows.filter(~F.startswith("spec", F.lit("."))).select(*by, "path", "line", F.concat(F.lit("ext:"), package).alias("target"))
    return _edges(inner.unionByName(outer), by)


def go_modules(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, root, module): the module named by each go.mod, with its folder."""
    named = files.filter(F.col("path").rlike(r"(?:^|/)go\.mod$")).select(*by, parts(F.col("path"))["dir"].alias("root"), F.regexp_extract("text", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1).alias("module"))
    return named.filter("module <> ''")


def go_imports(files: DataFrame, by: list[str], module: str | None = None) -> DataFrame:
    """Imports of Go files: one edge to every file of an inner package, else to the external path.

    A package is inner if its path begins with a module: the one given, else those of the go.mod files, the longest first.
    """
    rows = _lines(files.filter(F.endswith("path", F.lit(".go"))), by)
    spec = F.coalesce(F.nullif(F.regexp_extract("code", r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("code", r'^\s+(?:[\w.]+\s+)?"([\w.\-/]+)"\s*$', 1), F.lit("")))
    rows = rows.select(*by, "path", "line", spec.alias("spec")).filter("spec is not null")
    if module is None:
        # A repository holds few modules.
        own = go_modules(files, by)
        inner = F.startswith(F.concat("spec", F.lit("/")), F.concat("module", F.lit("/")))
        hits = rows.select(*by, "spec").distinct().join(own, by).filter(inner).groupBy(*by, "spec").agg(F.max_by(F.struct("root", "module"), F.length("module")).alias("m"))
        rest = F.substring("spec", F.length("m.module") + 2, F.lit(1 << 30))
        rows = rows.join(hits.select(*by, "spec", F.concat_ws("/", F.nullif("m.root", F.lit("")), F.nullif(rest, F.lit(""))).alias("package")), [*by, "spec"], "left")
    else:
        rows = rows.withColumn("package", F.when(F.col("spec") == module, "").when(F.startswith("spec", F.lit(module + "/")), F.substring("spec", len(module) + 2, 1 << 30)))
    packages = files.filter(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select(*by, parts(F.col("path"))["dir"].alias("package"), F.col("path").alias("file"))
    near = rows.filter("package is not null").join(packages, [*by, "package"]).select(*by, "path", "line", F.col("file").alias("target"))
    far = rows.filter("package is null").select(*by, "path", "line", F.concat(F.lit("ext:"), "spec").alias("target"))
    return _edges(near.unionByName(far), by)


def c_includes(files: DataFrame, by: list[str]) -> DataFrame:
    """``#include``: relative to the file, then to the root, then by a name that only one file has; else external."""
    rows = _lines(files, by)
    spec = F.regexp_extract("code", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    rows = rows.select(*by, "path", "line", spec.alias("spec")).filter("spec <> ''").withColumn("name", F.element_at(F.split("spec", "/"), -1))
    known = lambda key: files.select(*by, F.col("path").alias(key), F.lit(True).alias(f"has_{key}"))
    names = files.groupBy(*by, F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only")).filter("n = 1").drop("n")
    rows = rows.withColumns({"near": normalized(F.concat(parts(F.col("path"))["dir"], F.lit("/"), "spec")), "rooted": normalized(F.col("spec"))})
    rows = rows.join(known("near"), [*by, "near"], "left").join(known("rooted"), [*by, "rooted"], "left").join(names, [*by, "name"], "left")
    target = F.when(F.col("has_near"), F.col("near")).when(F.col("has_rooted"), F.col("rooted")).otherwise(F.coalesce("only", F.concat(F.lit("ext:"), "spec")))
    return _edges(rows.withColumn("target", target), by)


def csharp_usings(files: DataFrame, by: list[str]) -> DataFrame:
    """``using A.B;``: an edge to every file that declares the namespace, else to it as external."""
    rows = _lines(files, by)
    used = rows.select(*by, "path", "line", F.regexp_extract("code", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", 1).alias("space")).filter("space <> ''")
    declared = rows.select(*by, F.regexp_extract("code", r"^\s*namespace\s+([\w.]+)", 1).alias("space"), F.col("path").alias("file")).filter("space <> ''").distinct()
    found = used.join(declared, [*by, "space"], "left")
    return _edges(found.withColumn("target", F.coalesce("file", F.concat(F.lit("ext:"), "space"))), by)


def use_paths(tree: str) -> list[str]:
    """The paths of a use tree without blanks, with groups in braces spread at any depth."""
    out, prefixes, piece = [], [""], ""
    for c in tree:
        if c == "{":
            prefixes.append(prefixes[-1] + piece)
            piece = ""
        elif c in ",}":
            if piece:
                out.append(prefixes[-1] + piece)
            piece = ""
            if c == "}" and len(prefixes) > 1:
                prefixes.pop()
        else:
            piece += c
    return [p for p in [*out, *([prefixes[-1] + piece] if piece else [])] if p != "*"]


def _spread(tree: Column) -> Column:
    @F.pandas_udf("array<string>")
    def spread(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: use_paths(t) if t is not None else [])

    return spread(tree)


def rust_uses(files: DataFrame, by: list[str]) -> DataFrame:
    """``use`` and ``mod``: paths of the crate lead to the deepest module file along them, others to the external crate.

    Groups in braces are spread; ``pub use`` is a reexport, a glob of an own ancestor a super edge.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"//[^\n]*", "")
    uses = files.select(*by, "path", F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^\s*((?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+);"), F.lit(1))).alias("stmt"))
    uses = uses.withColumn("public", F.col("stmt").rlike(r"^pub")).withColumn("tree", F.regexp_replace(F.regexp_replace("stmt", r"^(?:pub(?:\([^)]*\))?\s+)?use\s+", ""), r"\s+as\s+\w+|\s", ""))
    uses = uses.withColumn("tree", F.explode(_spread(F.col("tree"))))
    bare = F.regexp_replace("path", r"(?:/mod|/lib|/main)?\.rs$", "")
    own = F.regexp_replace(F.regexp_replace(bare, r"^(.*/)?src(?:/|$)", ""), "/", "::")
    crate = F.regexp_extract("path", r"^(.*?)(?:^|/)?src/", 1)
    modules = files.select(*by, crate.alias("crate"), own.alias("module"), F.col("path").alias("file"))
    rows = uses.withColumns({"crate": crate, "own": own, "glob": F.endswith("tree", F.lit("*"))})
    up = F.regexp_replace("own", r"(?:^|::)[^:]+$", "")
    whole = (
        F.when(F.startswith("tree", F.lit("crate::")), F.substring("tree", 8, 1 << 30))
        .when(F.startswith("tree", F.lit("self::")), F.concat_ws("::", F.nullif("own", F.lit("")), F.substring("tree", 7, 1 << 30)))
        .when(F.startswith("tree", F.lit("super::")), F.concat_ws("::", F.nullif(up, F.lit("")), F.regexp_replace("tree", r"^(?:super::)+", "")))
    )
    rows = rows.withColumn("whole", F.regexp_replace(whole, r"::\*$|^\*$", "")).withColumn("segments", F.split("whole", "::"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.array_join(F.slice("segments", F.lit(1), i), "::"))
    one = [*by, "path", "tree", "public", "glob", "own"]
    inner = rows.filter("whole is not null").select(*one, "crate", F.posexplode(prefixes).alias("depth", "module"))
    inner = inner.join(modules, [*by, "crate", "module"]).groupBy(*one).agg(F.max_by(F.struct("file", "module"), "depth").alias("hit"))
    above = F.col("glob") & (F.startswith("own", F.concat("hit.module", F.lit("::"))) | (F.col("hit.module") == ""))
    kind = F.when(F.col("public"), "reexports").when(above, "super").otherwise("uses")
    inner = inner.select(*by, F.col("path").alias("source"), F.col("hit.file").alias("target"), kind.alias("kind"))
    outer = rows.filter("whole is null").select(*by, F.col("path").alias("source"), F.concat(F.lit("ext:"), F.substring_index("tree", "::", 1)).alias("target"), F.when(F.col("public"), "reexports").otherwise("uses").alias("kind"))
    return inner.unionByName(outer).filter("source <> target").distinct().withColumn("line", F.lit(None).cast("int"))


def extract_all(files: DataFrame, by: list[str], *, go_module: str | None = None) -> DataFrame:
    """Edges of all languages by the files' extensions."""
    ending = lambda *e: files.filter(F.lower("path").rlike(rf"\.(?:{'|'.join(e)})$"))
    parts_ = [
        python_imports(ending("py"), by), script_imports(ending("[cm]?js", "jsx", "[cm]?ts", "tsx"), by), go_imports(files.filter(F.lower("path").rlike(r"(?:\.go|(?:^|/)go\.mod)$")), by, go_module),
        c_includes(ending("c", "h", "cc", "cpp", "hpp"), by), csharp_usings(ending("cs"), by), rust_uses(ending("rs"), by),
    ]
    return reduce(DataFrame.unionByName, parts_)


def line_counts(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, loc, blank, cloc): lines, blank ones, and ones that hold only a comment."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    comment = r"^\s*(?://|#(?!\s*(?:include|define|if|else|endif|\[))|/\*|\*)"
    size = lambda test: F.size(F.filter(lines, test))
    return files.select(*by, "path", F.size(lines).alias("loc"), size(lambda x: F.trim(x) == "").alias("blank"), size(lambda x: x.rlike(comment)).alias("cloc"))


