"""Paths and ids of nodes as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> dict[str, Column]:
    """name, stem, ext and dir of a path; a leading dot of a name begins no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    dotted = name.rlike(r"^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    return {"name": name, "stem": stem, "ext": F.when(dotted, ext).otherwise(F.lit("")), "dir": folder}


def node_path(id: Column, path: Column, root: str = "{target}/") -> Column:
    """The path attribute of a node, or its id without the root."""
    return F.coalesce(path, F.when(F.startswith(id, F.lit(root)), F.substring(id, len(root) + 1, 1 << 30)).otherwise(id))


def relativized(id: Column, roots: dict[str, str]) -> Column:
    """``{name}/rest`` for an absolute id below a root; the longest root wins, others stay."""
    out = id
    for name, folder in sorted(roots.items(), key=lambda r: len(r[1])):
        folder = folder.rstrip("/")
        inside = F.startswith(id, F.lit(folder + "/"))
        out = F.when(id == folder, F.lit(f"{{{name}}}")).when(inside, F.concat(F.lit(f"{{{name}}}"), F.substring(id, len(folder) + 1, 1 << 30))).otherwise(out)
    return out


def normalized(path: Column) -> Column:
    """A path with "." and ".." resolved by its text alone."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)),
    )
    return F.array_join(folded, "/")


def focused(path: Column, focus: str) -> Column:
    """Whether a path is the focus or lies below it, by whole segments; an empty focus takes all."""
    focus = focus.strip().rstrip("/").removeprefix("./").removeprefix("{target}/")
    if focus in ("", ".", "{target}"):
        return F.lit(True)
    return (path == focus) | F.startswith(path, F.lit(focus + "/"))


def glob_regex(glob: str) -> str:
    """A whole-text pattern for a glob: "*" and "?" span any character, braces alternatives, as file globs without literal separators do."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 2] == "**":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def test_path(path: Column, dirs: list[str], *, names: list[str] = (), prefixes: list[str] = (), suffixes: list[str] = (), infixes: list[str] = ()) -> Column:
    """Whether a path is that of a test: by a directory, or by name, prefix, suffix or infix of the file name."""
    segments = F.split(path, "/")
    name = F.element_at(segments, -1)
    found = F.arrays_overlap(F.slice(segments, F.lit(1), F.size(segments) - 1), F.array(*map(F.lit, dirs)).cast("array<string>"))
    found = found | name.isin(*names) if names else found
    for texts, test in ((prefixes, F.startswith), (suffixes, F.endswith), (infixes, F.contains)):
        for text in texts:
            found = found | test(name, F.lit(text))
    return F.coalesce(found, F.lit(False))
