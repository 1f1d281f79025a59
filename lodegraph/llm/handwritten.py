"""Source files that nobody of their repository wrote by hand."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.paths import clean_path
from lodegraph.llm.syntax import source_files
from lodegraph.workspace import broadcast_if_small, materialize

#: Characters of code that a file or tree shared by two repositories must hold to count; by more repositories, fewer.
SHARED_CHARS = 200
#: Share of a directory's code that stands elsewhere, in at least so many files, from which the directory is an edited copy.
PARTIAL_SHARE, PARTIAL_FILES = 0.8, 2
#: Files from which a repository of which PARTIAL_SHARE stands elsewhere is a fork, or the origin, and not called vendored.
FORK_FILES = 10
#: Directory levels for which the hash tree is one job.
LEVELS_PER_JOB = 8
#: Share of white space below which a script is minified, and the length from which that is judged.
MINIFIED_BLANKS, MINIFIED_CHARS = 0.1, 200
#: Numbered lines of one shape that make a file a tool's output: at least so many, and of all lines.
NUMBERED_LINES, NUMBERED_SHARE = 8, 0.3
#: Characters and share of encoded literals, or number and share of numbers among all words, that make a file data.
ENCODED_CHARS, ENCODED_SHARE, NUMBER_SHARE, NUMBERS = 200, 0.4, 0.4, 60

# Header rules are made of kinds of evidence, not of sentences. A file tells that a tool made it, if a comment
# begins with the making of the file itself ("this file was generated", "emitted") and names the tool, the source,
# or forbids editing; or by a bare marker. It tells of its origin, if a comment names a package with its version beside a
# word of origin or a licence. A comment that says what the code itself does begins with neither.
_SELF = r"(?:this|the|these|file|files|code|source|module|contents?|document|all|was|were|is|are|has|have|been|be|automatically|auto|fully|entirely|machine|note|warning|important|attention)"
_MADE = r"(?:auto-?|machine[- ]|re-?)?(?:generated|produced|emitted|created|built|compiled|transpiled|rendered|synthesi[sz]ed|derived|exported|output|written)"
_MAKING = rf"^\W*(?:{_SELF}\W+){{0,7}}{_MADE}\b"
_TOOL = r"\b(?:by|with|using|via)\W+(?!(?:hand|hands|humans?|people|us|me|the|a|an|our|its|their|every|all|each)\b)[\w.@/-]+|`[^`]+`|\([\w.-]+(?: [\w.-]+)?\)|(?:^|\s)--?[a-z][\w-]+|\b\w+(?:gen|codegen|compiler|generator)\b"
_SOURCE = r"\b(?:from|of|for|edit|see|input|source|schema|template)\W+(?:\w+\W+){0,2}?[\w.-]+/[\w./-]*\w|\b(?:from|of|for|edit|see|input|source|schema|template)\W+[\w-]+\.[a-z]\w{0,9}\b"
_FORBID = r"\b(?:do not|don't|never|not for|not to be|must not|no)\b[^.]{0,20}\b(?:edit|edits|edited|editing|modify|modified|change|changed|changes|touch)\b|\b(?:changes?|edits?|modifications?)\b.{0,40}\b(?:lost|overwritten|discarded|vanish|undone|clobbered|reverted)\b|\b(?:regenerate|rebuild)\b.{0,30}\binstead\b|\binstead\b"
_MARKER = r"^\W*@generated\b|^\W*<auto-?generated\b|^\W*code generated .* do not edit|^\W*do not edit(?: this file| by hand| manually)?\W*$|^\W*[#@] sourcemappingurl="
_PACKAGE = r"(?<![\w.])[\w.+-]*[a-z][\w.+-]*(?:@|[ -]v?|\s\(\s*(?:release|version|rev|tag|v)?\s*v?)\d+\.\d+(?:\.\d+)*(?:[-+][\w.]+)?"
_ORIGIN = r"\b(?:upstream|vendor(?:ed)?|bundled|copy|copied|cop(?:y|ies) of|imported|mirror(?:ed)?|third[- ]party|distribut(?:ed|ion)|release|released|maintainers?|contributors|fork(?:ed)?|backport(?:ed)?|snapshot of|taken|pulled)\b|spdx|\blicen[cs]ed?\b"
_NUMBERED = r"[A-Za-z_](?:0\d+|\d{2,})\b"
_BUILT_NAMES = r"(?:[.-]min|\.bundle)\.[cm]?[jt]s$"
_VENDOR_PATH = r"(?:^|/)(?:third[_-]?party|external|upstream|vendored)/[^/]*-v?\d+(?:\.\d+)+/"
_SIGNS = r"//|#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|region|\[|!\[))|/\*|\*|--|<!--"
_COMMENT_ROW = rf"(?!\z)[ \t\r]*+(?:(?:{_SIGNS})[^\n]*+)?+(?:\n|\z)"
_COMMENT_LINE = rf"^[ \t]*+(?:{_SIGNS})[^\n]*+"


def _comments(text: Column) -> Column:
    """The comment lines before the first and after the last line of code."""
    first = F.regexp_extract(text, rf"\A(?:{_COMMENT_ROW})*+", 0)
    last = F.regexp_extract(text, rf"(?<=\n)(?:{_COMMENT_ROW})++\z", 0)
    return F.split(F.when(F.length(first) == F.length(text), first).otherwise(F.concat_ws("\n", first, last)), r"\r?\n")


def _statements(comments: Column) -> Column:
    """Each comment line in lower case without its signs, with the next one: what a sentence over two lines says."""
    bare = F.filter(F.transform(comments, lambda x: F.lower(F.trim(F.regexp_replace(x, r"^\s*(?://+|#+(?!!)|/?\*+[!/]?|--|<!--)", "")))), lambda x: x != "")
    return F.transform(bare, lambda x, i: F.struct(x.alias("own"), F.concat_ws(" ", x, F.get(bare, i + 1)).alias("both")))


def _tells_generated(statements: Column) -> Column:
    evidence = rf"{_TOOL}|{_SOURCE}|{_FORBID}"
    return F.exists(statements, lambda x: x["own"].rlike(_MARKER) | (x["own"].rlike(_MAKING) & F.regexp_replace(x["both"], _MAKING, "").rlike(evidence)))


def _tells_origin(statements: Column) -> Column:
    return F.exists(statements, lambda x: x["own"].rlike(_PACKAGE) & x["both"].rlike(_ORIGIN) & ~x["own"].rlike(_MAKING))


def ignore_regex(line: str) -> tuple[str, bool, bool] | None:
    """(pattern for a whole path, negated, only for directories) of a line of an ignore file; None for a blank one or a comment.

    A "/" but at the end ties the line to the root; "*" and "?" stay within a name, "**" between slashes spans directories.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line or "")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    if not line:
        return None
    tied = "/" in line
    line = line.lstrip("/")
    out, i = "" if tied else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", len(line)
            continue
        if c == "*":
            while i + 1 < len(line) and line[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            inner = line[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        elif c == "\\" and i + 1 < len(line):
            i += 1
            out += re.escape(line[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$", negated, only_dirs


def ignored_path(path: str, rules: list[tuple[re.Pattern[str], bool, bool]]) -> bool:
    """Whether the last matching line excludes the path or a directory above it."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        prefix, state = "/".join(parts[:i]), False
        for regex, negated, dirs in rules:
            if not (dirs and i == len(parts)) and regex.match(prefix):
                state = not negated
        if state:
            return True
    return False


@lru_cache(maxsize=4096)
def _rules(lines: tuple[str, ...]) -> list[tuple[re.Pattern[str], bool, bool]]:
    return [(re.compile(r[0], re.DOTALL), r[1], r[2]) for r in map(ignore_regex, lines) if r]


def _ignored(path: Column, patterns: Column) -> Column:
    """Whether a repository's lines exclude a path: its lines are compiled once in each worker."""

    @F.pandas_udf("boolean")
    def excluded(paths: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([False if own is None or p is None else ignored_path(p, _rules(tuple(own))) for p, own in zip(paths, lines, strict=True)], dtype=bool)

    return excluded(path, patterns)


def _prefixes(path: Column) -> Column:
    """Every directory above a path, from the root down, then the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _code(text: Column, path: Column) -> Column:
    """A text without comment lines and white space, so that an edited header or layout hides no copy; of prose only white space goes."""
    bare = F.regexp_replace(text, r"(?m)" + _COMMENT_LINE, "")
    return F.regexp_replace(F.when(F.lower(path).rlike(r"\.(?:md|markdown|txt|rst)$"), text).otherwise(bare), r"\s+", "")


def shared_trees(files: DataFrame) -> DataFrame:
    """(repo, path) of the files that have a version in ``shared_versions``."""
    return shared_versions(files).select("repo", "path").distinct()


def shared_versions(files: DataFrame) -> DataFrame:
    """(repo, path, hash, other) of the files of (repo, path, text) that stand in a tree, or are a file, that unrelated repositories share.

    A Merkle hash is made bottom-up: of a file from its code (without comments and white space), of a directory from the names and
    hashes of its children, combined in any order so that no directory is gathered. Repositories whose
    whole trees are equal are copies of each other, not unrelated. What n repositories share counts if it holds
    SHARED_CHARS / log3(n + 1) characters of code. A directory of which PARTIAL_SHARE of the code (repeated texts once), in PARTIAL_FILES texts or more, stands in
    unrelated repositories, is an edited copy, with all that is in it; a repository of FORK_FILES or more texts of which this holds as a whole is a fork
    or the origin, and none of its files is listed. Each text of a path is a file of its own; in the hashes of
    directories the one with the least hash stands for its path, and only that one stands in their trees.
    """
    code = _code(F.coalesce("text", F.lit("")), F.col("path"))
    files = files.filter("path is not null and path <> ''").select(F.coalesce("repo", F.lit("")).alias("repo"), "path", code.alias("code"))
    files = files.select("repo", "path", F.xxhash64("code").alias("hash"), F.xxhash64(F.lit(1), "code").alias("other"), F.length("code").cast("bigint").alias("size"))
    versions = materialize(files.distinct().withColumn("depth", F.size(F.split("path", "/"))))
    nodes = versions.groupBy("repo", "path", "depth").agg(F.min(F.struct("hash", "other", "size")).alias("h"))
    nodes = materialize(nodes.select("repo", "path", "h.*", "depth"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    leaf = F.lit(True).alias("leaf")
    above, parts = None, [versions.select("*", leaf)]
    for depth in range(deepest, 0, -1):
        here = nodes.filter(F.col("depth") == depth)
        here = here if above is None else here.unionByName(above)
        name = F.element_at(F.split("path", "/"), -1)
        parent = F.array_join(F.slice(F.split("path", "/"), 1, depth - 1), "/")
        made = F.bit_xor(F.xxhash64(name, "hash", "other"))
        above = here.groupBy("repo", parent.alias("path")).agg(made.alias("a"), F.bit_xor(F.xxhash64(F.lit(2), name, "other", "hash")).alias("b"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        above = above.select("repo", "path", F.xxhash64("a", "n").alias("hash"), F.xxhash64("b", "n").alias("other"), "size", F.lit(depth - 1).alias("depth"))
        if (deepest - depth) % LEVELS_PER_JOB == LEVELS_PER_JOB - 1:
            above = materialize(above)
        parts.append(above.select("*", (~leaf).alias("leaf")))
    trees = materialize(reduce(DataFrame.unionByName, parts))
    roots = trees.filter("depth = 0").select("repo", F.col("hash").alias("root"))
    held = trees.filter("size > 0 and depth > 0")
    # Distinct roots are counted in two steps, so that no hash that many repositories hold is gathered.
    known = held.join(roots, "repo").select("hash", "other", "size", "root").distinct().groupBy("hash", "other", "size").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(known.filter("n > 1").select("hash", "other", (F.col("size") * F.log(3.0, F.col("n") + 1)).alias("weight")))
    shared = materialize(held.join(known, ["hash", "other"]))
    large = shared.filter(F.col("weight") >= SHARED_CHARS)
    # Directories by the share of their code that stands elsewhere.
    own = nodes.filter("size > 0").join(known.withColumn("elsewhere", F.lit(True)), ["hash", "other"], "left")
    above = F.concat(F.array(F.lit("")), F.slice(_prefixes(F.col("path")), F.lit(1), F.col("depth") - 1))
    share = own.select("repo", "size", "hash", "other", "elsewhere", F.explode(above).alias("prefix")).distinct().groupBy("repo", "prefix").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("elsewhere"), F.col("size"))).alias("same"), F.count("elsewhere").alias("same_files")
    )
    share = materialize(share.filter(F.col("same") >= F.col("size") * PARTIAL_SHARE))
    forks = share.filter((F.col("prefix") == "") & (F.col("files") >= FORK_FILES)).select("repo")
    partial = share.filter((F.col("prefix") != "") & (F.col("same_files") >= PARTIAL_FILES) & (F.col("same") >= SHARED_CHARS)).select("repo", "prefix")
    trees = large.filter("not leaf").select("repo", F.col("path").alias("prefix")).unionByName(partial).distinct()
    inside = nodes.select("repo", "path", "hash", "other", F.explode(_prefixes(F.col("path"))).alias("prefix")).join(trees, ["repo", "prefix"], "left_semi")
    version = ["repo", "path", "hash", "other"]
    found = large.filter("leaf").select(*version).unionByName(inside.select(*version)).distinct()
    return found.join(forks, "repo", "left_anti")


def foreign_files(docs: DataFrame, rules: DataFrame, ignores: DataFrame, *, id: str = "doc_id", path: str = "path", text: str = "text", repo: str = "repo") -> DataFrame:
    """(id, repo, path, language, generated, minified, vendored, data, skipped, ignored) of each source file.

    generated: a comment at the top or end says how the file itself was made (see the header rules above), or
    the lines are numbered families of one shape. minified: a script almost without blanks, or a name of a built file. vendored: shared
    with unrelated repositories by the hash tree, a comment that names a package's release as the origin, or a directory of a
    release below a third-party one. data: mostly one encoded literal or numbers. skipped: below
    a directory that the language's rule skips. ignored: matched by the repository's ignore lines, if its gitignore flag is set. Null and
    empty texts are judged by path only; a document without a path is no source file; a repository without ignore rules ignores nothing.
    """
    files = materialize(source_files(docs, rules, id=id, path=path, text=text, repo=repo))
    body = F.coalesce("text", F.lit(""))
    lines = F.split(body, r"\r?\n")
    comments = _comments(body)
    size = F.length(body)
    solid = F.length(F.regexp_replace(body, r"\s+", ""))
    encoded = size - F.length(F.regexp_replace(body, r"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){20,}", ""))
    words = F.regexp_count(body, F.lit(r"\w+(?:\.\d+)?"))
    numbers = F.regexp_count(body, F.lit(r"\b(?:0x[\da-fA-F]+|\d+(?:\.\d+)?)\b"))
    many = F.regexp_count(body, F.lit(_NUMBERED)) >= NUMBERED_LINES
    script = F.col("language").isin("js", "ts")
    judged = files.withColumns({"said": _statements(comments), "code": _code(body, F.col("path"))}).select(
        "id", "repo", "path", "language", F.xxhash64("code").alias("hash"), F.xxhash64(F.lit(1), "code").alias("other"),
        _tells_generated(F.col("said")).alias("told"),
        ((script & (size >= MINIFIED_CHARS) & (size - solid < size * MINIFIED_BLANKS)) | F.lower("path").rlike(_BUILT_NAMES)).alias("minified"),
        (_tells_origin(F.col("said")) | F.lower("path").rlike(_VENDOR_PATH)).alias("upstream"),
        ((encoded >= size * ENCODED_SHARE) & (encoded >= ENCODED_CHARS) | (numbers >= words * NUMBER_SHARE) & (numbers >= NUMBERS)).alias("data"),
        F.when(many, F.size(F.filter(lines, lambda x: F.trim(x) != ""))).alias("lines"),
        F.when(many, F.filter(lines, lambda x: x.rlike(_NUMBERED))).alias("numbered"),
    )
    # A line's shape: letters and digits taken together; its number: that of its first numbered name.
    shape = F.regexp_replace(F.regexp_replace(F.trim("line"), "[A-Za-z_]+", "a"), r"\d+", "9")
    number = F.regexp_extract("line", r"[A-Za-z_](\d+)\b", 1)
    families = judged.filter(F.size("numbered") >= NUMBERED_LINES).select("id", "lines", F.explode("numbered").alias("line"))
    families = families.groupBy("id", "lines", shape.alias("shape")).agg(F.count_distinct(number).alias("n"))
    families = families.filter(F.col("n") >= NUMBERED_LINES).groupBy("id", "lines").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.col("lines") * NUMBERED_SHARE)
    judged = judged.drop("numbered", "lines").join(families.select("id", F.lit(True).alias("family")), "id", "left")
    tree = shared_versions(docs.select(F.col(repo).alias("repo"), clean_path(F.col(path)).alias("path"), F.col(text).alias("text")))
    judged = judged.join(tree.select(F.col("repo").alias("t_repo"), F.col("path").alias("t_path"), F.col("hash").alias("t_hash"), F.col("other").alias("t_other"), F.lit(True).alias("shared")), (F.coalesce("repo", F.lit("")) == F.col("t_repo")) & (F.col("path") == F.col("t_path")) & (F.col("hash") == F.col("t_hash")) & (F.col("other") == F.col("t_other")), "left")
    skips = rules.select("language", "skip_dirs")
    judged = judged.join(broadcast_if_small(skips, 10_000), "language", "left")
    lists = ignores.filter("gitignore").select(F.col("repo").alias("i_repo"), "patterns")
    judged = judged.join(lists, F.col("repo") == F.col("i_repo"), "left")
    names = F.split("path", "/")
    names = F.slice(names, F.lit(1), F.size(names) - 1)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return judged.select(
        "id", "repo", "path", "language", (yes(F.col("told")) | yes(F.col("family"))).alias("generated"), yes(F.col("minified")).alias("minified"),
        (yes(F.col("upstream")) | yes(F.col("shared"))).alias("vendored"), yes(F.col("data")).alias("data"),
        yes(F.arrays_overlap(names, "skip_dirs")).alias("skipped"), yes(_ignored(F.col("path"), F.col("patterns"))).alias("ignored"),
    )
