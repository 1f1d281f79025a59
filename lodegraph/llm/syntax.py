"""Source files that are no valid file of their language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.grammars import ESCAPED, GRAMMARS, NO_TARGET, Grammar
from lodegraph.llm.paths import clean_path, extension
from lodegraph.workspace import broadcast_if_small, materialize

_END = "\u0002"
_OPEN, _CLOSE = ("(", "[", "{"), (")", "]", "}")
_BRACKETS = {"(": "()", "[": "[]", "{": "{}"}


def _by_language(language: Column, make) -> Column:  # noqa: ANN001
    return reduce(lambda chain, g: chain.when(language == g.name, make(g)), list(GRAMMARS.values())[1:], F.when(language == next(iter(GRAMMARS)), make(next(iter(GRAMMARS.values())))))


def _plain(text: Column, language: Column) -> Column:
    """A text without outer blanks at its end, in which line continuations are blanks and escapes are
    neutral characters: so quotes in strings end them."""
    text = F.rtrim(text, F.lit(" \t\r\n\x0c"))
    joined = F.regexp_replace(text, r"\\\r?\n", " ")
    # Texts in which a backslash is only itself.
    joined = F.when(language == "csharp", F.regexp_replace(joined, r"(?<=[\s(=,+\[{:?!])(?:\$@|@\$|@)\"[^\"]*+\"", '""')).otherwise(joined)
    neutral = F.when(language == "go", F.regexp_replace(joined, r"\\[^`\n]", ESCAPED)).otherwise(F.regexp_replace(joined, r"\\[^\n]", ESCAPED))
    return F.when(F.contains(text, F.lit("\\")), neutral).otherwise(text)


def _vocabulary(spark: SparkSession) -> DataFrame:
    """(v_language, v_token, v_class) of all keywords, operators and brackets."""
    rows = []
    for g in GRAMMARS.values():
        known = {}
        for cls, words in (("B", g.binary), ("P", g.other), ("V", g.values), ("K", g.words), ("H", g.heads), ("E", g.ending), ("O", g.alternative), ("R", g.returns), ("Q", g.soft)):
            known |= {w: cls for w in words.split()}
        known |= {c: c for c in "()[]{},;:."} | {_END: "EOF"}
        rows += [(g.name, token, cls) for token, cls in known.items() if token]
    return spark.createDataFrame(rows, "v_language string, v_token string, v_class string")


def _pair_table(spark: SparkSession) -> DataFrame:
    rows = [(g.name, a, b) for g in GRAMMARS.values() for a, b in sorted(g.pairs())]
    return spark.createDataFrame(rows, "language string, before string, class string")


def _class(token: Column, language: Column) -> Column:
    """The class of a token that the vocabulary doesn't name."""
    first = F.substring(token, 1, 1)
    number = F.when(_by_language(language, lambda g: token.rlike(f"^(?:{g.number})$")), "N").otherwise("X")
    lone = F.length(token) == 1
    quoted = F.when(lone, "X").when((first == "`") & language.isin("js", "ts"), "T").otherwise("S")
    directive = language.isin("c", "csharp") & F.ltrim(token).startswith("#")
    good = F.when(language == "c", token.rlike(GRAMMARS["c"].valid_directive)).otherwise(token.rlike(GRAMMARS["csharp"].valid_directive))
    marker = reduce(lambda a, b: a | b, [token.startswith(c * 7) for c in "<>|="])
    # Most tokens are names in plain letters; texts end with their quote or a bracketing sign.
    plain = first.between("A", "z") & ~first.isin("[", "\\", "]", "^", "`") & ~F.right(token, F.lit(1)).isin('"', "'", "`", "#")
    return (
        F.when(plain, "I")
        .when(first == "\n", "EOL")
        .when(marker | (token == "/*"), "X")
        .when(directive, F.when(good, "D").otherwise("X"))
        .when(token.rlike(r"^\.?\d"), number)
        .when((first == "'") & ~token.endswith("'") & (language == "rust"), "L")
        .when(token.rlike("^(?:[\\w$@#]{0,4}#?)[\"'`]"), quoted)
        .when(token.rlike(r"^(?:[\p{L}_$]|[@#][\p{L}_$])"), "I")
        .when((first == "/") & ~lone & language.isin("js", "ts"), "S")
        .otherwise("X")
    )


def _tokens(files: DataFrame) -> DataFrame:
    """(key, language, pos, token, class, step, wide) of every token but comments, by files of (key, language, text).

    The token of a line end is dropped; ``wide`` is the width of the blanks after it.
    """
    language, token = F.col("language"), F.col("token")
    found = _by_language(language, lambda g: F.regexp_extract_all("plain", F.lit(g.lexer), F.lit(0)))
    rows = files.withColumn("plain", _plain(F.col("text"), language)).select("key", "language", F.posexplode(F.array_append(found, F.lit(_END))).alias("pos", "token"))
    comment = F.when(language == "python", token.startswith("#")).otherwise((token.startswith("//") | token.startswith("/*") | (token.startswith("#!") & language.isin("js", "ts"))) & (token != "/*"))
    rows = rows.filter(~comment)
    # The vocabulary is fixed: some hundred words of the grammars.
    rows = rows.join(F.broadcast(_vocabulary(files.sparkSession)), (language == F.col("v_language")) & (token == F.col("v_token")), "left")
    step = F.when(token.isin(*_OPEN), 1).when(token.isin(*_CLOSE), -1).otherwise(0)
    cls = F.coalesce("v_class", _class(token, language))
    rows = rows.select("key", "language", "pos", "token", cls.alias("class"), step.alias("step"))
    # Of names, numbers and texts only the class matters from here on.
    kept = F.when(~F.col("class").isin("I", "V", "N", "S", "T", "EOL", "D"), token)
    return rows.withColumns({"token": kept, "wide": F.when(F.col("class") == "EOL", F.length(F.replace(token, F.lit("\t"), F.lit("        "))) - 1)})


def _judged(tokens: DataFrame) -> DataFrame:
    """(key, language, pos, class, symbol, indent, ill): the symbols of depth 0, and every token that no valid file has where it stands.

    One pass in the order of the file, and one by levels of nesting. Ill is a token without a
    class, one that with the token before it is no permissible pair (an anti-join against the fixed table of the grammar,
    which keeps the other rows; line ends inside brackets of Python pair with everything), one that ends a
    run of three (or, of names, four) that the grammar rules out, a bracket without its partner, an else that no if of its block is left for, and
    a terminator inside round brackets beyond those that a loop has. Names after a point may be keywords.
    """
    order = Window.partitionBy("key").orderBy("pos")
    language, token = F.col("language"), F.col("token")
    word = F.col("class").isin("K", "H", "O", "R", "E", "Q") & language.isin(*[g.name for g in GRAMMARS.values() if g.members])
    rows = tokens.withColumns({"last": F.lag("token").over(order), "depth": F.sum("step").over(order), "wide": F.lag("wide").over(order)})
    member = word & F.coalesce(F.col("last").isin(".", "?."), F.lit(False))
    rows = rows.withColumns({"class": F.when(member, "I").otherwise(F.col("class")), "token": F.when(~member, token)})
    rows = rows.withColumns({"before": F.lag("class").over(order), "second": F.lag("class", 2).over(order), "third": F.lag("class", 3).over(order)})
    rows = rows.join(F.broadcast(_pair_table(tokens.sparkSession).withColumn("known", F.lit(True))), ["language", "before", "class"], "left")
    inside = (language == "python") & (F.col("depth") > 0) & ((F.col("class") == "EOL") | (F.col("before") == "EOL"))
    run = F.concat_ws(" ", "second", "before", "class")
    three = reduce(lambda a, g: a | ((language == g.name) & run.isin(*g.triples)), [g for g in GRAMMARS.values() if g.triples], F.lit(False))
    names = language.isin(*[g.name for g in GRAMMARS.values() if g.few_names])
    names = names & (F.col("class") == "I") & (F.col("before") == "I") & (F.col("second") == "I") & (F.col("third") == "I")
    three = three | F.coalesce(names, F.lit(False))
    pair = ~inside & (((F.col("before").isNotNull() & F.col("known").isNull())) | three) | (F.col("class") == "X")
    rows = rows.select("key", "language", "pos", "token", "class", "step", "depth", "last", F.when(F.col("before").isNull() | (F.col("before") == "EOL"), F.coalesce("wide", F.lit(0))).alias("indent"), pair.alias("ill"))

    # By levels: a bracket stands on the level around it; a copy of it begins or ends the group of what it holds.
    edge = F.explode(F.when(F.col("step") != 0, F.array(F.lit(0), F.col("step"))).otherwise(F.array(F.lit(0)))).alias("edge")
    outer = F.col("depth") - F.greatest("step", F.lit(0))
    # Of deeper tokens only brackets, terminators, words of choice and the end count from here on.
    rows = rows.filter(F.col("ill") | (F.col("step") != 0) | (outer == 0) | (F.col("depth") < 0) | (F.col("class") == "EOF") | F.coalesce(token.isin("if", "let", "else", ";"), F.lit(False)))
    rows = rows.select("*", edge).withColumn("level", F.when(F.col("edge") == 0, outer).otherwise(outer + 1))
    along = Window.partitionBy("key", "level").orderBy("pos")
    here = F.col("edge") == 0
    bracket = F.last(F.when(here & (F.col("step") != 0), token), True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rule = lambda make: _by_language(language, lambda g: F.lit(make(g)))
    chance = F.when(here & ((token == "if") | ((token == "let") & (language == "rust"))), 1).when(here & (F.col("class") == "O") & (language != "python"), -1).otherwise(0)
    rows = rows.withColumns({"bracket": bracket, "chances": F.sum(chance).over(along), "parts": F.sum(F.when(here & (token == ";"), 1).otherwise(0)).over(along)})
    start = F.when(F.col("edge") == 1, F.struct("chances", "parts", F.when(token == "(", F.when(F.col("last") == "for", "for").when(F.coalesce(F.col("last") != "!", F.lit(True)), "plain")).alias("kind")))
    rows = rows.withColumn("group", F.last(start, True).over(along))
    held = F.col("parts") - F.coalesce(F.col("group.parts"), F.lit(0))
    kind = F.col("group.kind")
    partner = F.when(token == ")", "(").when(token == "]", "[").otherwise("{")
    nested = here & (F.col("step") < 0) & ~F.coalesce(F.col("bracket") == partner, F.lit(False)) | (F.col("depth") < 0) | ((F.col("class") == "EOF") & (F.col("depth") != 0))
    lost = here & (F.col("class") == "O") & (F.col("chances") - F.coalesce(F.col("group.chances"), F.lit(0)) < 0) & (language != "python")
    needs = reduce(lambda c, g: c | ((language == g.name) & ~held.isin(*g.loop_parts)), [g for g in GRAMMARS.values() if g.loop_parts], F.lit(False))
    parted = (F.col("edge") == -1) & (kind == "for") & needs | here & (token == ";") & (kind == "plain") & ~rule(lambda g: g.parts_elsewhere)
    rows = rows.withColumn("ill", F.col("ill") | F.coalesce(nested | lost | parted, F.lit(False)))
    symbol = F.when(token.isin(*_OPEN), F.concat(token, F.translate(token, "([{", ")]}"))).when(F.col("class").isin("I", "V") | ((language == "c") & (F.col("class") == "Q")), "I").when(F.col("class").isin("N", "S", "T", "EOL"), F.col("class")).otherwise(token)
    top = here & (F.col("level") == 0) & (F.col("step") >= 0) & ~F.col("class").isin("EOF", "D")
    return rows.filter(F.col("ill") | top).select("key", "language", "pos", "class", symbol.alias("symbol"), "indent", "ill")


def _statements(rows: DataFrame) -> DataFrame:
    """(key, language, n, symbols, indent): top-level statements, of Python all logical lines, from the symbols of depth 0.

    A symbol is a token, or a bracket and what it holds. Statements end at
    terminators that depend on the symbols next to them; their number is a running count.
    """
    order = Window.partitionBy("key", "language").orderBy("pos")
    language = F.col("language")
    rows = rows.withColumns({"p_class": F.lag("class").over(order), "p_symbol": F.lag("symbol").over(order), "n_class": F.lead("class").over(order), "n_symbol": F.lead("symbol").over(order)})
    here, before, after = F.col("symbol"), F.col("p_symbol"), F.col("n_symbol")
    carried = lambda g, c: F.coalesce(F.col(c).isin(*g.carries.split()), F.lit(False))
    block = here == "{}"

    def ends(g: Grammar) -> Column:
        if g.name == "python":
            return here.isin("EOL", ";")
        if g.name == "go":
            return (here == ";") | ((here == "EOL") & ~carried(g, "p_class"))
        if g.lines:
            heads = [k for k in g.productions if k not in ("else", "catch", "finally", "while")]
            on = carried(g, "p_class") | F.coalesce(F.col("n_class").isin("B", ".", ",", ":") | (after == "?"), F.lit(False))
            return (here == ";") | ((here == "EOL") & ~on) | (block & F.coalesce(after.isin(*heads), F.lit(False)))
        going = F.coalesce(after.isin(*g.block_goes_on.split()), F.lit(False))
        return (here == ";") | (block & ~going & (F.coalesce(before.isin(*g.block_after), F.lit(False)) if g.block_after else F.lit(True)))

    # A symbol's number is the count of terminators before it.
    number = F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ends", _by_language(language, ends)).withColumn("n", F.coalesce(number, F.lit(0)))
    drop = (here == "EOL") | ((here == ";") & language.isin("python", "go", "js", "ts"))
    kept = F.sort_array(F.collect_list(F.when(~drop, F.struct("pos", "symbol", "indent"))))
    out = rows.groupBy("key", "language", "n").agg(kept.alias("s")).filter(F.size("s") > 0)
    return out.select("key", "language", "n", F.array_join(F.col("s")["symbol"], " ").alias("symbols"), F.col("s")[0]["indent"].alias("indent"))


def _ill_stated(statements: DataFrame) -> DataFrame:
    """Keys of files with a statement that no production of the grammar gives; long ones are matched whole."""
    symbols, language = F.col("core"), F.col("language")
    rust = r"^(?:# (?:! )?\[\] ?)*+(?:pub (?:\(\) )?)?"
    script = r"^(?:(?:export|default|declare|abstract) )*+(?:async (?=function))?"
    rows = statements.withColumn("core", F.when(language == "rust", F.regexp_replace("symbols", rust, "")).otherwise(F.col("symbols")))
    bare = F.when(language.isin("js", "ts"), F.regexp_replace("core", script, "")).otherwise(F.col("core"))
    head = F.substring_index(bare, " ", 1)
    typed = r"^(?:\[\] )*+(?:[a-z]+ )*(?:class|struct|interface|enum|record|delegate) "
    head = F.when((language == "csharp") & symbols.rlike(typed), "type").otherwise(head)
    head = F.when(language.isin("js", "ts") & symbols.startswith("export") & ~head.isin(*GRAMMARS["ts"].productions), "export").otherwise(head)
    rows = rows.withColumn("head", head)

    def good(g: Grammar) -> Column:
        chain = reduce(lambda c, k: c.when(F.col("head") == k, symbols.rlike(f"^(?:{g.productions[k]})$")), list(g.productions)[1:], F.when(F.col("head") == next(iter(g.productions)), symbols.rlike(f"^(?:{next(iter(g.productions.values()))})$")))
        whole = chain.otherwise(symbols.rlike(f"^(?:{g.default})$"))
        if g.name == "python":
            # All that stands before the last "=" is assigned to, up to an annotation; a lambda's arguments have defaults.
            targets = F.substring_index(F.substring(symbols, F.lit(1), F.greatest(F.length(symbols) - F.length(F.substring_index(symbols, " = ", -1)) - 3, F.lit(0))), " : ", 1)
            assigned = F.contains(symbols, F.lit(" = ")) & ~F.contains(symbols, F.lit("lambda ")) & ~F.col("head").isin(*g.productions)
            odd = F.contains(symbols, F.lit(" = lambda ")) & F.substring_index(symbols, " lambda ", 1).rlike(r"(?:^|= )[NS] =$| [-+*/%|&^] [INST]+ =$")
            whole = whole & ~(assigned & targets.rlike(NO_TARGET)) & ~odd
        if g.name == "rust":  # attributes of the whole file may stand alone
            whole = whole | ((symbols == "") & F.col("symbols").rlike(r"^(?:# ! \[\] ?)++$"))
        if g.first:
            whole = whole & ((F.col("n") == F.col("lead")) == (F.col("head") == g.first))
        return whole

    rows = rows.withColumn("lead", F.min("n").over(Window.partitionBy("key", "language")))
    return rows.filter(~_by_language(language, good)).select("key", "language").distinct()


def _ill_indented(statements: DataFrame) -> DataFrame:
    """Keys of Python files whose blocks don't fit: a fold over the lines keeps the stack of open levels."""
    compound = ["if", "elif", "else", "for", "while", "with", "try", "except", "finally", "def", "class", "async", "match", "case"]
    head = F.substring_index("symbols", " ", 1)
    lines = statements.filter("language = 'python' and indent is not null").select("key", "language", F.struct("n", "indent", head.alias("head"), (head.isin(*compound) & F.col("symbols").endswith(" :")).alias("opens")).alias("line"))
    lines = lines.groupBy("key", "language").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    state = "named_struct('stack', array(named_struct('indent', 0, 'head', cast('' as string))), 'opens', false, 'ok', true)"
    follows = "case l.head when 'elif' then p.head in ('if', 'elif') when 'else' then p.head in ('if', 'elif', 'for', 'while', 'async', 'except') when 'except' then p.head in ('try', 'except') when 'finally' then p.head in ('try', 'except', 'else') else p.head <> 'try' end"
    # What stays of the stack, then the level of the line on it.
    fold = f"""aggregate(lines, {state}, (a, l) ->
      if(not a.ok, a,
        if(a.opens,
          named_struct('stack', array_append(a.stack, named_struct('indent', l.indent, 'head', l.head)), 'opens', l.opens, 'ok', l.indent > element_at(a.stack, -1).indent and l.head not in ('elif', 'else', 'except', 'finally')),
          aggregate(array(element_at(filter(a.stack, s -> s.indent <= l.indent), -1)), a, (b, p) -> named_struct(
            'stack', array_append(filter(a.stack, s -> s.indent < l.indent), named_struct('indent', l.indent, 'head', l.head)),
            'opens', l.opens,
            'ok', p.indent = l.indent and not exists(a.stack, s -> s.indent > l.indent and s.head = 'try') and {follows})))),
      a -> a.ok and not a.opens and not exists(a.stack, s -> s.head = 'try'))"""
    return lines.filter(~F.expr(fold)).select("key", "language")


def source_files(docs: DataFrame, rules: DataFrame, *, id: str = "doc_id", path: str = "path", text: str = "text", repo: str = "repo", skip: tuple[str, ...] = ("md",)) -> DataFrame:
    """(id, repo, path, language, text) of documents whose path has an extension of a rule's language."""
    known = rules.filter(~F.col("language").isin(*skip)).select("language", F.explode("extensions").alias("ext")).select("language", F.lower("ext").alias("ext"))
    rows = docs.select(F.col(id).alias("id"), F.col(repo).alias("repo"), clean_path(F.col(path)).alias("path"), F.col(text).alias("text"))
    return rows.withColumn("ext", extension(F.col("path"))).join(broadcast_if_small(known, 10_000), "ext").drop("ext")


def invalid_files(docs: DataFrame, rules: DataFrame, **columns: str) -> DataFrame:
    """(id, repo, language, valid) of each source file in a language that has a grammar.

    ``docs`` has an id, repo, path and text, ``rules`` a language and its extensions. Texts are lexed into
    rows; a file is invalid with a token that its language doesn't have (a stray quote, a conflict
    marker), a pair of neighbouring tokens that the grammar doesn't permit, brackets that don't
    match, a statement that is none of its productions, or Python blocks that don't fit their
    indentation. An empty or blank text is valid, a null one neither (valid is null). Exact copies are examined once.
    """
    files = source_files(docs, rules, **columns).filter(F.col("language").isin(*GRAMMARS)).withColumn("md5", F.md5("text"))
    texts = files.filter("length(text) > 0").groupBy("md5", "language").agg(F.min("text").alias("text"))
    texts = materialize(texts.withColumn("key", F.monotonically_increasing_id()))
    # One exchange by file: all windows below keep this partitioning, and every text is lexed once.
    judged = materialize(_judged(_tokens(texts.select("key", "language", "text").repartition("key"))))
    bad = materialize(judged.filter("ill").select("key").distinct())
    rest = judged.join(broadcast_if_small(bad), "key", "left_anti")
    statements = materialize(_statements(rest))
    bad = bad.unionByName(_ill_stated(statements).select("key")).unionByName(_ill_indented(statements).select("key")).distinct()
    bad = texts.select("key", "md5", "language").join(broadcast_if_small(bad), "key", "left_semi").select("md5", "language", F.lit(True).alias("bad"))
    return files.join(bad, ["md5", "language"], "left").select("id", "repo", "language", F.when(F.col("text").isNotNull(), F.col("bad").isNull()).alias("valid"))


def invalid_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate): how many files of a repo and language aren't valid."""
    out = checked.groupBy("repo", "language").agg(F.count("valid").alias("files"), F.count(F.when(~F.col("valid"), 1)).alias("invalid"))
    return out.withColumn("rate", F.try_divide("invalid", "files"))
