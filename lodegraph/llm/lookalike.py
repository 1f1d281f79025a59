"""One form for texts that look the same but differ in their characters."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.workspace import broadcast_if_small, materialize

# Letters of Cyrillic and Greek, then hyphens, and what they look like in Latin.
_CYRILLIC = ("аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅԚԜҮҺ", "aeopcyxijsdqwhABEKMHOPCTYXIJSQWYh")
_RARE = ("ӏӀүѵѴԌԍҽ", "lIyvVGge")
_GREEK = ("ονραυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹϳͿ", "ovpauABEZHIKMNOPTYXcCjJ")
#: Letters of Cyrillic that look like Greek ones without a Latin form.
_SHARED = ("ГПФкф", "ΓΠΦκφ")
_OTHER = ("‐‑", "--")
#: Accented letters of other scripts whose base looks like a Latin letter, by composition.
_MARKS = "̈́̀̆̄̃̂̇̊̌"


def _presentation() -> tuple[str, str, dict[str, str]]:
    """Presentation forms, by rule from the Unicode database: a character whose compatibility form is another one.

    Returns those that stand for one character as two parallel texts, and ligatures by their letters.
    """
    one, ligatures = [], {}
    for point in [*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        char = chr(point)
        form = unicodedata.normalize("NFKC", char)
        if form != char and not 0xD800 <= point < 0xE000:
            kind = unicodedata.decomposition(char)
            if len(form) == 1 and kind.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")):
                one.append((char, form))
            elif kind.startswith("<compat>") and form.isalpha() and unicodedata.category(char).startswith("L"):
                ligatures[char] = form
    return "".join(a for a, _ in one), "".join(b for _, b in one), ligatures


def _tables() -> tuple[str, str, dict[str, str]]:
    source, target, ligatures = _presentation()
    pairs = dict(zip(source, target, strict=True))
    alike = {a: b for s, t in (_CYRILLIC, _RARE, _GREEK, _SHARED, _OTHER) for a, b in zip(s, t, strict=True)}
    for letter, latin in list(alike.items()):  # a composed letter goes with its base
        for mark in _MARKS:
            a, b = unicodedata.normalize("NFC", letter + mark), unicodedata.normalize("NFC", latin + mark)
            if len(a) == 1 and len(b) == 1:
                alike[a] = b
    pairs = {a: alike.get(b, b) for a, b in pairs.items()} | alike
    return "".join(pairs), "".join(pairs.values()), ligatures


_SOURCE, _TARGET, _LIGATURES = _tables()
#: Ligatures that are spelled out; others are left to the collation.
_SPELLED = "ﬀﬁﬂﬃﬄﬅﬆĲĳǇǈǉǊǋǌǱǲǳ"
#: Blanks of any width but line ends and tabs; characters that show nothing.
_BLANK = "[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]"
_HIDDEN = "[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff]"


def mapped(text: Column) -> Column:
    """``text`` with look-alike letters, presentation forms and blanks replaced by plain ones and
    invisible characters removed. Accents stay as they are; collation compares their composition."""
    out = F.regexp_replace(F.regexp_replace(text, _HIDDEN, ""), _BLANK, " ")
    plain = F.translate(out, _SOURCE, _TARGET)
    for char, letters in _LIGATURES.items():
        if char in _SPELLED:
            plain = F.replace(plain, F.lit(char), F.lit(letters))
    return F.when(text.rlike("^[\\x00-\\x7f]*$"), text).otherwise(plain)


def _case(plain: Column) -> Column:
    """The letters of a text as capital or not: what the collation below doesn't compare."""
    marked = F.regexp_replace(F.regexp_replace(plain, "[^\\p{L}]+", ""), "\\p{Lu}", "\u0001")
    return F.xxhash64(F.regexp_replace(marked, "[^\\u0001]", "a"))


def lookalike_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, texts) of texts that look the same as another, differing text.

    ``members`` is (id, text_key, class_key): documents of classes with two or more differing
    texts. ``texts`` is (class_key, text_key, canonical): each differing text of such a class once,
    with the class's canonical text, the smallest by code points. A class holds the texts that are
    equal in the accent-sensitive Unicode collation after look-alike mapping, and in the case of
    all letters. Null texts belong to no class; empty ones form one with texts that show nothing.
    Exact copies share a text_key, so a large group of copies is one text in the comparison.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.md5(text).alias("text_key"), F.col(text).alias("text"))
    # One row per differing text: the aggregation combines copies before the shuffle.
    texts = rows.groupBy("text_key").agg(F.min("text").alias("text")).withColumn("plain", mapped(F.col("text")))
    texts = materialize(texts.withColumn("case", _case(F.col("plain"))))
    keyed = texts.withColumn("alike", F.collate("plain", "UNICODE_CI"))
    classes = keyed.groupBy("alike", "case").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("canonical"), F.min("text_key").alias("class_key"))
    classes = materialize(classes.filter("n > 1").select(F.collate("alike", "UTF8_BINARY").alias("c_plain"), F.col("case").alias("c_case"), "canonical", "class_key"))
    bounded = broadcast_if_small(classes.withColumn("c_alike", F.collate("c_plain", "UNICODE_CI")), 20_000)
    found = keyed.join(bounded, (F.col("alike") == F.col("c_alike")) & (F.col("case") == F.col("c_case"))).select("class_key", "text_key", "canonical")
    found = materialize(found)
    keys = broadcast_if_small(found.select("class_key", "text_key"))
    return rows.select("id", "text_key").join(keys, "text_key"), found


def canonical_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``canonical_text``: the canonical member of the text's class, or the text itself."""
    _, texts = lookalike_classes(docs, id, text)
    found = texts.select(F.col("text_key").alias("_lg_key"), F.col("canonical").alias("_lg_canonical"))
    return docs.join(found, F.md5(text) == F.col("_lg_key"), "left").withColumn("canonical_text", F.coalesce("_lg_canonical", text)).drop("_lg_key", "_lg_canonical")


def lookalike_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all documents whose texts differ but look the same."""
    members, _ = lookalike_classes(docs, id, text)
    members = materialize(members)
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.class_key") == F.col("b.class_key")) & (F.col("a.text_key") < F.col("b.text_key")))
    return pairs.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def sql_form(text: str) -> str:
    """SQL for one form of a text by the same tables, composed: what the collation compares, without a collation."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    hidden = "[" + "".join(_points(_HIDDEN)) + "]"
    blank = "[" + "".join(_points(_BLANK)) + "]"
    out = f"translate(regexp_replace(regexp_replace({text}, '{hidden}', '', 'g'), '{blank}', ' ', 'g'), {quote(_SOURCE)}, {quote(_TARGET)})"
    for char, letters in _LIGATURES.items():
        if char in _SPELLED:
            out = f"replace({out}, {quote(char)}, {quote(letters)})"
    return f"nfc_normalize(translate(nfc_normalize({out}), {quote(_SOURCE)}, {quote(_TARGET)}))"


def _points(pattern: str) -> list[str]:
    return [f"\\x{{{code}}}{dash}" for code, dash in re.findall(r"\\u([0-9a-f]{4})(-?)", pattern)]
