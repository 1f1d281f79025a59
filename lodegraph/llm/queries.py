"""The pN_ queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.handwritten import foreign_files
from lodegraph.llm.leakage import leaked_items, leaked_passages
from lodegraph.llm.lookalike import canonical_texts, lookalike_pairs, sql_form
from lodegraph.llm.mixing import mix_sources
from lodegraph.llm.syntax import invalid_files, invalid_rates
from lodegraph.llm.topn import top_n_per_group
from lodegraph.operators.latest import latest, trimmed
from lodegraph.workspace import table


def _heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "violations").select("violation_id", "ingested_at", "repo", "language", F.lower(trimmed(F.col("rule_group"))).alias("rule_group"), "weight", "location")
    rows = latest(rows, ["violation_id"], "ingested_at").filter("rule_group is not null")
    return top_n_per_group(rows.drop("ingested_at"), ["repo", "language", "rule_group"], "weight", ["location", "violation_id"], 3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest violations of every repo, language and rule group."""
    return _heaviest(spark, sf_dir).select("violation_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with group, weight and rank."""
    return _heaviest(spark, sf_dir).select("repo", "language", "rule_group", "violation_id", "weight", "rank")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_rules"), table(spark, sf_dir, "ignore_rules"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that nobody of their repo wrote by hand."""
    return _judged(spark, sf_dir).filter("generated or minified or vendored or data or skipped or ignored").select(F.col("id").alias("doc_id"))


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file with what speaks against handwork."""
    return _judged(spark, sf_dir).withColumnRenamed("id", "doc_id")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_rules"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are no valid file of their language."""
    return _checked(spark, sf_dir).filter("not valid").select(F.col("id").alias("doc_id"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of invalid files by repo and language."""
    return invalid_rates(_checked(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they contain a passage."""
    return leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with edited passages, and how similar the most similar one is."""
    return leaked_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items")).withColumn("similarity", F.round("similarity", 6))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus in its shuffled order."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix reaches."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    return lookalike_pairs(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the canonical text of its look-alike class."""
    return canonical_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked, "p4_found": p4_found, "p4_reasons": p4_reasons, "p6_found": p6_found, "p6_rates": p6_rates, "p8_found": p8_found, "p8_near": p8_near, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_canonical": p10_canonical}

_P1 = r"""
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY violation_id ORDER BY ingested_at DESC, repo DESC) AS rn FROM violations
), k AS (
  SELECT repo, language, lower(regexp_replace(rule_group, '^\s+|\s+$', '', 'g')) AS rule_group, violation_id, weight, location
  FROM d WHERE rn = 1 AND rule_group IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY repo, language, rule_group ORDER BY weight DESC, location, violation_id) AS rank FROM k
)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT violation_id FROM r WHERE rank <= 3",
    "p1_ranked": _P1 + "SELECT repo, language, rule_group, violation_id, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3",
    "p10_found": f"""
WITH k AS (SELECT doc_id, text, {sql_form("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
""",
    "p10_canonical": f"SELECT doc_id, text, min(text) OVER (PARTITION BY form) AS canonical_text FROM (SELECT doc_id, text, {sql_form('text')} AS form FROM documents)",
    "p8_found": r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
p AS (
  SELECT DISTINCT item_id, least(15, len(w)) AS size, array_to_string(w[i + 1 : i + least(15, len(w))], ' ') AS passage
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(15, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)
),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (
  SELECT doc_id, size, array_to_string(w[i + 1 : i + size], ' ') AS passage
  FROM (SELECT doc_id, w, size, unnest(range(0, greatest(0, len(w) - size + 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM p))
)
SELECT DISTINCT doc_id, item_id FROM s JOIN p USING (size, passage)
""",
}
