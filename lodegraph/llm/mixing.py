"""A corpus mixed from several sources by target shares of its size in tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.latest import trimmed
from lodegraph.workspace import broadcast_if_small, materialize

#: Sources that may be mixed; their rates are a small table of the driver.
MAX_SOURCES = 100_000


def default_vocabulary() -> str:
    """The path of a public byte-level vocabulary (base64 token and rank per line), from the module public_tokenizers beside the vocabulary files; without it name a file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_counter(spark: SparkSession, vocabulary: str, pattern: str | None = None):  # noqa: ANN201
    """A pandas UDF that counts the tokens of whole texts; a null text has none. The vocabulary is read here and sent to the executors."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    shared = spark.sparkContext.broadcast((Path(vocabulary).read_bytes(), pattern))

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        lines, split = shared.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return count


def clean_source(source: Column) -> Column:
    """A source name in lower case, without outer blanks, with "_" for "-"."""
    return F.replace(F.lower(trimmed(source)), F.lit("-"), F.lit("_"))


def capped_mean(mean: float, cap: int) -> float:
    """The mean of min(X, cap) for a Poisson X. Terms are logarithms, so that none is lost for a large mean."""
    if mean <= 0:
        return 0.0
    log_term, total, below = -mean, 0.0, 0.0
    for k in range(cap):
        term = math.exp(log_term)
        total += k * term
        below += term
        log_term += math.log(mean) - math.log(k + 1)
    return total + cap * max(1.0 - below, 0.0)


def poisson_mean(rate: float, cap: int) -> float:
    """The Poisson mean whose draws, capped at ``cap``, average ``rate``; infinity if rate is the cap."""
    if rate >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < rate and high < 2.0 * cap + 1000:
        high *= 2
    if capped_mean(high, cap) < rate:
        return math.inf
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < rate else (low, middle)
    return high


def plan_rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[tuple[str, float, int, float, float]]:
    """(source, target_share, max_repeats, rate, poisson_mean) for each target.

    Shares of sources without tokens can't be met and are spread over the others in proportion.
    Without ``total`` the mix is as large as the caps allow: until some source is used up.
    """
    live = {s: w for s, w, cap in targets if w > 0 and cap > 0 and sizes.get(s, 0) > 0}
    weight = sum(live.values())
    caps = {s: cap for s, _, cap in targets}
    most = min((caps[s] * sizes[s] / (w / weight) for s, w in live.items()), default=0.0)
    size = most if total is None else min(total, most)
    out = []
    for s, w, cap in targets:
        rate = min(cap, size * (live[s] / weight) / sizes[s]) if s in live else 0.0
        # The source that bounds the mix is taken whole; rounding must not turn that into a draw.
        rate = float(cap) if s in live and rate > cap * (1 - 1e-12) else rate
        out.append((s, w, cap, rate, poisson_mean(rate, cap) if rate else 0.0))
    return out


def _draws(key: Column, rates: Column, cap: Column, seed: int) -> Column:
    """How often a document is taken: its uniform hash value, put through the inverse of the capped Poisson distribution."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    steps = F.aggregate(
        F.sequence(F.lit(1), cap),
        # Logarithms of the terms: the first of a large mean is below the least double.
        F.struct((-rates).alias("term"), F.exp(-rates).alias("upto"), F.lit(0).alias("n")),
        lambda a, k: F.struct(
            (a["term"] + F.ln(rates) - F.ln(k.cast("double"))).alias("term"),
            (a["upto"] + F.exp(a["term"] + F.ln(rates) - F.ln(k.cast("double")))).alias("upto"),
            (a["n"] + F.when(uniform > a["upto"], 1).otherwise(0)).alias("n"),
        ),
        lambda a: a["n"],
    )
    return F.when(rates == float("inf"), cap).when((cap > 0) & (rates > 0), steps).otherwise(0)


def mix_sources(docs: DataFrame, targets: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, vocabulary: str | None = None, pattern: str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix, report): the mixed corpus and the shares it reached.

    ``mix`` is (id, source, n_tokens, copy, place, text), globally shuffled by the random ``place``: each
    document as often as its draw of a Poisson distribution says, at most max_repeats times. The
    draw depends on id and seed only, so that a rerun gives the same mix. ``report`` has a row per
    target source: its tokens, the rate aimed at, documents, copies and tokens taken, target and actual
    share. Source names are compared cleaned; documents with a null or unknown source are never
    taken. Empty texts have no tokens but are drawn like the others. Columns of targets: source, target_share, max_repeats.
    """
    spark = docs.sparkSession
    count = token_counter(spark, vocabulary or default_vocabulary(), pattern)
    goal = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().limit(MAX_SOURCES + 1).collect()]
    if len(goal) > MAX_SOURCES:
        raise ValueError("too many sources")
    rows = docs.select(F.col(id).alias("id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(g[0] for g in goal)], "source string")
    rows = rows.join(broadcast_if_small(wanted), "source", "left_semi")
    rows = materialize(rows.withColumn("n_tokens", count("text")))
    # No more sources than targets, whose number was checked.
    sizes = {r[0]: int(r[1]) for r in rows.groupBy("source").agg(F.sum("n_tokens")).collect()}
    plan = spark.createDataFrame(plan_rates(sizes, goal, total_tokens), "source string, target_share double, max_repeats int, rate double, mean double")
    drawn = rows.join(broadcast_if_small(plan), "source").withColumn("times", _draws(F.col("id"), F.col("mean"), F.col("max_repeats"), seed).cast("int"))
    taken = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("times").alias("copies"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens_taken"))
    report = plan.join(taken, "source", "left").na.fill(0, ["documents", "tokens", "copies", "tokens_taken"])
    # The report has one row per target source.
    report = report.withColumn("all_taken", F.sum("tokens_taken").over(Window.partitionBy()))
    report = report.select("source", "target_share", "max_repeats", "rate", "documents", "tokens", "copies", "tokens_taken", F.coalesce(F.try_divide("tokens_taken", "all_taken"), F.lit(0.0)).alias("actual_share"))
    copies = drawn.filter("times > 0").select("id", "source", "n_tokens", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed + 1), "id", "copy"))
    mix = copies.repartitionByRange("place").sortWithinPartitions("place", "id", "copy")
    return mix.select(F.col("id").alias(id), F.col("source").alias(source), "n_tokens", "copy", "place", F.col("text").alias(text)), report
