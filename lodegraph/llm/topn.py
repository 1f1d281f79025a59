"""The N best rows of every group, found by bisecting all groups at the same time.

Every row has an order-preserving code: first a 64-bit image of the score, then digits of the
identifiers. A cutoff interval per group is narrowed by counting rows between midpoints: one
round sets 2**LEVELS equally spaced midpoints in every open interval (LEVELS halvings at once),
counts the rows between them with a map-side combined aggregation, and keeps the section that
holds the N-th row. Tasks see counts of a group, never its rows together: cutoffs, one row per
group, come to the rows by a broadcast if their measured bytes allow it, otherwise by a join in
which the rows of large groups, known from the counts, are spread over SALTS keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodegraph.workspace import mark, materialize, release

#: Halvings per round of an interval, and of the first round over the whole score range.
LEVELS = 10
FIRST_LEVELS = 14
#: Base-17 digits that fit into one signed 64-bit word.
WORD = 15
#: Bytes of cutoffs up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys over which a large group's rows are spread. A group is large from LARGE rows on, or from the
#: table's rows over LARGE_GROUPS, so that there are never more than LARGE_GROUPS of them.
SALTS, LARGE, LARGE_GROUPS = 64, 100_000, 100_000
_HEX, _DIGITS = "0123456789ABCDEF", "123456789ABCDEFG"
_SIGN = -(1 << 63)


def score_code(score: Column, dtype: T.DataType, descending: bool = True) -> Column:
    """A bigint that ascends as ``score`` goes from best to worst; null for null and NaN.

    Whole numbers are their own code. Of doubles the sign-magnitude bits are made monotone, -0.0
    and 0.0 sharing a code.
    """
    if isinstance(dtype, T.IntegralType):
        ascending = score.cast("bigint")
    else:
        number = score.cast("double")
        clean = F.when(~F.isnan(number), number + F.lit(0.0))
        bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), clean).cast("bigint")
        code = F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)
        ascending = F.when(clean.isNotNull(), code)
    return F.bitwise_not(ascending) if descending else ascending


def _word_digits(word: Column) -> Column:
    return F.translate(F.lpad(F.hex(word.bitwiseXOR(F.lit(_SIGN))), 16, "0"), _HEX, _DIGITS)


def identifier_digits(column: Column, dtype: T.DataType) -> Column:
    """Digits 1-9A-G whose text order is the order of the values: numbers by value, others by the
    UTF-8 bytes (code points) of their text, nulls last. A 0 ends a text, so that a prefix sorts first."""
    if isinstance(dtype, T.IntegralType):
        digits = _word_digits(column.cast("bigint"))
    else:
        digits = F.concat(F.translate(F.hex(column.cast("string")), _HEX, _DIGITS), F.lit("0"))
    return F.coalesce(F.concat(F.lit("1"), digits), F.lit("2"))


def _word(code: Column, offset: Column) -> Column:
    """The WORD digits of a code from ``offset`` on, as a number."""
    return F.conv(F.rpad(F.substring(code, offset + 1, F.lit(WORD)), WORD, "0"), 17, 10).cast("bigint")


def _common_prefix(a: Column, b: Column) -> Column:
    """Number of leading digits in which two different codes agree."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    first = F.array_position(F.transform(places, lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.length(a), F.length(b))).cast("int")


def _mark(keys: list[str]) -> Column:
    return F.xxhash64(F.lit(SALTS), *keys)


def _attach(rows: DataFrame, values: DataFrame, group: list[str], how: str, heavy: DataFrame | None) -> DataFrame:
    """Rows with the values of their group, one row per group; keys may be null.

    Without ``heavy``, the marks of large groups, the values are small enough for a broadcast. A group
    that shares its mark with a large one is only spread without need.
    """
    names = {k: f"_r_{k}" for k in group}
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    values = values.withColumnsRenamed(names)
    if heavy is None:
        return rows.join(F.broadcast(values), on, how).drop(*names.values())
    spread = lambda df, keys: df.withColumn("_lg_mark", _mark(keys)).join(F.broadcast(heavy), F.col("_lg_mark") == F.col("_lg_heavy"), "left").drop("_lg_mark")
    salt = F.when(F.col("_lg_heavy").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_lg_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = spread(rows, group).withColumn("_lg_salt", salt).drop("_lg_heavy")
    copied = spread(values, list(names.values())).withColumn("_r_salt", F.explode(copies)).drop("_lg_heavy")
    return salted.join(copied.hint("shuffle_hash"), on & (F.col("_lg_salt") == F.col("_r_salt")), how).drop("_lg_salt", "_r_salt", *names.values())


def top_n_per_group(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, *, descending: bool = True, rank: str | None = "rank", broadcast_bytes: int = BROADCAST_BYTES, large: int = LARGE) -> DataFrame:
    """The ``n`` best rows of each group by ``score``, ties settled by ``ties`` ascending.

    All columns of ``df`` are kept; ``rank`` (if named) numbers the rows of a group from 1. Rows
    whose score is null or NaN are left out. Null group keys form a group like any other. Null tie
    columns come last. Rows that equal the n-th one in score and all tie columns (repeated rows)
    are all kept and have one rank, so that the result never depends on row order. A group with
    fewer rows is kept whole; an empty table gives an empty table. Columns beginning with ``_lg_`` or ``_r_``
    are reserved. Cutoffs of more than ``broadcast_bytes``, counted first, are joined with salts for groups of ``large`` rows or more.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if not group:
        raise ValueError("name at least one group column")
    types = {f.name: f.dataType for f in df.schema.fields}
    start = mark()
    base = materialize(df.withColumn("_lg_score", score_code(F.col(score), types[score], descending)).filter("_lg_score is not null"))

    # First round: 2**FIRST_LEVELS - 1 midpoints of the whole score range for every group.
    section = F.shiftright("_lg_score", 64 - FIRST_LEVELS).cast("int")
    counts = materialize(base.groupBy(*group, section.alias("_lg_sec")).agg(F.count(F.lit(1)).alias("_lg_n")))
    cut = (
        _nth_section(counts, group, F.lit(n))
        .select(*group, F.col("_lg_sec").alias("_lg_cut"), (F.lit(n) - F.col("_lg_before")).alias("_lg_need"), F.col("_lg_n").alias("_lg_in"))
    )
    width = reduce(lambda a, k: a + F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)), group, F.lit(48))
    groups = counts.groupBy(*group).agg(F.sum("_lg_n").alias("_lg_all"))
    size, total = groups.agg(F.coalesce(F.sum(width), F.lit(0)), F.coalesce(F.sum("_lg_all"), F.lit(0))).first()
    # Later rounds have no more groups, and no larger ones, than the first.
    heavy = None if size <= broadcast_bytes else materialize(groups.filter(F.col("_lg_all") >= max(large, total // LARGE_GROUPS)).select(_mark(group).alias("_lg_heavy")).distinct())
    attach = lambda rows, values, how: _attach(rows, values, group, how, heavy)
    codes = F.concat(_word_digits(F.col("_lg_score")), *[identifier_digits(F.col(t), types[t]) for t in ties])
    near = attach(base, cut, "left").filter(F.col("_lg_cut").isNull() | (section <= F.col("_lg_cut")))
    unsure = (section == F.col("_lg_cut")) & (F.col("_lg_in") > F.col("_lg_need"))
    candidates = materialize(near.withColumns({"_lg_open": F.coalesce(unsure, F.lit(False)), "_lg_code": codes}).drop("_lg_score", "_lg_cut", "_lg_in"))

    # Further rounds: only rows inside an interval that still holds more rows than are needed.
    rows = candidates.filter("_lg_open").select(*group, "_lg_code", "_lg_need")
    state = rows.groupBy(*group).agg(F.first("_lg_need").alias("_lg_need"), F.min("_lg_code").alias("_lg_lo"), F.max("_lg_code").alias("_lg_hi"))
    state = materialize(state.withColumn("_lg_done", F.col("_lg_lo") == F.col("_lg_hi")))
    rows = rows.drop("_lg_need")
    cutoffs = [state.filter("_lg_done")]
    while not (todo := state.filter("not _lg_done")).isEmpty():
        places = todo.withColumn("_lg_off", _common_prefix(F.col("_lg_lo"), F.col("_lg_hi")))
        low, high = _word(F.col("_lg_lo"), F.col("_lg_off")), _word(F.col("_lg_hi"), F.col("_lg_off"))
        shift = F.greatest(F.lit(0), F.floor(F.log2(high - low + 1)).cast("int") + 1 - LEVELS)
        places = places.withColumns({"_lg_low": low, "_lg_shift": shift}).drop("_lg_done")
        inside = attach(rows, places, "inner").filter("_lg_code between _lg_lo and _lg_hi")
        sec = F.expr("shiftright(_lg_word - _lg_low, _lg_shift)")
        counts = inside.withColumn("_lg_word", _word(F.col("_lg_code"), F.col("_lg_off"))).groupBy(*group, "_lg_need", sec.alias("_lg_sec")).agg(F.count(F.lit(1)).alias("_lg_n"), F.min("_lg_code").alias("_lg_lo"), F.max("_lg_code").alias("_lg_hi"))
        left = F.col("_lg_need") - F.col("_lg_before")
        state = materialize(
            _nth_section(counts, group, F.col("_lg_need"))
            .select(*group, left.alias("_lg_need"), "_lg_lo", "_lg_hi", ((F.col("_lg_n") == left) | (F.col("_lg_lo") == F.col("_lg_hi"))).alias("_lg_done"))
        )
        cutoffs.append(state.filter("_lg_done"))
    ends = reduce(DataFrame.unionByName, cutoffs).select(*group, F.col("_lg_hi").alias("_lg_end"))
    best = attach(candidates.drop("_lg_need"), ends, "left").filter("not _lg_open or _lg_code <= _lg_end")
    if rank:
        # A group has at most n codes here, however often the row of a code is repeated.
        best = materialize(best)
        order = Window.partitionBy(*group).orderBy("_lg_code")
        upto = best.groupBy(*group, "_lg_code").agg(F.count(F.lit(1)).alias("_lg_n")).withColumn("_lg_rank", F.sum("_lg_n").over(order) - F.col("_lg_n") + 1)
        ranks = upto.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_lg_code", F.col("_lg_rank").cast("int")))).alias("_lg_ranks"))
        best = attach(best, ranks, "left").withColumn(rank, F.element_at("_lg_ranks", F.col("_lg_code")))
    best = best.select(*df.columns, *([rank] if rank else []))
    release(start, keep=best)
    return best


def _nth_section(counts: DataFrame, group: list[str], need: Column) -> DataFrame:
    """The section of each group that holds its ``need``-th row, with the rows before it.

    The window sees at most 2**FIRST_LEVELS counts of a group. A group with fewer rows has none.
    """
    upto = F.sum("_lg_n").over(Window.partitionBy(*group).orderBy("_lg_sec"))
    return counts.withColumn("_lg_upto", upto).withColumn("_lg_before", F.col("_lg_upto") - F.col("_lg_n")).filter((F.col("_lg_before") < need) & (need <= F.col("_lg_upto")))
