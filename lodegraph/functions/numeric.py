"""Numbers as the reports show them: truncation, floors, exact logarithms, short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(x: Column) -> Column:
    """Null, non-finite and 0 give 0; from 1 on three decimals are kept, below three significant figures. Digits are cut off, not rounded."""

    def cut(v: Column) -> Column:
        size = F.abs(v)
        places = F.when(size >= 1, F.lit(1000.0)).otherwise(F.pow(F.lit(10.0), 2 - F.floor(F.log10(size)).cast("double")))
        whole = F.floor(size * places).cast("double") / places
        return F.when(v.isNull() | F.isnan(v) | (size == float("inf")) | (size == 0), F.lit(0.0)).otherwise(F.signum(v) * whole)

    # A one-element array binds the value, so that a formula is evaluated once however often it is read.
    return F.get(F.transform(F.array(x.cast("double")), cut), F.lit(0))


def present(x: Column, floor: float = 0.0) -> Column:
    """The truncated value, null where it equals the value that means absence."""
    return F.nullif(truncated(x), F.lit(float(floor)))


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def exact_log2(x: Column) -> Column:
    """log2 that is whole for powers of two; null for what has none."""
    value = F.log2(x)
    near = F.round(value)
    return F.when(F.abs(value - near) < 1e-12, near).otherwise(value)


def abbreviated(x: Column) -> Column:
    """1.2K, 3.4M, 5.6B from a thousand on; whole numbers without decimals, others with up to two."""
    size = F.abs(x)
    short = lambda unit, letter: F.concat(F.regexp_replace(F.format_string("%.1f", x / unit), r"\.0$", ""), F.lit(letter))
    plain = F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.format_string("%.2f", x), r"0$", ""))
    return F.when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "K")).when(x.isNotNull(), plain)


def shown(x: Column) -> Column:
    """A number in a message: whole ones without decimals, others with two."""
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).when(x.isNotNull(), F.format_string("%.2f", x))


_UNITS = {"K": 10**3, "M": 10**6, "G": 10**9}


def parse_number(text: str | float) -> float:
    """A number of a configuration: 1_000, 2.5K, 3M or 1G."""
    if isinstance(text, (int, float)):
        return float(text)
    plain = text.strip().replace("_", "")
    unit = _UNITS.get(plain[-1:].upper())
    return float(plain[:-1]) * unit if unit else float(plain)


def grouped(number: int) -> str:
    """Digits in groups of three, with "_"."""
    return f"{number:_}"
