"""Scalar functions as columns."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def count_rows() -> Column:
    return F.count(F.lit(1))


def positive_int(c: Column) -> Column:
    """Digits only and above zero, else null."""
    n = F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    return F.when(n > 0, n)


def ordinal(day: Column) -> Column:
    """Proleptic ordinal: 1 is 0001-01-01."""
    return F.unix_date(day) + 719163


def digits_year(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 4)


def blank_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def safe_ratio(a: Column, b: Column) -> Column:
    """Division with null for a zero below and for results that aren't finite."""
    q = F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    return F.when(F.abs(q) != float("inf"), q)


def short_id(length: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def monotone(*parts: Column) -> list[Column]:
    """Running maximum over the columns, each clipped to 0..1."""
    out: list[Column] = []
    for p in parts:
        q = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
        out.append(F.greatest(out[-1], q) if out else q)
    return out


def year_partition(day_text: Column) -> Column:
    y = digits_year(day_text)
    return F.when(F.length(y) == 4, y).otherwise("UNKNOWN")


def domain_partition(code: Column) -> Column:
    c = F.trim(code.cast("string"))
    return F.when(c == "1", "JRA").when(c == "2", "NAR").when(c == "3", "OVERSEAS").otherwise("UNKNOWN")


def date_pieces(first: str, last: str) -> Column:
    """yyyyMMdd range over columns year and mmdd (text): one piece per year."""
    a, b = int(first[:4]), int(last[:4])
    out = F.lit(False)
    for y in range(a, b + 1):
        out = out | ((F.col("year") == y) & F.col("mmdd").between(first[4:] if y == a else "0101", last[4:] if y == b else "1231"))
    return out


def ln(x: Column) -> Column:
    """Natural logarithm as the C library has it, and engines that use it (null for none); Spark's own differs in the last digit of one value in twenty."""
    return F.when(x > 0, F.arrow_udf(lambda a: pc.ln(a), "double")(x))
