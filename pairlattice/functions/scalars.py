"""Scalar functions of reports: library size, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def library_size(dups: Column, unique: Column, steps: int = 200) -> Column:
    """Lander-Waterman estimate: x with unique / x = 1 - exp(-total / x), by bisection on x / unique.

    The upper end is raised by tens (to 1e15 at most) until the sign changes. 0 without duplicates;
    null if there are no unique pairs, where the equation has no solution.
    """
    u, n = unique.cast("double"), (unique + dups).cast("double")
    f = lambda r: F.lit(1.0) / r - 1 + F.exp(-n / (r * u))
    tens = F.array(*[F.lit(float(10**k)) for k in range(2, 16)])
    top = F.element_at(F.filter(tens, lambda m: f(m) < 0), 1)
    bottom = F.when(top > 100, top / 10).otherwise(F.lit(1.0))
    start = F.struct(bottom.alias("lo"), top.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(f(mid) > 0, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return F.when((dups <= 0) | (dups + unique <= 0), F.lit(0)).when(unique <= 0, F.lit(None)).otherwise((u * (end["lo"] + end["hi"]) / 2).cast("long"))


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(n: Column, total: Column, digits: int = 2) -> Column:
    return F.when(total > 0, F.format_string(f"%.{digits}f%%", n * 100.0 / total))


def inverse_or_nan(v: Column) -> Column:
    """1/v; NaN unless v is above zero (Spark holds NaN > 0 to be true, so NaN is asked for first)."""
    nan = F.lit(float("nan"))
    return F.when(F.isnan(v) | (v <= 0), nan).otherwise(1 / v)
