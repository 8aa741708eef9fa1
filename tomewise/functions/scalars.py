"""Cleaning, labelling and numeric column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def upper_trim(value: Column | str) -> Column:
    """Upper-case text without surrounding blanks; null stays null."""
    return F.trim(F.upper(value))


def in_domain_or(value: Column | str, domain: Iterable[str], fallback: Column) -> Column:
    """Keep a value of the domain; anything else, null included, becomes the fallback."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(column.isin(*domain), column).otherwise(fallback)


def group_label(group_cols: Sequence[str]) -> Column:
    """Blank-separated label, null when any part is null (hence not concat_ws)."""
    parts: list[Column] = []
    for name in group_cols:
        parts += [F.lit(" "), F.col(name)] if parts else [F.col(name)]
    return F.concat(*parts)


def percent_text(share: Column | str) -> Column:
    """Share as text with two decimals, such as 12.50%."""
    return F.format_string("%.2f%%", F.round(F.lit(100.0) * F.col(share), 2))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null on a zero divisor instead of raising under ANSI rules."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def dot(left: Column | str, right: Column | str) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


EULER_GAMMA = 0.5772156649015329
HARMONIC_TABLE_SIZE = 40


def harmonic(n: Column | str) -> Column:
    """Harmonic number H(n): table for small n, else the asymptotic series (error below 1e-15)."""
    n = F.col(n) if isinstance(n, str) else n
    table, total = [0.0], 0.0
    for k in range(1, HARMONIC_TABLE_SIZE + 1):
        total += 1.0 / k
        table.append(total)
    x = n.cast("double")
    series = (
        F.log(x) + EULER_GAMMA + 0.5 / x - 1.0 / (12.0 * x * x)
        + 1.0 / (120.0 * F.pow(x, F.lit(4.0))) - 1.0 / (252.0 * F.pow(x, F.lit(6.0)))
    )
    known = F.array(*[F.lit(v) for v in table])
    return F.when(n <= HARMONIC_TABLE_SIZE, F.get(known, n.cast("int"))).otherwise(series)
