"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(c: Column) -> Column:
    """Six decimals by plain double arithmetic, the same on every engine."""
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def clogc(counts: Column) -> Column:
    """Sum of c*log2(c) over an array of counts (doubles)."""
    return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n * F.log2(n))


def singles(counts: Column) -> Column:
    """How many counts are exactly one."""
    return F.size(F.filter(counts, lambda n: n == 1.0))


def entropy_bits(weighted: Column, total: Column) -> Column:
    """Shannon entropy from clogc of counts that add up to total."""
    return F.when(
        total > 0, F.log2(total.cast("double")) - weighted / total
    ).otherwise(F.lit(0.0))


def population_std(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact integer sums."""
    spread = (n * squares - total * total).cast("double")
    return F.when(n > 0, F.sqrt(F.greatest(spread, F.lit(0.0))) / n).otherwise(F.lit(0.0))
