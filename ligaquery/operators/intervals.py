"""Interval joins as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 4096


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, slack: int = 0) -> Column:
    """Closed intervals that share a position, or come within ``slack`` of it."""
    return (a_start <= b_end + slack) & (b_start <= a_end + slack)


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l_iv: tuple[str, str], r_iv: tuple[str, str], bin_size: int = BIN, slack: int = 0) -> DataFrame:
    """Pairs of rows with equal ``on`` columns and overlapping closed intervals, each pair once.

    Both sides are cut into bins of ``bin_size`` positions, so a long or hot reference sequence
    spreads over many tasks; a pair is kept in the first bin that both share. Rows with a null key,
    start or end, or a start after the end, meet nothing. Column names must differ between sides.
    """
    def binned(df: DataFrame, iv: tuple[str, str], name: str, widen: int) -> DataFrame:
        s, e = F.col(iv[0]) - widen, F.col(iv[1]) + widen
        span = F.sequence(F.floor(s / bin_size), F.floor(e / bin_size))
        ok = df.where(F.col(iv[0]).isNotNull() & F.col(iv[1]).isNotNull() & (F.col(iv[0]) <= F.col(iv[1])))
        return ok.withColumn(name, F.explode(span))

    a, b = binned(left, l_iv, "__lb", slack), binned(right, r_iv, "__rb", 0)
    cond = F.col("__lb") == F.col("__rb")
    for x, y in on:
        cond = cond & (F.col(x) == F.col(y))
    meet = overlap(F.col(l_iv[0]), F.col(l_iv[1]), F.col(r_iv[0]), F.col(r_iv[1]), slack)
    first = F.col("__lb") == F.floor(F.greatest(F.col(l_iv[0]) - slack, F.col(r_iv[0])) / bin_size)
    return a.join(b, cond & meet & first).drop("__lb", "__rb")
