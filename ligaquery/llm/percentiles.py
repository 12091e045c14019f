"""Percentiles of very large numeric columns per group by exact bisection.

Every (group, value) is counted first, per part (a day, a sample, a delivery). These counts add up,
so results of parts are combined by summing them. Each wanted rank then holds an interval of values,
at first the group's minimum and maximum. A pass splits the intervals at ``SPLITS - 1`` midpoints,
counts the rows below each, and keeps the piece with the rank, drawn in to the values present in
it. It ends when an interval is one value, or is no wider than twice the allowed error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligaquery.session import cut, lookup, settle

SPLITS = 16
INF = float("inf")


def value_counts(df: DataFrame, group: list[str], values: list[str], part: list[str] | None = None) -> DataFrame:
    """(part, group, measure, v, n): how often each value occurs; null and NaN do not count.

    Partial aggregation runs before the shuffle, and the shuffle goes by group and value, so a
    group of any size is spread.
    """
    keys = [*(part or []), *group]
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in values))))
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + 0.0)  # -0.0 is 0.0
    return long.groupBy(*keys, "measure", "v").agg(F.count(F.lit(1)).alias("n"))


def combined(counts: DataFrame, group: list[str]) -> DataFrame:
    """Counts of several parts as counts of all."""
    return counts.groupBy(*group, "measure", "v").agg(F.sum("n").alias("n"))


def _targets(totals: DataFrame, probs: list[float]) -> DataFrame:
    """The two ranks (from 1) whose values each percentile lies between, and its place between them."""
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    want = F.array(*(F.struct(F.lit(float(p)).alias("p"), (F.floor(a) + 1).alias("r0"), (F.ceil(a) + 1).alias("r1"), (a - F.floor(a)).alias("frac")) for p, a in zip(probs, at, strict=True)))
    return totals.select("*", F.inline(want))


def _width(a: Column, b: Column) -> Column:
    return b / 2 - a / 2


def percentiles(counts: DataFrame, group: list[str], probs: list[float], max_error: float = 0.0) -> DataFrame:
    """(group, measure, p, n, value) from ``value_counts`` without a part or ``combined`` ones.

    A percentile lies at (n - 1) * p between neighbouring ranks, linearly interpolated, so 0.5 is
    the median. With ``max_error`` 0 it is exact; else each rank's value is off by at most
    ``max_error``. Null groups are groups; a group without values has no row; empty tables give none.
    """
    key = F.struct(*group, "measure")
    data = cut(counts.select(key.alias("k"), "v", "n"))
    finite = F.when(F.abs("v") < INF, F.col("v"))
    at = lambda x: F.coalesce(F.sum(F.when(F.col("v") == x, F.col("n"))), F.lit(0))
    totals = data.groupBy("k").agg(F.sum("n").alias("total"), at(-INF).alias("low"), at(INF).alias("high"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    wanted = settle(_targets(totals, probs))
    ranks = wanted.select("k", "total", "low", "high", "lo", "hi", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("rank")).distinct()
    bound = F.when(F.col("rank") <= F.col("low"), -INF).when(F.col("rank") > F.col("total") - F.col("high"), INF)
    edge = settle(ranks.withColumn("value", bound))
    done: list[DataFrame] = [edge.where("value IS NOT NULL").select("k", "rank", "value")]
    state = settle(edge.where("value IS NULL").select("k", "rank", (F.col("rank") - F.col("low")).alias("left"), "lo", "hi"))
    wide = _width(F.col("lo"), F.col("hi")) > (max_error if max_error > 0 else 0.0)
    wide = wide & (F.col("lo") < F.col("hi"))
    while True:
        done.append(state.where(~wide).select("k", "rank", (F.col("lo") + _width(F.col("lo"), F.col("hi"))).alias("value")))
        state = state.where(wide)
        spans = state.select(F.col("k").alias("sk"), "lo", "hi").distinct()
        if spans.isEmpty():
            break
        inside = lookup(data, spans, F.col("k").eqNullSafe(F.col("sk")) & F.col("v").between(F.col("lo"), F.col("hi")))
        piece = F.least(F.floor(F.try_divide(_width(F.col("lo"), F.col("v")), _width(F.col("lo"), F.col("hi"))) * SPLITS), F.lit(SPLITS - 1))
        hist = inside.groupBy("sk", "lo", "hi", piece.alias("piece")).agg(F.sum("n").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        below = Window.partitionBy("sk", "lo", "hi").orderBy("piece")
        hist = hist.withColumn("upto", F.sum("m").over(below)).select("sk", F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "m", "a", "b", "upto")
        same = F.col("k").eqNullSafe(F.col("sk")) & (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_"))
        met = state.join(hist, same & (F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("m")))
        state = settle(met.select("k", "rank", (F.col("left") - F.col("upto") + F.col("m")).alias("left"), F.col("a").alias("lo"), F.col("b").alias("hi")))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.select(F.col("k").alias("fk"), "rank", "value")
    low, high = (found.select(F.col("fk").alias(f"k{i}"), F.col("rank").alias(f"q{i}"), F.col("value").alias(f"v{i}")) for i in (0, 1))
    both = wanted.join(low, F.col("k").eqNullSafe(F.col("k0")) & (F.col("r0") == F.col("q0"))).join(high, F.col("k").eqNullSafe(F.col("k1")) & (F.col("r1") == F.col("q1")))
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") * (1 - F.col("frac")) + F.col("v1") * F.col("frac"))
    return both.select("k.*", "p", F.col("total").alias("n"), value.alias("value"))
