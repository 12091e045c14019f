"""Clusters of two-sided intervals: connected components of boxes that overlap on both sides.

Equal boxes are counted first, so copies are one vertex. Boxes meet through bins of the first
side; labels then spread over the links (hash-to-min) until nothing changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligaquery.operators.intervals import overlap
from ligaquery.session import release, settle

#: Side of the first cells, a power of 4, and boxes of a cell that are compared with each other.
CELL, PAIRED = 4096, 32


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex is linked with; ``links`` are (u, v).

    Each round gives every vertex the smallest of itself and its neighbours, then that one's own, and
    puts these in the place of the ends of the links. Links inside a group vanish, so the links
    shrink with each round and long chains halve. The rounds' steps are put together at the end.
    """
    ends = settle(links.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    release(ends.sparkSession)
    steps: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.select("u", "v").union(ends.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        step = settle(near.join(near.select(F.col("u").alias("w"), F.col("m").alias("to")), F.col("m") == F.col("w")).select("u", "to"))
        steps.append(step)
        left, right = step.select("u", F.col("to").alias("a")), step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        ends = settle(ends.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), ends)
        release(ends.sparkSession)
    labels = vertices.select("v", F.col("v").alias("root")).distinct()
    for step in steps:
        labels = labels.join(step, F.col("root") == F.col("u"), "left").select("v", F.coalesce("to", "root").alias("root"))
    return settle(labels, *steps)


def box_links(boxes: DataFrame) -> DataFrame:
    """(u, v): links that join the same boxes as all overlaps would; ``boxes`` are (v, lane, xs, xe, ys, ye), closed.

    Boxes meet in square cells of their lane. Where a box covers a cell, all boxes of the cell overlap it
    and are linked with it; where at most ``PAIRED`` boxes meet, they are compared; any other cell is
    cut into 16, down to single positions, which any box covers. So the links of a hot locus grow
    with its boxes, not with their pairs.
    """
    width = boxes.agg(F.max(F.greatest(F.col("xe") - F.col("xs"), F.col("ye") - F.col("ys")))).first()[0] or 0
    size = CELL
    while size < width:
        size *= 4
    span = lambda lo, hi, n: F.explode(F.sequence(F.floor(F.col(lo) / n), F.floor(F.col(hi) / n)))
    now = boxes.withColumn("i", span("xs", "xe", size)).withColumn("j", span("ys", "ye", size))
    cell, found = ["lane", "i", "j"], []
    while True:
        over = lambda c, lo, hi: (F.col(lo) <= F.col(c) * size) & (F.col(hi) >= (F.col(c) + 1) * size - 1)  # noqa: E731, B023
        per = now.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(over("i", "xs", "xe") & over("j", "ys", "ye"), F.col("v"))).alias("rep")).where("n > 1")
        met = settle(now.join(per, cell))
        release(met.sparkSession)
        found.append(met.where("v <> rep").select(F.col("v").alias("u"), F.col("rep").alias("v")))
        few = met.where(F.col("rep").isNull() & (F.col("n") <= PAIRED)).drop("n", "rep")
        other = few.select(*cell, F.col("v").alias("w"), *(F.col(c).alias(f"o{c}") for c in ("xs", "xe", "ys", "ye")))
        meets = overlap(F.col("xs"), F.col("xe"), F.col("oxs"), F.col("oxe")) & overlap(F.col("ys"), F.col("ye"), F.col("oys"), F.col("oye"))
        found.append(few.join(other, cell).where((F.col("v") < F.col("w")) & meets).select(F.col("v").alias("u"), F.col("w").alias("v")))
        rest = met.where(F.col("rep").isNull() & (F.col("n") > PAIRED)).drop("n", "rep")
        if rest.isEmpty():
            return reduce(DataFrame.union, found)
        size //= 4
        part = lambda c, lo, hi: F.explode(F.sequence(F.greatest(F.floor(F.col(lo) / size), F.col(c) * 4), F.least(F.floor(F.col(hi) / size), F.col(c) * 4 + 3)))  # noqa: E731, B023
        now = rest.withColumn("k", part("i", "xs", "xe")).withColumn("l", part("j", "ys", "ye")).drop("i", "j").withColumnsRenamed({"k": "i", "l": "j"})


def cluster_pairs(pairs: DataFrame, slack: int = 0) -> DataFrame:
    """Clusters of rows (a_ref, a_strand, a_strt, a_end, b_ref, b_strand, b_strt, b_end).

    Two rows belong together if reference and strand agree on both sides and both intervals
    overlap (within ``slack``), also through others. The side with the smaller (ref, strand, start)
    comes first. Result: the keys, the bounds of both sides, no_splits and the lengths. Rows with a
    null or a start after its end are left out.
    """
    cols = ["ref", "strand", "strt", "end"]
    a, b = (F.struct(*(F.col(f"{s}_{c}").alias(c) for c in cols)) for s in "ab")
    ok = pairs.where(" AND ".join(f"{s}_{c} IS NOT NULL" for s in "ab" for c in cols) + " AND a_strt <= a_end AND b_strt <= b_end")
    boxes = ok.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    boxes = settle(boxes.select("x", "y", "n", F.monotonically_increasing_id().alias("v")))
    release(boxes.sparkSession)
    lane = F.struct("x.ref", "x.strand", F.col("y.ref").alias("ref2"), F.col("y.strand").alias("strand2"))
    at = lambda c, more=0: (F.col(c).cast("bigint") + more)
    slim = boxes.select("v", lane.alias("lane"), at("x.strt").alias("xs"), at("x.end", slack).alias("xe"), at("y.strt").alias("ys"), at("y.end", slack).alias("ye"))
    roots = components(boxes.select("v"), box_links(slim))
    release(boxes.sparkSession)
    out = boxes.join(roots, "v").groupBy("root").agg(
        *(F.min(f"{i}.{c}").alias(f"{s}_{c}") for i, s in (("x", "fst"), ("y", "sec")) for c in ("ref", "strand", "strt")),
        *(F.max(f"{i}.end").alias(f"{s}_end") for i, s in (("x", "fst"), ("y", "sec"))),
        F.sum("n").alias("no_splits"),
    )
    length = lambda s: (F.col(f"{s}_end") - F.col(f"{s}_strt") + 1).alias(f"{s}_len")
    return out.select(*(f"{s}_{c}" for s in ("fst", "sec") for c in cols), "no_splits", length("fst"), length("sec"))
