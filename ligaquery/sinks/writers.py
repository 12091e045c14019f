"""Writers of the workflow's results. Each writes a folder of part files, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(value: Column, digits: int = 6) -> Column:
    """A number without trailing zeros; null is ``.``"""
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNull(), ".").otherwise(text)


def significant(value: Column) -> Column:
    """A number with six significant digits as a C++ stream writes it: no trailing zeros, an exponent below 1e-4 and from 1e6 on; null is ``.``"""
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    v = value.cast("double")
    parts = F.split(F.format_string("%.5e", v), "e")
    power = F.get(parts, F.lit(1)).try_cast("int")
    plain = F.coalesce(*(F.when(power == p, strip(F.format_string(f"%.{5 - p}f", v))) for p in range(-4, 6)))
    text = F.coalesce(plain, F.concat(strip(F.get(parts, F.lit(0))), F.lit("e"), F.get(parts, F.lit(1))))
    return F.when(value.isNull(), ".").when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(text)


def write_fastq(reads: DataFrame, path: str, route: str | None = None) -> None:
    """Reads (read_id, seq, qual) as FASTQ text, one subfolder per ``route``."""
    text = F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "qual")
    out = reads.select(*([route] if route else []), text.alias("value"))
    (out.write.partitionBy(route) if route else out.write).mode("overwrite").text(path)


def write_sam(records: DataFrame, path: str, route: str | None = None) -> None:
    """Records with 0-based positions as SAM text lines, tags as strings."""
    c = lambda n, d: F.coalesce(F.col(n).cast("string"), F.lit(d))
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"])), "\t")
    fixed = F.concat_ws("\t", "qname", c("flag", "0"), c("rname", "*"), F.coalesce((F.col("pos") + 1).cast("string"), F.lit("0")), c("mapq", "0"), c("cigar", "*"), F.lit("*"), F.lit("0"), F.lit("0"), c("seq", "*"), c("qual", "*"))
    line = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.concat_ws("\t", fixed, tags)).otherwise(fixed)
    out = records.select(*([route] if route else []), line.alias("value"))
    (out.write.partitionBy(route) if route else out.write).mode("overwrite").text(path)


def numbered_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters with ``clust_id`` cluster1, cluster2, ... in order of position.

    Numbers come from a range partitioning: each partition is numbered on its own and moved on by
    the counts of those before it.
    """
    order = ["fst_ref", "fst_strt", "sec_ref", "sec_strt", "fst_strand", "sec_strand", "fst_end", "sec_end"]
    from ligaquery.session import cut

    rows = cut(clusters.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    n = rows.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))  # one row a partition
    before = n.select("__pid", "first", F.coalesce(F.sum("n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    no = F.col("__id") - F.col("first") + F.col("off") + 1
    return rows.join(F.broadcast(before), "__pid").select(F.concat(F.lit("cluster"), no).alias("clust_id"), *clusters.columns)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; nulls are ``.``, doubles have six digits."""
    cols = [number(F.col(c)).alias(c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_allints(wide: DataFrame, path: str) -> None:
    """``interactions.wide_allints`` as tab-separated text with a header, in its order; doubles have six significant digits."""
    cols = [significant(F.col(c)).alias(c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c, t in wide.dtypes]
    wide.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The interaction graph as JSON lines under nodes/ and edges/; all values are strings."""
    nodes.select("node_id", "label", F.struct("orientation").alias("metadata")).write.mode("overwrite").json(f"{path}/nodes")
    edges.select("source", "target", "relation").write.mode("overwrite").json(f"{path}/edges")


def write_stats(stats: DataFrame, path: str) -> None:
    """Run statistics: condition, the replicate in three digits, and the counters."""
    counters = [c for c in ("reads", "aligned", "splits", "multsplits", "interactions") if c in stats.columns]
    label = F.split("label", "_")
    write_table(stats.select(F.concat_ws("_", "grp", F.array_join(F.slice(label, 1, F.size(label) - 1), "_")).alias("condition"), F.element_at(label, -1).alias("replicate"), *counters), path)


def pair_records(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b: structs of a record) as records, two rows a pair: ``pair_no`` holds them together, ``side`` orders them."""
    both = F.array(*(F.struct(F.lit(k).alias("side"), F.col(s).alias("r")) for k, s in enumerate("ab")))
    return pairs.withColumn("pair_no", F.monotonically_increasing_id()).select("pair_no", F.inline(both)).select("pair_no", "side", "r.*")
