"""The annotation of the analysis: given features, and clusters where nothing is annotated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligaquery.operators import overlaps
from ligaquery.operators.periods import periods_and_gaps
from ligaquery.session import cut, release, settle


def with_clusters(features: DataFrame, clusters: DataFrame, min_splits: int = 2) -> DataFrame:
    """(feature, seqid, strand, feat_strt, feat_end, is_cluster) from (feature, seqid, strand, feat_strt, feat_end) and ``clustering.cluster_pairs``.

    Both sides of a cluster of at least ``min_splits`` count. A side that overlaps features, on either strand, widens
    those of its own strand to its bounds; one that overlaps none is a new feature. New features that overlap on one
    strand are one. Sides are held against the features as given, so the order of clusters doesn't matter.
    """
    side = lambda s: F.struct(*(F.col(f"{s}_{c}").alias(f"c_{c}") for c in ("ref", "strand", "strt", "end")))
    sides = settle(clusters.where(F.col("no_splits") >= min_splits).select(F.inline(F.array(side("fst"), side("sec")))).distinct())
    release(sides.sparkSession)
    placed = sides.select(F.col("c_ref").alias("ref"), F.col("c_strand").alias("strand"), F.col("c_strt").alias("strt"), F.col("c_end").alias("stop"))
    spans = features.select("feature", F.col("seqid").alias("ref"), "strand", F.col("feat_strt").alias("strt"), F.col("feat_end").alias("stop"))
    # neither lists the pairs, which grow as sides times features
    wide = overlaps.bounds_met(spans, placed).groupBy(F.col("feature").alias("f_")).agg(F.min("strt").alias("w_strt"), F.max("stop").alias("w_end"))
    met = overlaps.counted(placed.select(F.lit(0).alias("seg_no"), F.lit(0).alias("sample_idx"), "*"), spans)
    bounds = [F.least("feat_strt", "w_strt").alias("feat_strt"), F.greatest("feat_end", "w_end").alias("feat_end")]
    given = features.join(wide, F.col("feature") == F.col("f_"), "left").select("feature", "seqid", "strand", *bounds, F.lit(False).alias("is_cluster"))
    keys = ["c_ref", "c_strand", "c_strt", "c_end"]
    free = sides.join(met.select(*(F.col(c).alias(k) for k, c in zip(keys, ("ref", "strand", "strt", "stop")))), keys, "left_anti")
    # doubled, so that neighbours that only touch stay apart
    runs = periods_and_gaps(free.select("c_ref", "c_strand", (F.col("c_strt") * 2).alias("s2"), (F.col("c_end") * 2).alias("e2")), ("c_ref", "c_strand"), "s2", "e2").where("kind = 'period'")
    new = runs.select(F.col("c_ref").alias("seqid"), F.col("c_strand").alias("strand"), F.expr("strt div 2").alias("feat_strt"), F.expr("stop div 2").alias("feat_end"))
    name = F.concat(F.lit("cluster:"), "seqid", F.lit(":"), "strand", F.lit(":"), "feat_strt", F.lit("-"), "feat_end")
    return given.unionByName(new.select(name.alias("feature"), "*", F.lit(True).alias("is_cluster")))


def carried_genes(features: DataFrame) -> DataFrame:
    """(feat_no, gene_no): exons inside the gene open at their line, in feat_no order.

    ``features`` are (feat_no, feat_type, seqid, feat_strt, feat_end, has_parent). A feature without a parent opens
    a gene, which stays open until the next one; an exon with a parent belongs to it if it lies
    inside it on the same sequence. The lines are range-partitioned; the gene open at the end of
    each partition, one row a partition, is carried into the next ones.
    """
    gene = F.when(~F.col("has_parent"), F.struct(F.col("feat_no").alias("no"), F.col("seqid").alias("seq"), F.col("feat_strt").alias("strt"), F.col("feat_end").alias("stop")))
    rows = cut(features.repartitionByRange("feat_no").withColumn("pid", F.spark_partition_id()).withColumn("gene", gene))
    ends = rows.where("gene IS NOT NULL").groupBy(F.col("pid").alias("p_")).agg(F.max_by("gene", "feat_no").alias("end_"))
    ends = rows.select(F.col("pid").alias("q_")).distinct().join(ends, F.col("q_") == F.col("p_"), "left")
    before = ends.select("q_", F.last("end_", ignorenulls=True).over(Window.orderBy("q_").rowsBetween(Window.unboundedPreceding, -1)).alias("came"))  # one row a partition
    here = F.last("gene", ignorenulls=True).over(Window.partitionBy("pid").orderBy("feat_no").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("here", here).join(F.broadcast(before), F.col("pid") == F.col("q_")).withColumn("g", F.coalesce("here", "came"))
    inside = (F.col("g.seq") == F.col("seqid")) & (F.col("feat_strt") >= F.col("g.strt")) & (F.col("feat_end") <= F.col("g.stop"))
    return met.where("feat_type = 'exon' AND has_parent").where(inside).select("feat_no", F.col("g.no").alias("gene_no"))
