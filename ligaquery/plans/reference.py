
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligaquery.functions import cigar, seq
from ligaquery.operators import annotation, clustering, detect, interactions as ia, overlaps, packed, preproc
from ligaquery.operators.intervals import interval_join
from ligaquery.params import Params
from ligaquery.session import lookup, release, settle, small, table

READ_LENGTH, ADAPTER = 150, "AGATCGG"
PARAMS = Params()


def _strand(flag: str):
    return F.when(F.col(flag).bitwiseAND(16) != 0, "-").otherwise("+")


# ---- reads: whole texts of documents, letters mapped to bases, cut into consecutive reads ----


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    bases = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    docs = table(spark, sf_dir, "documents").select("doc_id", bases.alias("s")).where("s <> ''")
    n = F.ceil(F.length("s") / READ_LENGTH).cast("int")
    cell = lambda k: F.struct(k.alias("read_no"), F.substring("s", k * READ_LENGTH + 1, F.lit(READ_LENGTH)).alias("seq"))
    cut = docs.select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), n - 1), cell)))
    mark = lambda i: F.char((33 + (F.col("doc_id") * 7 + i * 3 + F.floor(i * i / 50)) % 41).cast("int"))
    qual = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), mark), "")
    return cut.select("*", F.explode(F.array(qual)).alias("qual"))


def pred1_read_filter(spark, sf_dir):
    p = preproc.TrimParams.of(PARAMS)
    return reads(spark, sf_dir).where(preproc.passes(p)).select("doc_id", "read_no", seq.mean_phred(F.col("qual")).alias("mean_q"))


def f1_reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("doc_id", "read_no", seq.reverse_complement(F.col("seq")).alias("rc"))


def t4_adapter_offsets(spark, sf_dir):
    at = seq.adapter_offset(F.col("seq"), ADAPTER, 0.15)
    return reads(spark, sf_dir).select("doc_id", "read_no", at.alias("at")).where("at IS NOT NULL")


def t5_trimmed_reads(spark, sf_dir):
    p = preproc.TrimParams.of(replace(PARAMS, mmrate=0.15), {"short": ADAPTER})
    return preproc.trimmed(reads(spark, sf_dir), p).where(preproc.passes(p)).select("doc_id", "read_no", "seq", F.length("qual").alias("n"))


def t9_window_trim(spark, sf_dir):
    return reads(spark, sf_dir).select("doc_id", "read_no", seq.window_trim(F.col("qual"), 25, 3).alias("stop"))


def f12_merged_mates(spark, sf_dir):
    """Neighbouring reads of a document as mates: equi-join on the pair number."""
    r = reads(spark, sf_dir).withColumn("pair_no", F.floor(F.col("read_no") / 2))
    a = r.where("read_no % 2 = 0").select("doc_id", "pair_no", F.col("seq").alias("seq_1"), F.col("qual").alias("qual_1"))
    b = r.where("read_no % 2 = 1").select("doc_id", "pair_no", F.col("seq").alias("seq_2"), F.col("qual").alias("qual_2"))
    out = preproc.merged(a.join(b, ["doc_id", "pair_no"]), preproc.TrimParams.of(replace(PARAMS, quality=15)))
    return out.select("doc_id", "pair_no", "route", "seq")


# ---- records ----


def records(spark, sf_dir):
    return table(spark, sf_dir, "split_records")


def pred4_record_filter(spark, sf_dir):
    return records(spark, sf_dir).select("rec_no", "flag", "mapq", "cigar").where(detect.passes(PARAMS)).select("rec_no", _strand("flag").alias("strand"))


def d4_cigar_spans(spark, sf_dir):
    c = F.col("cigar")
    return records(spark, sf_dir).select("rec_no", cigar.read_span(c).alias("read_span"), cigar.ref_span(c).alias("ref_span"), F.size(cigar.ops(c)).alias("n_ops"))


def f10_segments(spark, sf_dir):
    s = records(spark, sf_dir).select("rec_no", F.inline(cigar.segments(F.col("cigar"), F.col("pos"), PARAMS.minlen, True)))
    return s.select("rec_no", "seg_no", "strt", "stop", "read_from", "read_to")


def a2_sample_counters(spark, sf_dir):
    """Per sample: reads, records, reads with one pair (splits) and with several (multsplits)."""
    per = records(spark, sf_dir).groupBy("sample_idx", "qname").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.floor(F.col("n") / 2)
    return per.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("records"), F.count_if(pairs == 1).alias("splits"), F.count_if(pairs > 1).alias("multsplits"))


def k8_stats(spark, sf_dir):
    s = ia.replicate_labels(table(spark, sf_dir, "samples")).select("sample_idx", "grp", "label")
    return s.join(a2_sample_counters(spark, sf_dir), "sample_idx", "left").fillna(0, ["reads", "records", "splits", "multsplits"])


def a17_replicates(spark, sf_dir):
    return ia.replicate_labels(table(spark, sf_dir, "samples")).select("sample_idx", "grp", "cond_name", "replicate_no", "label")


def _pairs(spark, sf_dir):
    r = records(spark, sf_dir).select("sample_idx", "qname", "rec_no", "refid", "flag", "pos", "mapq", "cigar", "xc", "xe")
    return ia.record_pairs(r, ["refid", "flag", "pos", "mapq", "cigar", "xc", "xe"])


def j7_record_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("sample_idx", "qname", "pair_no", "a_rec_no", "b_rec_no")


def pred8_distinct_segments(spark, sf_dir):
    """Pairs whose two records do not overlap on the same reference."""
    p = _pairs(spark, sf_dir).where("a_refid IS NOT NULL AND b_refid IS NOT NULL AND a_pos IS NOT NULL AND b_pos IS NOT NULL")
    end = lambda s: F.col(f"{s}_pos") + cigar.ref_span(F.col(f"{s}_cigar")) - 1
    meets = (F.col("a_refid") == F.col("b_refid")) & (F.col("a_pos") <= end("b")) & (F.col("b_pos") <= end("a"))
    return p.where(~meets).select("a_rec_no", "b_rec_no")


# ---- features ----


def _features(spark, sf_dir):
    return table(spark, sf_dir, "features").where("feat_type IS NULL OR feat_type <> 'region'")


def f6_feature_names(spark, sf_dir):
    """ID, name, biotype and product of each feature, from the first value of its keys."""
    keys = ["id", "gene_name", "name", "gene_biotype", "gene_type", "product"]
    first = lambda k: F.get(F.filter("vals", lambda v: v["attr_key"] == k), F.lit(0))["val"]
    rows = packed.packed_values(_features(spark, sf_dir).select("feat_no", "attributes"), "attributes", keys)
    return rows.select("feat_no", first("id").alias("id"), F.coalesce(first("gene_name"), first("name")).alias("name"), F.coalesce(first("gene_biotype"), first("gene_type")).alias("biotype"), first("product").alias("product"))


def _exons(spark, sf_dir):
    rows = packed.packed_values(_features(spark, sf_dir).where("feat_type = 'exon' AND feat_strt <= feat_end").select("feat_no", "seqid", "feat_strt", "feat_end", "attributes"), "attributes", ["parent"])
    return rows.select("seqid", F.explode(F.transform("vals", lambda v: v["val"])).alias("transcript"), "feat_strt", "feat_end").distinct()


def w7_introns(spark, sf_dir):
    """Gaps between neighbouring exons of a transcript."""
    w = Window.partitionBy("seqid", "transcript").orderBy("feat_strt", "feat_end")
    nxt = _exons(spark, sf_dir).withColumn("next_strt", F.lead("feat_strt").over(w))
    return nxt.where("next_strt > feat_end + 1").select("seqid", "transcript", (F.col("feat_end") + 1).alias("strt"), (F.col("next_strt") - 1).alias("stop"))


def a16_junctions(spark, sf_dir):
    """The exons of each transcript in order."""
    exons = _exons(spark, sf_dir).groupBy("seqid", "transcript").agg(F.sort_array(F.collect_list(F.struct("feat_strt", "feat_end"))).alias("exons"))
    return exons.select("seqid", "transcript", F.size("exons").alias("n_exons"), F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["feat_strt"], e["feat_end"])), ",").alias("exons"))


# ---- detection: the given records, and spliced ones put together from them and from the features ----

FLANK, STRETCH = 30, 60


def _introns(spark, sf_dir):
    names = small(table(spark, sf_dir, "contigs").select("refid", F.col("refname").alias("seqid")))
    return w7_introns(spark, sf_dir).join(names, "seqid").select("refid", "transcript", "strt", "stop")


def detection_records(spark, sf_dir):
    """Records with ``rec_no`` as text and ``xj``, the number of pieces of the read's alignment.

    No given CIGAR skips a region, so spliced records are built from the given rows: two placed records of a
    pair on one reference as one record with the gap skipped (p), and over each annotated intron a read
    that skips it (i), one that skips 60 positions more (x), and one that does both (c).
    """
    r = records(spark, sf_dir).select("rec_no", "sample_idx", "qname", "flag", "refid", "pos", "mapq", "cigar")
    own = F.count(F.lit(1)).over(Window.partitionBy("sample_idx", "qname")).cast("int")  # the records of one read
    given = r.where("qname IS NOT NULL").withColumn("xj", own).withColumn("rec_no", F.concat(F.lit("r"), "rec_no"))
    end = lambda s: F.col(f"{s}.pos") + cigar.ref_span(F.col(f"{s}.cigar"))
    side = lambda s: F.struct(F.col(f"{s}_pos").alias("pos"), F.col(f"{s}_cigar").alias("cigar"), F.col(f"{s}_rec_no").alias("rec_no"))
    p = _pairs(spark, sf_dir).where("a_refid = b_refid").select("*", F.least(side("a"), side("b")).alias("lo"), F.greatest(side("a"), side("b")).alias("hi"))
    p = p.where((cigar.ref_span(F.col("lo.cigar")) > 0) & (cigar.ref_span(F.col("hi.cigar")) > 0) & (F.col("hi.pos") > end("lo")))
    joined = p.select(F.concat(F.lit("p"), "a_rec_no").alias("rec_no"), "sample_idx", F.concat(F.lit("p:"), "qname", F.lit(":"), "pair_no").alias("qname"), F.col("a_flag").alias("flag"), F.col("a_refid").alias("refid"),
        F.col("lo.pos").alias("pos"), F.least("a_mapq", "b_mapq").alias("mapq"), F.concat("lo.cigar", F.col("hi.pos") - end("lo"), F.lit("N"), "hi.cigar").alias("cigar"), F.lit(2).alias("xj"))
    skip, flank = F.col("stop") - F.col("strt") + 1, F.lit(f"{FLANK}M")
    wide = F.concat(skip + STRETCH, F.lit("N"), flank)
    shapes = (("i", F.concat(flank, skip, F.lit("N"), flank)), ("x", F.concat(flank, wide)), ("c", F.concat(flank, skip, F.lit("N"), flank, wide)))
    reads_ = _introns(spark, sf_dir).select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("cigar")) for k, c in shapes))))
    name = F.concat("k", "refid", F.lit(":"), "transcript", F.lit(":"), "strt")
    over = reads_.select(name.alias("rec_no"), F.lit(0).alias("sample_idx"), name.alias("qname"), F.lit(0).alias("flag"), "refid", (F.col("strt") - 1 - FLANK).cast("bigint").alias("pos"), F.lit(60).alias("mapq"), "cigar", F.when(F.col("k") == "c", 3).otherwise(2).alias("xj"))
    return given.unionByName(joined).unionByName(over)


def f10_spliced_segments(spark, sf_dir):
    """Segments of all usable records, kept together at annotated introns."""
    return detect.segments(detect.usable(detection_records(spark, sf_dir), PARAMS), _introns(spark, sf_dir), PARAMS.minlen)


def j4_spliced_pairs(spark, sf_dir):
    """Skipped regions of the usable records that are annotated introns, within 5 positions at both ends."""
    return detect.annotated_gaps(detection_records(spark, sf_dir), _introns(spark, sf_dir))


def j2_segment_pairs(spark, sf_dir):
    """All pairs of segments of one record, kept together at annotated introns, whose read ranges do not overlap."""
    return detect.pairs(detection_records(spark, sf_dir), _introns(spark, sf_dir))


def pred6_detected_routes(spark, sf_dir):
    """Where each read goes: by its pairs of j2_segment_pairs, else single if a usable record has one piece."""
    r = detection_records(spark, sf_dir)
    return detect.routes(r, detect.pairs(r, _introns(spark, sf_dir)))


def _placed(spark, sf_dir):
    names = small(table(spark, sf_dir, "contigs").select("refid", "refname"))
    return table(spark, sf_dir, "segments").select("seg_no", "sample_idx", "refid", "flag", "seg_strt", "seg_end").join(names, "refid")


def _given(spark, sf_dir):
    return _features(spark, sf_dir).select("feat_no", "seqid", F.col("strand").alias("f_strand"), F.col("feat_strt").cast("bigint").alias("feat_strt"), F.col("feat_end").cast("bigint").alias("feat_end"))


def _overlaps(spark, sf_dir, feats=None):
    met = interval_join(_placed(spark, sf_dir), _given(spark, sf_dir) if feats is None else feats, [("refname", "seqid")], ("seg_strt", "seg_end"), ("feat_strt", "feat_end"))
    return met.withColumn("orientation", F.when(_strand("flag") == F.col("f_strand"), "sense").otherwise("antisense"))


def _bounds(spark, sf_dir, feats, feature):
    """The tables of ``overlaps``."""
    segs = _placed(spark, sf_dir).select("seg_no", "sample_idx", F.col("refname").alias("ref"), _strand("flag").alias("strand"), F.col("seg_strt").alias("strt"), F.col("seg_end").alias("stop"))
    return segs, feats.select(F.col(feature).alias("feature"), F.col("seqid").alias("ref"), F.col("f_strand").alias("strand"), F.col("feat_strt").alias("strt"), F.col("feat_end").alias("stop"))


def j3_overlaps(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("seg_no", "feat_no", "orientation")


def a4_feature_frequency(spark, sf_dir):
    """Per sample, orientation and feature: each segment gives 1 in all to the features it overlaps."""
    return _frequency(spark, sf_dir, _given(spark, sf_dir), "feat_no")


def _frequency(spark, sf_dir, feats, feature):
    f = overlaps.shares(*_bounds(spark, sf_dir, feats, feature), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return f.select("sample_idx", F.when(F.col("is_sense"), "sense").otherwise("antisense").alias("orientation"), F.col("feature").alias(feature), (F.floor(F.col("f") * 1e6 + 0.5) / 1e6).alias("f"))


def pred20_resolved_segments(spark, sf_dir):
    """The only sense feature of each segment, else its only antisense one."""
    return _resolved(spark, sf_dir, _given(spark, sf_dir), "feat_no")


def _resolved(spark, sf_dir, feats, feature):
    met = overlaps.counted(*_bounds(spark, sf_dir, feats, feature), names=True)
    per = met.groupBy("seg_no").agg(F.sum("s").alias("s"), F.sum("a").alias("a"), F.max("sense").alias("sf"), F.max("anti").alias("af"))
    return per.where("s = 1 OR a = 1").select("seg_no", F.when(F.col("s") == 1, F.col("sf")).otherwise(F.col("af")).alias(feature), F.when(F.col("s") == 1, "sense").otherwise("antisense").alias("orientation"))


def j5_unannotated(spark, sf_dir):
    """Placed segments that overlap no feature."""
    names = small(table(spark, sf_dir, "contigs").select("refid"))
    placed = table(spark, sf_dir, "segments").where("seg_strt <= seg_end").join(names, "refid")
    hit = _overlaps(spark, sf_dir).select(F.col("seg_no").alias("h")).distinct()
    return placed.join(hit, F.col("seg_no") == F.col("h"), "left_anti").select("seg_no")


# ---- clusters ----


def a9_clusters(spark, sf_dir):
    """Clusters of the placed record pairs."""
    side = lambda s: [F.col(f"{s}_refid").alias(f"{s}_ref"), _strand(f"{s}_flag").alias(f"{s}_strand"), F.col(f"{s}_pos").alias(f"{s}_strt"), (F.col(f"{s}_pos") + cigar.ref_span(F.col(f"{s}_cigar")) - 1).alias(f"{s}_end")]
    return clustering.cluster_pairs(_pairs(spark, sf_dir).select(*side("a"), *side("b")), PARAMS.clustdist)


# ---- features and unannotated clusters ----


def u2_annotation(spark, sf_dir):
    """Features, widened by clusters of their strand, and the clusters that meet none as new features."""
    names = table(spark, sf_dir, "contigs").select("refid", "refname")
    name = lambda s: small(names.select(F.col("refid").alias(f"{s}_ref"), F.col("refname").alias(f"{s}_name")))
    c = a9_clusters(spark, sf_dir).join(name("fst"), "fst_ref").join(name("sec"), "sec_ref")
    c = c.withColumns({"fst_ref": F.col("fst_name"), "sec_ref": F.col("sec_name")})
    feats = _features(spark, sf_dir).select(F.col("feat_no").cast("string").alias("feature"), "seqid", "strand", F.col("feat_strt").cast("bigint").alias("feat_strt"), F.col("feat_end").cast("bigint").alias("feat_end"))
    return annotation.with_clusters(feats, c)


def _annotated(spark, sf_dir):
    annotated = settle(u2_annotation(spark, sf_dir)).withColumnRenamed("strand", "f_strand")
    release(spark)
    return annotated


def j5_overlaps(spark, sf_dir):
    """j3_overlaps over u2_annotation."""
    met = overlaps.listed(*_bounds(spark, sf_dir, _annotated(spark, sf_dir), "feature"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    release(spark)
    return met.select("seg_no", "feature", F.when(F.col("is_sense"), "sense").otherwise("antisense").alias("orientation"))


def j5_feature_frequency(spark, sf_dir):
    """a4_feature_frequency over u2_annotation."""
    return _frequency(spark, sf_dir, _annotated(spark, sf_dir), "feature")


def j5_resolved_segments(spark, sf_dir):
    """pred20_resolved_segments over u2_annotation."""
    return _resolved(spark, sf_dir, _annotated(spark, sf_dir), "feature")


# ---- interactions ----


def _interactions(spark, sf_dir):
    p = settle(ia.partners(table(spark, sf_dir, "int_partners")))  # distinct once, read by each use
    scores = records(spark, sf_dir).select("sample_idx", "qname", "rec_no", "xc", "xe")
    return ia.interactions(ia.record_pairs(scores, ["xc", "xe"]), ia.resolve(p)), p


def a5_frequencies(spark, sf_dir):
    f = ia.frequencies(ia.partners(table(spark, sf_dir, "int_partners")))
    return f.select("sample_idx", "orientation", "partner", F.round("f", 6).alias("f"), F.round("share", 9).alias("share"))


def f22_interactions(spark, sf_dir):
    found, _ = _interactions(spark, sf_dir)
    return found.select("sample_idx", "qname", "pair_no", *ia.KEY)


def _tested(spark, sf_dir):
    found, p = _interactions(spark, sf_dir)
    n = records(spark, sf_dir).select("sample_idx", "qname").distinct().groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n_reads"))
    return ia.p_values(ia.support(found), ia.frequencies(p), n)


def a6_support(spark, sf_dir):
    s = ia.support(_interactions(spark, sf_dir)[0])
    return s.withColumns({"gcs": F.round("gcs", 6), "ghs": F.round("ghs", 6)})


def f19_p_values(spark, sf_dir):
    return _tested(spark, sf_dir).select(*ia.KEY, "sample_idx", "supp_reads", F.round("pval", 8).alias("pval"))


def a14_combined_p(spark, sf_dir):
    c = ia.combined_p(_tested(spark, sf_dir), table(spark, sf_dir, "samples"))
    return c.withColumn("padj", F.round("padj", 8))


def k6_condition_counts(spark, sf_dir):
    """Support per key and condition, and the number of replicates that show it."""
    s = table(spark, sf_dir, "samples").select("sample_idx", "grp", "cond_name")
    t = ia.support(_interactions(spark, sf_dir)[0]).join(s, "sample_idx")
    return t.groupBy(*ia.KEY, "grp", "cond_name").agg(F.sum("supp_reads").alias("supp_reads"), F.count(F.lit(1)).alias("replicates"))


def k5_allints(spark, sf_dir):
    """Per key and replicate: support, scores and p-value, with the combined p-value at the last replicate of each condition."""
    tested, samples = settle(_tested(spark, sf_dir)), table(spark, sf_dir, "samples")
    out = ia.allints(tested, ia.combined_p(tested, samples), samples)
    return out.withColumns({"gcs": F.round("gcs", 6), "ghs": F.round("ghs", 6), "pval": F.round("pval", 8), "padj": F.round("padj", 8)})


def k6_replicate_counts(spark, sf_dir):
    """Support per key, written as one id, and replicate."""
    named = ia.replicate_labels(table(spark, sf_dir, "samples")).select(F.col("sample_idx").alias("s_"), "grp", "label")
    rows = lookup(ia.support(_interactions(spark, sf_dir)[0]), named, F.col("sample_idx") == F.col("s_"))
    return rows.select(F.concat_ws("_", "fst_rna", "sec_rna", "fst_ori", "sec_ori").alias("id"), "grp", "label", "sample_idx", "supp_reads")


def k8_run_stats(spark, sf_dir):
    """Per sample: reads, aligned (one usable record), splits, multsplits, and interactions with support."""
    ok = detect.passes(PARAMS) & F.col("pos").isNotNull() & F.col("refid").isNotNull()
    per = records(spark, sf_dir).where("qname IS NOT NULL").groupBy("sample_idx", "qname").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("u"))
    n = per.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.expr("n = 1 AND u = 1")).alias("aligned"), F.count_if(F.expr("n div 2 = 1")).alias("splits"), F.count_if(F.expr("n div 2 > 1")).alias("multsplits"))
    found = _interactions(spark, sf_dir)[0].select("sample_idx", *ia.KEY).distinct().groupBy("sample_idx").agg(F.count(F.lit(1)).alias("interactions"))
    s = ia.replicate_labels(table(spark, sf_dir, "samples")).select("sample_idx", "grp", "label")
    return s.join(n, "sample_idx", "left").join(found, "sample_idx", "left").fillna(0, ["reads", "aligned", "splits", "multsplits", "interactions"])


def k4_interactions(spark, sf_dir):
    """One row per record pair with a partner on both sides, with the annotation of the first feature of that name."""
    names = small(table(spark, sf_dir, "contigs").select("refid", "refname"))
    p = _pairs(spark, sf_dir).where("a_pos IS NOT NULL AND b_pos IS NOT NULL")
    for s in "ab":
        end = F.col(f"{s}_pos") + cigar.read_span(F.col(f"{s}_cigar"))
        p = p.join(names.withColumnsRenamed({"refid": f"{s}_refid", "refname": f"{s}_ref"}), f"{s}_refid").withColumns({f"{s}_strand": _strand(f"{s}_flag"), f"{s}_strt": F.col(f"{s}_pos"), f"{s}_end": end})
    feats = f6_feature_names(spark, sf_dir).where("name IS NOT NULL").join(_features(spark, sf_dir).select("feat_no", "strand"), "feat_no")
    first = feats.groupBy("name").agg(F.min_by(F.struct("biotype", "strand", "product"), "feat_no").alias("f"))
    anno = first.select("name", "f.biotype", F.col("f.strand").alias("anno_strand"), "f.product")
    return ia.split_table(p, ia.resolve(ia.partners(table(spark, sf_dir, "int_partners"))), anno)


def j11_exon_genes(spark, sf_dir):
    """Exons inside the gene that is open at their line."""
    rows = packed.packed_values(_features(spark, sf_dir).select("feat_no", "feat_type", "seqid", "feat_strt", "feat_end", "attributes"), "attributes", ["parent"])
    return annotation.carried_genes(rows.select("feat_no", "feat_type", "seqid", "feat_strt", "feat_end", (F.size("vals") > 0).alias("has_parent")))


def k7_graph_nodes(spark, sf_dir):
    return ia.graph(_interactions(spark, sf_dir)[0])[0]


def k7_graph_edges(spark, sf_dir):
    return ia.graph(_interactions(spark, sf_dir)[0])[1]


def pred11_routes(spark, sf_dir):
    """Where each read goes: single (no pair), splits (one) or multsplits (several)."""
    per = records(spark, sf_dir).where("qname IS NOT NULL").groupBy("sample_idx", "qname").agg(F.floor(F.count(F.lit(1)) / 2).alias("n_pairs"))
    return per.select("sample_idx", "qname", "n_pairs", F.when(F.col("n_pairs") == 0, "single").when(F.col("n_pairs") == 1, "splits").otherwise("multsplits").alias("route"))


QUERIES = (
    pred1_read_filter, f1_reverse_complement, t4_adapter_offsets, t5_trimmed_reads, t9_window_trim, f12_merged_mates, pred4_record_filter, d4_cigar_spans, f10_segments,
    a2_sample_counters, k8_stats, a17_replicates, j7_record_pairs, pred8_distinct_segments, f6_feature_names, w7_introns, a16_junctions, f10_spliced_segments, j4_spliced_pairs, j2_segment_pairs, pred6_detected_routes, j3_overlaps,
    a4_feature_frequency, pred20_resolved_segments, j5_unannotated, a9_clusters, u2_annotation, j5_overlaps, j5_feature_frequency, j5_resolved_segments, a5_frequencies, f22_interactions, a6_support, f19_p_values, a14_combined_p,
    k4_interactions, k5_allints, k6_condition_counts, k6_replicate_counts, k8_run_stats, j11_exon_genes, k7_graph_nodes, k7_graph_edges, pred11_routes,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from ligaquery.plans import reference_sql

    return reference_sql.oracle_sql()
