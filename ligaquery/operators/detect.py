"""Detection of split reads: segments of records, pairs of segments, routes of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligaquery.functions import cigar
from ligaquery.params import Params
from ligaquery.session import settle

NEAR, BIN = 5, 1024


def passes(p: Params) -> Column:
    """Mapped, and above the limits of mapping quality and read length."""
    return (F.col("flag").bitwiseAND(4) == 0) & (F.col("mapq") > p.mapq) & (cigar.read_span(F.col("cigar")) > p.minlen)


def usable(records: DataFrame, p: Params = Params()) -> DataFrame:
    """Mapped records with a read name that pass the record filter.

    With ``xj`` (number of pieces of the read's alignment), a read ends at its first record, in
    rec_no order, with fewer than two pieces; the records before it stay.
    """
    ok = records.where(passes(p)).where("qname IS NOT NULL AND pos IS NOT NULL AND refid IS NOT NULL")
    if "xj" not in records.columns:
        return ok
    stop = ok.where("xj < 2").groupBy(F.col("sample_idx").alias("s_"), F.col("qname").alias("q_")).agg(F.min("rec_no").alias("stop_"))
    same = F.col("sample_idx").eqNullSafe(F.col("s_")) & (F.col("qname") == F.col("q_"))
    return ok.join(stop, same, "left").where("stop_ IS NULL OR rec_no < stop_").drop("s_", "q_", "stop_")


def _pieces(records: DataFrame) -> DataFrame:
    return records.select("rec_no", "refid", F.inline(cigar.segments(F.col("cigar"), F.col("pos"), 1, True)))


def _annotated(raw: DataFrame, introns: DataFrame) -> DataFrame:
    after = raw.select(F.col("rec_no").alias("n_rec"), (F.col("seg_no") - 1).alias("n_seg"), F.col("strt").alias("n_strt"))
    gaps = raw.join(after, (F.col("rec_no") == F.col("n_rec")) & (F.col("seg_no") == F.col("n_seg"))).select("rec_no", "refid", "seg_no", (F.col("stop") + 1).alias("e_end"), F.col("n_strt").alias("e_strt"))
    gaps = gaps.withColumn("bin", F.explode(F.array_distinct(F.array(*(F.floor((F.col("e_end") + d) / BIN) for d in (-NEAR, NEAR))))))
    known = introns.select(F.col("refid").alias("i_ref"), (F.col("strt") - 1).alias("i_end"), (F.col("stop") + 1).alias("i_strt")).withColumn("i_bin", F.floor(F.col("i_end") / BIN))
    near = (F.abs(F.col("e_end") - F.col("i_end")) <= NEAR) & (F.abs(F.col("e_strt") - F.col("i_strt")) <= NEAR)
    return gaps.join(known, (F.col("refid") == F.col("i_ref")) & (F.col("bin") == F.col("i_bin")) & near, "left_semi").select("rec_no", "seg_no").distinct()


def annotated_gaps(records: DataFrame, introns: DataFrame, p: Params = Params()) -> DataFrame:
    """(rec_no, seg_no): the skipped regions of usable records, by the segment before, that are annotated introns.

    ``introns`` are (refid, strt, stop), closed; a skipped region is annotated if the last position before
    it and the first behind it lie within NEAR of those of an intron.
    """
    return _annotated(_pieces(usable(records, p).where(F.col("cigar").contains("N"))), introns)


def segments(records: DataFrame, introns: DataFrame, min_length: int = 15) -> DataFrame:
    """(rec_no, seg_no, strt, stop, read_from, read_to): parts between skipped regions that are no annotated intron.

    Soft clips belong to no segment.
    """
    cols, skips = ["rec_no", "seg_no", "strt", "stop", "read_from", "read_to"], F.col("cigar").contains("N")
    whole = _pieces(records.where(~skips)).select(*cols)
    raw = _pieces(records.where(skips))
    # a record holds as many as its CIGAR has operations
    kept = _annotated(raw, introns).groupBy(F.col("rec_no").alias("k_")).agg(F.collect_set("seg_no").alias("joined"))
    before = F.size(F.filter(F.coalesce("joined", F.array().cast("array<int>")), lambda k: k < F.col("seg_no")))
    parts = raw.join(kept, F.col("rec_no") == F.col("k_"), "left").withColumn("part", F.col("seg_no") - before)
    split = parts.groupBy("rec_no", F.col("part").alias("seg_no")).agg(*(f(c).alias(c) for f, c in ((F.min, "strt"), (F.max, "stop"), (F.min, "read_from"), (F.max, "read_to"))))
    return whole.unionByName(split).where(F.col("read_to") - F.col("read_from") + 1 >= min_length)


def segment_records(records: DataFrame, segs: DataFrame) -> DataFrame:
    """The segments of ``segments`` as records: (rec_no, seg_no, qname, flag, refid, pos, seq, qual, tags).

    Of the flag only the reverse strand stays; ``seq`` and ``qual`` of ``records`` are cut to the
    segment's read range; the tags XX, XY and XN are its begin and end in the read and the number of
    segments of the record. Mapping quality and other tags are left out.
    """
    n = segs.groupBy(F.col("rec_no").alias("k_")).agg(F.count(F.lit(1)).alias("n_"))
    both = segs.join(n, F.col("rec_no") == F.col("k_")).join(records.select(F.col("rec_no").alias("r_"), "qname", "flag", "refid", "seq", "qual"), F.col("rec_no") == F.col("r_"))
    part = lambda c: F.substr(c, F.col("read_from"), F.col("read_to") - F.col("read_from") + 1).alias(c)
    tags = F.create_map(*(x for t, c in (("XX", "read_from"), ("XY", "read_to"), ("XN", "n_")) for x in (F.lit(t), F.col(c).cast("string"))))
    return both.select("rec_no", "seg_no", "qname", F.col("flag").bitwiseAND(16).alias("flag"), "refid", F.col("strt").alias("pos"), part("seq"), part("qual"), tags.alias("tags"))


def pairs(records: DataFrame, introns: DataFrame, p: Params = Params()) -> DataFrame:
    """All pairs i < j of the segments of a record whose read ranges do not overlap: (sample_idx, qname, rec_no, refid, a_*, b_*)."""
    ok = settle(usable(records, p).where(F.col("cigar").contains("N")).select("sample_idx", "qname", "rec_no", "refid", "pos", "cigar"))  # others have one segment
    segs = segments(ok, introns, p.minlen)
    cols = ["seg_no", "strt", "stop", "read_from", "read_to"]
    side = lambda s: segs.select(F.col("rec_no").alias(f"{s}_rec"), *(F.col(c).alias(f"{s}_{c}") for c in cols))
    met = side("a").join(side("b"), (F.col("a_rec") == F.col("b_rec")) & (F.col("a_seg_no") < F.col("b_seg_no")))
    met = met.where("NOT (b_read_from <= a_read_to OR (a_read_from >= b_read_from AND a_read_from <= b_read_to))")
    return ok.select("sample_idx", "qname", "rec_no", "refid").join(met, F.col("rec_no") == F.col("a_rec")).drop("a_rec", "b_rec")


def routes(records: DataFrame, found: DataFrame, p: Params = Params()) -> DataFrame:
    """(sample_idx, qname, n_pairs, route): splits (one pair), multsplits (several), else single if a usable record has ``xj`` < 2, else none."""
    n = found.groupBy(F.col("sample_idx").alias("s_"), F.col("qname").alias("q_")).agg(F.count(F.lit(1)).alias("n"))
    single = F.coalesce(F.col("xj") < 2, F.lit(False)) if "xj" in records.columns else F.lit(False)
    per = records.where("qname IS NOT NULL").groupBy("sample_idx", "qname").agg(F.coalesce(F.bool_or(single & passes(p)), F.lit(False)).alias("single"))
    per = per.join(n, F.col("sample_idx").eqNullSafe(F.col("s_")) & (F.col("qname") == F.col("q_")), "left").withColumn("n_pairs", F.coalesce("n", F.lit(0)))
    route = F.when(F.col("n_pairs") > 1, "multsplits").when(F.col("n_pairs") == 1, "splits").when(F.col("single"), "single").otherwise("none")
    return per.select("sample_idx", "qname", "n_pairs", route.alias("route"))
