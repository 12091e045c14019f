"""Split reads to annotated interactions: resolve, count, score, test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ligaquery.functions import stats
from ligaquery.session import lookup

LOW_SUPPORT = 5


def record_pairs(records: DataFrame, carry: list[str]) -> DataFrame:
    """Two neighbouring records of a read as one row: sample_idx, qname, pair_no, a_*, b_*.

    Records are taken in rec_no order within (sample_idx, qname); an odd last one has no pair.
    """
    at = F.row_number().over(Window.partitionBy("sample_idx", "qname").orderBy("rec_no")) - 1
    cells = F.struct("rec_no", *carry)
    marked = records.where("qname IS NOT NULL").select("sample_idx", "qname", F.floor(at / 2).cast("int").alias("pair_no"), (at % 2).alias("side"), cells.alias("r"))
    both = marked.groupBy("sample_idx", "qname", "pair_no").agg(F.max(F.when(F.col("side") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("r"))).alias("b"))
    both = both.where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("sample_idx", "qname", "pair_no", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ["rec_no", *carry]))


def partners(df: DataFrame) -> DataFrame:
    """int_partners with spelling put right: distinct (rec_no, sample_idx, partner, orientation); unusable rows left out."""
    ori = F.regexp_replace(F.lower(F.trim("orientation")), "[^a-z]", "")
    ok = F.col("partner").isNotNull() & ~F.col("partner").isin("", ".") & ori.isin("sense", "antisense")
    return df.where(ok).select("rec_no", "sample_idx", "partner", ori.alias("orientation")).distinct()


def resolve(partner_rows: DataFrame) -> DataFrame:
    """(rec_no, partner, orientation): the only sense partner of a record, else its only antisense one; others drop out."""
    sense = F.col("orientation") == "sense"
    per = partner_rows.groupBy("rec_no").agg(
        F.count_if(sense).alias("n_sense"), F.count_if(~sense).alias("n_anti"), F.max(F.when(sense, F.col("partner"))).alias("s"), F.max(F.when(~sense, F.col("partner"))).alias("a")
    )
    take_s, take_a = F.col("n_sense") == 1, F.col("n_anti") == 1
    return per.where(take_s | take_a).select("rec_no", F.when(take_s, F.col("s")).otherwise(F.col("a")).alias("partner"), F.when(take_s, "sense").otherwise("antisense").alias("orientation"))


def interactions(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pairs with a partner on both sides and the key in canonical order: fst_rna, fst_ori, sec_rna, sec_ori."""
    a, b = (resolved.select(F.col("rec_no").alias(f"{s}_rec_no"), F.struct("partner", "orientation").alias(f"{s}_p")) for s in "ab")
    both = pairs.join(a, "a_rec_no").join(b, "b_rec_no")
    lo, hi = F.least("a_p", "b_p"), F.greatest("a_p", "b_p")
    return both.withColumns({"fst_rna": lo["partner"], "fst_ori": lo["orientation"], "sec_rna": hi["partner"], "sec_ori": hi["orientation"]}).drop("a_p", "b_p")


def frequencies(partner_rows: DataFrame) -> DataFrame:
    """(sample_idx, orientation, partner, f, share): each record gives 1 in all to its partners; share sums to 1 a sample."""
    n = F.count(F.lit(1)).over(Window.partitionBy("rec_no"))  # the partners of one record
    f = partner_rows.withColumn("n", n).groupBy("sample_idx", "orientation", "partner").agg(F.sum(1 / F.col("n")).alias("f"))
    total = f.groupBy(F.col("sample_idx").alias("s_")).agg(F.sum("f").alias("total"))
    return f.join(total, F.col("sample_idx") == F.col("s_")).select("sample_idx", "orientation", "partner", "f", (F.col("f") / F.col("total")).alias("share"))


KEY = ["fst_rna", "fst_ori", "sec_rna", "sec_ori"]


def support(found: DataFrame) -> DataFrame:
    """Per key and sample: supp_reads, gcs and ghs (from a_xc, a_xe; null, NaN and 1000 are no score).

    Values are counted first, so a hot key moves its distinct values only; the medians are read off
    their running counts, which are sorted on disk where they don't fit, and gathered nowhere.
    """
    keys = [*KEY, "sample_idx"]
    score = lambda c: F.when(~F.isnan(c) & (F.col(c) != 1000), F.col(c).cast("double"))
    rows = found.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("m"), score(f"a_{m}").alias("v")) for m in ("xc", "xe")))))
    counts = rows.groupBy(*keys, "m", "v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys, "m")
    k = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    # one partitioning serves the window and the groups
    ranked = counts.repartition(*keys).withColumns({"upto": F.sum(k).over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(k).over(own)})
    of = lambda m: F.when(F.col("m") == m, F.col("v"))
    at = lambda m, r: F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("n") < r), of(m)))
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    median = lambda m: ((at(m, low) + at(m, high)) / 2).alias(f"{m}_med")
    agg = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("m") == "xc", F.col("n"))).alias("supp_reads"), median("xc"), F.max(of("xc")).alias("c_max"), median("xe"), F.min(of("xe")).alias("e_min"))
    return agg.select(*keys, "supp_reads", stats.gcs(F.col("xc_med"), F.col("c_max")).alias("gcs"), stats.ghs(F.col("xe_med"), F.col("e_min")).alias("ghs"))


def p_values(supported: DataFrame, freq: DataFrame, reads: DataFrame) -> DataFrame:
    """``supported`` with pval: the binomial tail of the support under independent partners; 1 below LOW_SUPPORT.

    ``reads`` is (sample_idx, n_reads). A partner without frequency has probability 0.
    """
    f = lambda s: freq.select(F.col("sample_idx"), F.col("partner").alias(f"{s}_rna"), F.col("orientation").alias(f"{s}_ori"), F.col("share").alias(f"{s}_f"))
    rows = supported.join(f("fst"), ["sample_idx", "fst_rna", "fst_ori"], "left").join(f("sec"), ["sample_idx", "sec_rna", "sec_ori"], "left").join(reads, "sample_idx", "left")
    p = F.coalesce("fst_f", F.lit(0.0)) * F.coalesce("sec_f", F.lit(0.0))
    same = (F.col("fst_rna") == F.col("sec_rna")) & (F.col("fst_ori") == F.col("sec_ori"))
    tail = stats.binomial_tail(F.col("supp_reads"), F.col("n_reads"), F.when(same, p).otherwise(2 * p))
    pval = F.when(F.col("supp_reads") < LOW_SUPPORT, 1.0).otherwise(F.greatest(tail, F.lit(stats.FLOOR)))
    return rows.select(*supported.columns, pval.alias("pval"))


def combined_p(tested: DataFrame, samples: DataFrame) -> DataFrame:
    """Per key and condition (grp, cond_name): padj, Fisher's combination of the rank-adjusted p-values.

    m is the number of the condition's replicates; those without support have p = 1, which adds
    nothing to the statistic but counts in m. Conditions are spelled as given; null is one.
    """
    size = samples.groupBy("grp", "cond_name").agg(F.count(F.lit(1)).alias("m"))
    of = samples.select("sample_idx", "grp", "cond_name")
    s = of.join(size.select(F.col("grp").alias("g_"), F.col("cond_name").alias("c_"), "m"), F.col("grp").eqNullSafe(F.col("g_")) & F.col("cond_name").eqNullSafe(F.col("c_"))).drop("g_", "c_")
    rows = tested.join(s, "sample_idx")
    cond = [*KEY, "grp", "cond_name"]
    rank = F.row_number().over(Window.partitionBy(*cond).orderBy("pval", "sample_idx"))
    adj = F.least(F.lit(1.0), F.col("pval") * F.col("m") / rank)
    x = rows.withColumn("ln", F.log(adj)).groupBy(*cond, "m").agg(F.count(F.lit(1)).alias("n_supported"), (-2 * F.sum("ln")).alias("x"))
    return x.select(*cond, "n_supported", F.greatest(stats.chi2_tail_even(F.col("x"), F.col("m")), F.lit(stats.FLOOR)).alias("padj"))


def replicate_labels(samples: DataFrame) -> DataFrame:
    """samples with replicate_no (from 1 within grp and cond_name) and label ``<cond>_<3 digits>``."""
    no = F.row_number().over(Window.partitionBy("grp", "cond_name").orderBy("sample_idx"))
    return samples.withColumn("replicate_no", no).withColumn("label", F.concat_ws("_", F.coalesce("cond_name", F.lit("na")), F.lpad(no.cast("string"), 3, "0")))


def allints(tested: DataFrame, combined: DataFrame, samples: DataFrame) -> DataFrame:
    """Per key and replicate: supp_reads, gcs, ghs, pval, and padj at the last replicate of each condition with support.

    A last replicate without support of its own has 0 reads, no scores and p = 1. Other replicates
    without support have no row, so the result grows with the support, not with keys times samples.
    """
    named = replicate_labels(samples)
    size = named.groupBy(F.col("grp").alias("g_"), F.col("cond_name").alias("c_")).agg(F.max("replicate_no").alias("m_"))
    same = F.col("grp").eqNullSafe(F.col("g_")) & F.col("cond_name").eqNullSafe(F.col("c_"))
    last = named.join(size, same & (F.col("replicate_no") == F.col("m_"))).select("g_", "c_", F.col("sample_idx").alias("sample_idx"))
    padj = lookup(combined, last, same).select(*KEY, "sample_idx", "padj")
    rows = tested.join(padj, [*KEY, "sample_idx"], "full")
    rows = rows.withColumns({"supp_reads": F.coalesce("supp_reads", F.lit(0).cast("bigint")), "pval": F.coalesce("pval", F.lit(1.0))})
    cols = named.select(F.col("sample_idx").alias("s_"), "grp", "cond_name", "replicate_no", "label")
    return lookup(rows, cols, F.col("sample_idx") == F.col("s_")).select(*KEY, "grp", "cond_name", "replicate_no", "label", "supp_reads", "gcs", "ghs", "pval", "padj")


def wide_allints(long: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """``allints`` with the columns ``<grp>_<label>_<value>`` of each (grp, label), in key order; null where there is nothing."""
    cell = lambda g, x, v: F.max(F.when((F.col("grp") == g) & (F.col("label") == x), F.col(v))).alias(f"{g}_{x}_{v}")
    return long.groupBy(*KEY).agg(*(cell(g, x, v) for g, x in labels for v in ("supp_reads", "gcs", "ghs", "pval", "padj"))).orderBy(*KEY)


def split_table(pairs: DataFrame, resolved: DataFrame, annotation: DataFrame) -> DataFrame:
    """One row per pair with a partner on both sides: qname, nine columns a side, cmpl, the alignments, mfe and its structure.

    ``pairs`` are (qname, a_*, b_*) with ref, strand, strt, end and the scores a_xc, a_xe; ``annotation`` is
    (name, biotype, anno_strand, product), a name once. Partners without annotation have nulls. Alignments
    and structures that the pairs do not carry are ``.``
    """
    out = pairs
    for s, side in (("a", "fst"), ("b", "sec")):
        out = out.join(resolved.select(F.col("rec_no").alias(f"{s}_r"), F.col("partner").alias(f"{side}_name"), F.col("orientation").alias(f"{side}_ori")), F.col(f"{s}_rec_no") == F.col(f"{s}_r"))
        out = lookup(out, annotation.select(F.col("name").alias(f"{side}_n"), *(F.col(c).alias(f"{side}_{c}") for c in ("biotype", "anno_strand", "product"))), F.col(f"{side}_name") == F.col(f"{side}_n"), "left")
    cols = lambda s, side: [*(F.col(f"{s}_{c}").alias(f"{side}_{c}") for c in ("strand", "strt", "end", "ref")), *(f"{side}_{c}" for c in ("name", "biotype", "anno_strand", "product", "ori"))]
    dot = lambda c: F.lit(".").alias(c)
    return out.select("qname", *cols("a", "fst"), *cols("b", "sec"), F.col("a_xc").alias("cmpl"), dot("fst_aln"), dot("sec_aln"), F.col("a_xe").alias("mfe"), dot("mfe_struc"))


def wide_counts(tested: DataFrame, samples: DataFrame, value: str = "supp_reads") -> DataFrame:
    """One row per key, one column per replicate label; the labels are read first, one a sample."""
    named = replicate_labels(samples).select("sample_idx", F.concat_ws("_", "grp", "label").alias("label"))
    labels = sorted(r.label for r in named.select("label").collect())
    return tested.join(F.broadcast(named) if len(labels) <= 10_000 else named, "sample_idx").groupBy(*KEY).pivot("label", labels).agg(F.first(value)).fillna(0)


def graph(tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct (label, orientation) ends, and the distinct pairs of them."""
    node = lambda s: F.concat_ws("|", f"{s}_rna", f"{s}_ori")
    keys = tested.select(*KEY).distinct()
    ends = keys.select(F.col("fst_rna").alias("label"), F.col("fst_ori").alias("orientation")).union(keys.select("sec_rna", "sec_ori")).distinct()
    nodes = ends.select(F.concat_ws("|", "label", "orientation").alias("node_id"), "label", "orientation")
    return nodes, keys.select(node("fst").alias("source"), node("sec").alias("target"), F.lit("basepairing").alias("relation"))
