"""Expressions and operators of the interaction workflow."""

import json
import math
import random
import struct
import time
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from ligaquery.functions import cigar, seq, stats
from ligaquery.operators import clustering, interactions, overlaps, preproc
from ligaquery.operators.intervals import interval_join
from ligaquery.params import load_params
from ligaquery.plans import reference


def one(spark, row, schema, col):
    return spark.createDataFrame([row], schema).select(col).first()[0]


def test_adapters(spark):
    a = seq.ADAPTERS["TruSeqRead1"]
    bad = a[:5] + ("A" if a[5] != "A" else "C") + a[6:]
    rows = [("TGTCCCCCC" + a + "TT",), ("TGTCCCCC" + bad,), ("AC" + a[:20],), ("",), (None,), ("G" * 300,)]
    df = spark.createDataFrame(rows, "s STRING")
    got = [tuple(r) for r in df.select(seq.adapter_offset(F.col("s"), a), seq.adapter_offset(F.col("s"), a, 0.1)).collect()]
    assert got == [(9, 9), (None, 8), (None, None), (None, None), (None, None), (None, None)]
    assert [r[0] for r in df.select(seq.trim_3(F.col("s"), seq.ADAPTERS, 0.1)).collect()] == [9, 8, 22, 0, None, 300]


def test_adapters_with_mismatches_random(spark):
    rng = random.Random(12)
    reads = ["".join(rng.choices("ACGT", k=rng.randint(0, 60))) for _ in range(120)]
    df = spark.createDataFrame([(r,) for r in reads], "s STRING")
    for a, rate in (("AGATCGG", 0.15), ("AGATCGGAA", 0.34)):
        k = int(len(a) * rate)
        for r, at in df.select("s", seq.adapter_offset(F.col("s"), a, rate)).collect():
            want = [o for o in range(len(r) - len(a) + 1) if sum(x != y for x, y in zip(r[o:], a, strict=False)) <= k]
            assert at == (want[0] if want else None)


def test_window_trim_and_quality(spark):
    rng = random.Random(4)
    quals = ["".join(chr(33 + rng.choice([2, 30])) for _ in range(rng.randint(0, 20))) for _ in range(60)]
    df = spark.createDataFrame([(q,) for q in quals], "q STRING")
    for q, end, mean in df.select("q", seq.window_trim(F.col("q"), 20, 3), seq.mean_phred(F.col("q"))).collect():
        nums, e = [ord(c) - 33 for c in q], len(q)
        while e >= 3 and sum(nums[e - 3 : e]) < 60:
            e -= 3
        assert end == e and mean == (sum(nums) // len(nums) if nums else 0)


def test_reverse_complement_and_cleaning(spark):
    row = spark.createDataFrame([("acGTnx-é",)], "s STRING").select(seq.clean(F.col("s")), seq.reverse_complement(F.lit("AACG")), seq.only_acgt(F.col("s")), seq.printable(F.col("s"))).first()
    assert tuple(row) == ("ACGTNNNN", "CGTT", "GT", "acGTnx-")


def test_merged_mates(spark):
    rng = random.Random(9)
    full = "".join(rng.choices("ACGT", k=80))
    rc = full[20:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("a", full[:60], "I" * 60, rc, "I" * 60), ("b", "A" * 40, "I" * 40, "A" * 40, "I" * 40), ("c", "A" * 40, "I" * 40, "A" * 5, "I" * 5), ("d", "A", "#", None, None), ("e", None, None, "C" * 30, "I" * 30)]
    df = spark.createDataFrame(rows, "read_id STRING, seq_1 STRING, qual_1 STRING, seq_2 STRING, qual_2 STRING")
    got = {r.read_id: r for r in preproc.merged(df, preproc.TrimParams()).collect()}
    assert got["a"].seq == full and got["a"].route == "merged" and len(got["a"].qual) == 80
    assert [got[k].route for k in "bcde"] == ["unmerged", "R1only", "dropped", "R2only"]
    a = ["".join(rng.choices("ACG", k=rng.randint(0, 12))) for _ in range(60)]
    b = ["".join(rng.choices("ACG", k=rng.randint(0, 12))) for _ in range(60)]
    for p, q, (i, j, n) in zip(a, b, preproc.common_runs(a, b).tolist(), strict=True):
        longest = max((k - h for h in range(len(p)) for k in range(h, len(p) + 1) if p[h:k] in q), default=0)
        assert n == longest and p[i : i + n] == q[j : j + n]


def test_cigar_segments(spark):
    c = F.col("c")
    df = spark.createDataFrame([("10M5N20M",), ("3S10=2D5X",), ("*",), (None,), ("5S4M",), ("3M2I4N1D6M2S",)], "c STRING")
    got = [[tuple(s) for s in r[0] or []] for r in df.select(cigar.segments(c, F.lit(100), 1)).collect()]
    assert got[0] == [(0, 100, 109, 1, 10), (1, 115, 134, 11, 30)]
    assert got[1] == [(0, 100, 116, 1, 18)] and got[2] == [] and got[3] == []
    assert got[5] == [(0, 100, 102, 1, 5), (1, 107, 113, 6, 13)]
    clipped = [[tuple(s) for s in r[0] or []] for r in df.select(cigar.segments(c, F.lit(100), 1, True)).collect()]
    assert clipped[4] == [(0, 100, 103, 6, 9)] and clipped[5] == [(0, 100, 102, 1, 5), (1, 107, 113, 6, 11)]
    spans = [tuple(r) for r in df.select(cigar.read_span(c), cigar.ref_span(c)).collect()]
    assert spans == [(30, 35), (18, 17), (0, 0), (None, None), (9, 4), (13, 14)]


def test_statistics(spark):
    def tail(x, n, p):
        return 1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))

    cases = [(5, 100, 0.01), (0, 10, 0.5), (9, 2000, 0.002), (10, 10, 0.5), (3, 10, 0.0), (3, 10, 1.0)]
    df = spark.createDataFrame(cases, "x INT, n INT, p DOUBLE")
    for (x, n, p), r in zip(cases, df.select(stats.binomial_tail(F.col("x"), F.col("n"), F.col("p"))).collect(), strict=True):
        assert abs(r[0] - (tail(x, n, p) if x < n else 0)) < 1e-9
    m, x = 3, 7.5
    want = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(m))
    assert abs(one(spark, (x, m), "x DOUBLE, m INT", stats.chi2_tail_even(F.col("x"), F.col("m"))) - want) < 1e-12
    assert one(spark, (-4.0, -9.0), "a DOUBLE, b DOUBLE", stats.ghs(F.col("a"), F.col("b"))) == -6.0
    assert one(spark, (4.0, -9.0), "a DOUBLE, b DOUBLE", stats.ghs(F.col("a"), F.col("b"))) == 6.0


def test_tail_of_large_support(spark):
    """The continued fraction against a sum of masses; also where a sum would have 10^7 terms."""
    import numpy as np

    cases = [(1500, 10_000, 0.14), (1500, 10_000, 0.16), (1001, 1002, 0.999), (1200, 5000, 0.2), (30_000, 1_000_000, 0.03), (10_000_000, 1_000_000_000, 0.01), (10_010_000, 1_000_000_000, 0.01)]

    def exact(x, n, p):
        sd = math.sqrt(n * p * (1 - p))
        k = np.arange(x + 1, min(n, int(max(x, n * p) + 40 * sd) + 2) + 1)
        steps = np.log((n - k[:-1]) / (k[:-1] + 1.0)) + math.log(p) - math.log1p(-p)
        first = math.lgamma(n + 1) - math.lgamma(x + 2) - math.lgamma(n - x) + (x + 1) * math.log(p) + (n - x - 1) * math.log1p(-p)
        return float(np.exp(first + np.concatenate(([0.0], np.cumsum(steps)))).sum())

    df = spark.createDataFrame(cases, "x BIGINT, n BIGINT, p DOUBLE")
    got = [r[0] for r in df.select(stats.binomial_tail(F.col("x"), F.col("n"), F.col("p"))).collect()]
    for c, g in zip(cases, got, strict=True):
        assert abs(g - exact(*c)) < 2e-5 * max(exact(*c), 1e-9), (c, g, exact(*c))


def test_stats_and_pairs_written(spark, tmp_path):
    from ligaquery.sinks.writers import pair_records, write_stats
    from ligaquery.sources.readers import read_stats

    df = spark.createDataFrame([(0, "ctrls", "c_1_001", 9, 1, 3, 2, None), (1, "ctrls", "c_1_002", 4, 0, 0, 0, 7)], "sample_idx INT, grp STRING, label STRING, reads BIGINT, aligned BIGINT, splits BIGINT, multsplits BIGINT, interactions BIGINT")
    write_stats(df, str(tmp_path / "stats"))
    assert sorted(map(tuple, read_stats(spark, str(tmp_path / "stats")).collect())) == [("ctrls_c_1", 1, 9, 1, 3, 2, 0), ("ctrls_c_1", 2, 4, 0, 0, 0, 7)]
    rec = "struct<qname:string,pos:bigint>"
    two = spark.createDataFrame([(("q", 1), ("q", 9)), (("r", 2), ("r", 3))], f"a {rec}, b {rec}")
    assert [(r.side, r.qname, r.pos) for r in pair_records(two).orderBy("pair_no", "side").collect()] == [(0, "q", 1), (1, "q", 9), (0, "r", 2), (1, "r", 3)]


def test_six_significant_digits(spark, tmp_path):
    from ligaquery.sinks.writers import significant, write_allints

    cases = {0.5: "0.5", 0.0: "0", 1.0: "1", -2.25: "-2.25", 123456.0: "123456", 1234567.0: "1.23457e+06", 0.0001: "0.0001", 0.00001: "1e-05", 1e-10: "1e-10", 0.714286123: "0.714286", 999999.7: "1e+06", 100.0: "100", None: "."}
    df = spark.createDataFrame([(k,) for k in cases], "v DOUBLE")
    assert [r[0] for r in df.select(significant(F.col("v"))).collect()] == list(cases.values())
    wide = spark.createDataFrame([("B", 1, 1e-10), ("A", None, 0.25)], "fst_rna STRING, n BIGINT, p DOUBLE").orderBy("fst_rna")
    write_allints(wide, str(tmp_path / "a"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "a"), sep="\t", header=True).collect())) == [("A", ".", "0.25"), ("B", "1", "1e-10")]


def test_segment_records(spark):
    from ligaquery.operators import detect

    df = spark.createDataFrame([(1, 0, "q", 17, 1, 100, 60, "4M10N3M", "ACGTTTG", "IIIIJJJ"), (2, 0, "n", 0, 1, 5, 60, "2M", None, None)], "rec_no BIGINT, sample_idx INT, qname STRING, flag INT, refid INT, pos BIGINT, mapq INT, cigar STRING, seq STRING, qual STRING")
    none = spark.createDataFrame([], "refid INT, strt BIGINT, stop BIGINT")
    rows = detect.segment_records(df, detect.segments(df, none, 1)).orderBy("rec_no", "seg_no").collect()
    assert [(r.flag, r.pos, r.seq, r.qual, r.tags) for r in rows[:2]] == [(16, 100, "ACGT", "IIII", {"XX": "1", "XY": "4", "XN": "2"}), (16, 114, "TTG", "JJJ", {"XX": "5", "XY": "7", "XN": "2"})]
    assert len(rows) == 3 and rows[2].seq is None


def test_exons_of_the_open_gene(spark):
    from ligaquery.operators.annotation import carried_genes

    rows = [(1, "exon", "A", 1, 5, True), (2, "gene", "A", 1, 100, False), (3, "exon", "A", 1, 100, True), (4, "exon", "A", 90, 101, True), (5, "exon", "B", 5, 6, True), (6, "mRNA", "A", 2, 9, True), (7, "exon", "A", 3, 4, False), (8, "exon", "A", 3, 4, True), (9, "exon", "A", None, 4, True)]
    df = spark.createDataFrame(rows, "feat_no BIGINT, feat_type STRING, seqid STRING, feat_strt INT, feat_end INT, has_parent BOOLEAN")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, carried_genes(df).collect())) == [(3, 2), (8, 7)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert carried_genes(df.limit(0)).count() == 0


def test_allints(spark):
    """Support by replicate; the combined p-value stands at the last replicate, also without support there."""
    s = spark.createDataFrame([(0, "g", "c"), (1, "g", "c"), (2, "g", None)], "sample_idx INT, grp STRING, cond_name STRING")
    t = spark.createDataFrame([("A", "sense", "B", "sense", 0, 7, 0.5, -2.0, 0.01), ("A", "sense", "B", "sense", 2, 1, None, None, 1.0)], "fst_rna STRING, fst_ori STRING, sec_rna STRING, sec_ori STRING, sample_idx INT, supp_reads BIGINT, gcs DOUBLE, ghs DOUBLE, pval DOUBLE")
    got = interactions.allints(t, interactions.combined_p(t, s), s)
    rows = {(r.label, r.supp_reads, r.gcs, r.pval, r.padj is None) for r in got.collect()}
    assert rows == {("c_001", 7, 0.5, 0.01, True), ("c_002", 0, None, 1.0, False), ("na_001", 1, None, 1.0, False)}
    wide = interactions.wide_allints(got, [("g", "c_001"), ("g", "c_002")]).first()
    assert wide.g_c_001_supp_reads == 7 and wide.g_c_002_pval == 1.0 and wide.g_c_001_padj is None


def test_interval_join(spark):
    rng = random.Random(6)
    iv = lambda n: [(i, rng.choice(["c", "d", None]), (a := rng.randint(0, 5000)), a + rng.randint(-2, 900)) for i in range(n)]
    left, right = [*iv(120), (999, "c", None, 4)], iv(90)
    a = spark.createDataFrame(left, "i INT, k STRING, s BIGINT, e BIGINT")
    b = spark.createDataFrame(right, "j INT, m STRING, t BIGINT, u BIGINT")
    for slack in (0, 7):
        got = sorted((r.i, r.j) for r in interval_join(a, b, [("k", "m")], ("s", "e"), ("t", "u"), 256, slack).collect())
        assert got == sorted((i, j) for i, k, s, e in left for j, m, t, u in right if k and k == m and s is not None and s <= e and t <= u and s <= u + slack and t <= e + slack)


def _overlap_tables(spark, segs, feats):
    return spark.createDataFrame(segs, "seg_no BIGINT, sample_idx INT, ref STRING, strand STRING, strt BIGINT, stop BIGINT"), spark.createDataFrame(feats, "feature STRING, ref STRING, strand STRING, strt BIGINT, stop BIGINT")


def _overlap_case(rng):
    """Segments and features of all lengths, with repeated numbers and names, nulls, odd strands and bounds, and the overlaps of them."""
    iv = lambda long: ((a := rng.randint(-300, 4000)), a + (rng.randint(0, 3000) if rng.random() < 0.1 else rng.randint(-2, long)))
    segs = [(rng.randint(0, 230), rng.choice([0, 1, 2, None]), rng.choice(["c", "d", None]), rng.choice("+-"), *iv(60)) for _ in range(250)]
    feats = [(f"f{rng.randint(0, 70)}", rng.choice(["c", "d", None]), rng.choice(["+", "-", ".", None]), *iv(200)) for _ in range(80)]
    segs.append((900, 1, "c", "+", None, 5))
    met = [(s, f) for s in segs for f in feats if s[2] and s[2] == f[1] and s[4] is not None and s[4] <= s[5] and f[3] <= f[4] and s[4] <= f[4] and f[3] <= s[5]]
    return segs, feats, met


def test_overlap_shares(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "CELL", 64)  # so that there are several levels of cells
    segs, feats, met = _overlap_case(random.Random(12))
    n, want = Counter(s[0] for s, _ in met), defaultdict(float)
    for s, f in met:
        want[s[1], s[3] == f[2], f[0]] += 1 / n[s[0]]
    got = [((r.sample_idx, r.is_sense, r.feature), r.f) for r in overlaps.shares(*_overlap_tables(spark, segs, feats), 4).collect()]
    assert len(got) == len(want) and all(math.isclose(v, want[k], rel_tol=1e-12) for k, v in got)
    once = [f for i, f in enumerate(feats) if f[0] not in {g[0] for g in feats[:i]}]  # no name twice: no shuffle of the result
    want = Counter((s[1], s[3] == f[2], f[0]) for s, f in met if f in once).keys()
    got = [(r.sample_idx, r.is_sense, r.feature) for r in overlaps.shares(*_overlap_tables(spark, segs, once), 4).collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert overlaps.shares(*(t.limit(0) for t in _overlap_tables(spark, segs, feats)), 4).count() == 0


def test_shares_of_a_hot_place(spark):
    """240 million overlaps, of which none is listed; as rows they took gigabytes of shuffle."""
    segs = spark.range(60_000).selectExpr("id AS seg_no", "int(id % 3) AS sample_idx", "'c' AS ref", "'+' AS strand", "id % 900 AS strt", "id % 900 + 5000 AS stop")
    feats = spark.range(4000).selectExpr("string(id) AS feature", "'c' AS ref", "IF(id % 2 = 0, '+', '.') AS strand", "1000 + id % 700 AS strt", "1900 + id AS stop")
    got = overlaps.shares(segs, feats, 4)
    assert "Join" not in got._jdf.queryExecution().toString()
    sums = got.groupBy("sample_idx", "is_sense").agg(F.count("*"), F.round(F.min("f"), 9), F.round(F.max("f"), 9)).collect()
    assert sorted(map(tuple, sums)) == [(k, sense, 2000, 5.0, 5.0) for k in range(3) for sense in (False, True)]


def test_shares_go_to_cells_in_use(spark, monkeypatch):
    """One long feature on c, so that there is a level more: it takes no rows of d, and none of other cells."""
    monkeypatch.setattr(overlaps, "CELL", 220)
    segs = [(2 * i + (r == "d"), 0, r, "+", 100 * i, 100 * i + 5) for i in range(60) for r in "cd"]
    segs, feats = _overlap_tables(spark, segs, [("a", "c", "+", 0, 200), ("b", "d", "+", 300, 400), ("z", "c", "-", 0, 1000)])
    near = lambda: overlaps._near_cells(segs, overlaps._one_cell(feats)).count()
    want = [(0, False, "z", 9.5), (0, True, "a", 1.5), (0, True, "b", 2.0)]
    assert near() == 5 + 4 + 36 and sorted(map(tuple, overlaps.shares(segs, feats, 4).collect())) == want
    monkeypatch.setattr(overlaps, "CELLS", 2)  # too many to be listed
    assert near() >= 120 * 2 * 2 and sorted(map(tuple, overlaps.shares(segs, feats, 4).collect())) == want


def test_shares_of_a_hot_cell(spark):
    """A cell with all features is no single task's work, and its rows are the same."""
    rng = random.Random(15)
    segs = [(i, rng.choice([None, *range(30)]), "c", rng.choice("+-"), (a := rng.randint(0, 9000)), a + 90) for i in range(900)]
    feats = [(f"f{i}", "c", rng.choice(["+", "-", ".", None]), (a := rng.randint(0, 9000)), a + 400) for i in range(120)]
    met = [(s, f) for s in segs for f in feats if s[4] <= f[4] and f[3] <= s[5]]
    n, want = Counter(s[0] for s, _ in met), defaultdict(float)
    for s, f in met:
        want[s[1], s[3] == f[2], f[0]] += 1 / n[s[0]]
    for tasks in (1, 12, 40):
        got = overlaps.shares(*_overlap_tables(spark, segs, feats), tasks).withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == len(want) and all(math.isclose(r.f, want[r.sample_idx, r.is_sense, r.feature], rel_tol=1e-12) for r in got)
        assert len({r.task for r in got}) >= min(5, tasks)


def test_counted_overlaps(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "CELL", 64)
    segs, feats, met = _overlap_case(random.Random(13))
    want = defaultdict(lambda: ([], []))
    for s, f in met:
        want[s][s[3] != f[2]].append(f[0])
    want = Counter((*s, len(a), len(b), a[0] if len(a) == 1 else None, b[0] if len(b) == 1 else None) for s, (a, b) in want.items())
    assert len({s for s, _ in met}) == sum(want.values()) and len(set(segs)) == len(segs)
    got = overlaps.counted(*_overlap_tables(spark, segs, feats), names=True)
    assert Counter(map(tuple, got.select("seg_no", "sample_idx", "ref", "strand", "strt", "stop", "s", "a", "sense", "anti").collect())) == want
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_listed_overlaps(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "CELL", 64)
    segs, feats, met = _overlap_case(random.Random(14))
    segs += [(s[0] + 1000, s[1], s[2], None, *s[4:]) for s in segs[:40]]  # no strand
    want = Counter((s[0], f[0], s[3] is not None and s[3] == f[2]) for s in segs for f in feats if s[2] and s[2] == f[1] and s[4] is not None and s[4] <= s[5] and f[3] <= f[4] and s[4] <= f[4] and f[3] <= s[5])
    for block, batch, tasks in ((64, 1 << 16, 1), (3, 40, 12)):
        monkeypatch.setattr(overlaps, "BLOCK", block)
        monkeypatch.setattr(overlaps, "BATCH", batch)
        assert Counter(map(tuple, overlaps.listed(*_overlap_tables(spark, segs, feats), tasks).collect())) == want
    assert overlaps.listed(*(t.limit(0) for t in _overlap_tables(spark, segs, feats)), 4).count() == 0


def test_j5_overlaps_of_a_hot_place(spark, monkeypatch, tmp_path):
    """Rows are written in an order that takes little disk (by a join 1.3 bytes each), and several tasks share the one place."""
    spark.createDataFrame([(0, "c")], "refid INT, refname STRING").write.parquet(f"{tmp_path}/contigs.parquet")
    segs = spark.range(30_000).selectExpr("id AS seg_no", "0 AS sample_idx", "0 AS refid", "int(id % 2) * 16 AS flag", "id * 7919 % 20011 AS seg_strt", "id * 7919 % 20011 + 60 + id % 7 AS seg_end")
    segs.write.parquet(f"{tmp_path}/segments.parquet")
    feats = spark.range(600).selectExpr("string(id) AS feature", "'c' AS seqid", "IF(id % 3 = 0, '+', '-') AS f_strand", "id * 104729 % 19001 AS feat_strt", "id * 104729 % 19001 + 2000 + id % 31 AS feat_end")
    monkeypatch.setattr(reference, "_annotated", lambda spark, sf_dir: feats)
    got = reference.j5_overlaps(spark, str(tmp_path))
    joined = segs.join(feats, F.expr("seg_strt <= feat_end AND feat_strt <= seg_end")).selectExpr("seg_no", "feature", "IF(IF(flag = 16, '-', '+') = f_strand, 'sense', 'antisense') AS orientation")
    got.write.parquet(f"{tmp_path}/got")
    read = spark.read.parquet(f"{tmp_path}/got")
    sums = lambda df: df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(k), "seg_no", "feature", "orientation") % 1_000_003) for k in range(3))).first()
    assert sums(read) == sums(joined) and read.count() > 1_500_000
    assert sum(f.stat().st_size for f in (tmp_path / "got").glob("*.parquet")) < read.count() / 2
    assert len(list((tmp_path / "got").glob("*.parquet"))) >= 4


def test_listed_rows_are_handed_on_in_small_groups():
    """Spark holds all that a row becomes before it writes the first of it; a block's overlaps were one row of 64 times all features."""
    segs, feats = [(i, i * 3, i * 3 + 50) for i in range(150)], [(f"f{j}", j % 7 - 5, 100 + j * 13 % 700) for j in range(3000)]
    cell = {"ref": pa.array(["c"]), "lvl": pa.array([0]), "cell": pa.array([0]), "part": pa.array([0])}
    at = lambda n, streamed: {k: v.take(pa.array([0] * n)) for k, v in cell.items()} | {"streamed": pa.array([streamed] * n), "strand": pa.array(["+"] * n)}
    held = pa.RecordBatch.from_pydict(at(len(feats), False) | {"feature": [f[0] for f in feats], "strt": [f[1] for f in feats], "stop": [f[2] for f in feats]})
    streamed = pa.RecordBatch.from_pydict(at(len(segs), True) | {"seg_no": [s[0] for s in segs], "strt": [s[1] for s in segs], "stop": [s[2] for s in segs]})
    rows = [r for b in overlaps._list()(iter([held, streamed])) for r in b.to_pylist()]
    assert Counter((s, f) for r in rows for s in r["segs"] for f in r["features"]) == Counter((s[0], f[0]) for s in segs for f in feats if s[1] <= f[2] and f[1] <= s[2])
    assert max(len(r["segs"]) * len(r["features"]) for r in rows) <= 4096


def test_listing_of_a_hot_cell_is_dealt_over_many_tasks(spark):
    """One cell with all rows went to 16 tasks at most, however many there were."""
    segs = spark.range(4000).selectExpr("id AS seg_no", "0 AS sample_idx", "'c' AS ref", "'+' AS strand", "id AS strt", "id + 50 AS stop")
    feats = spark.range(60).selectExpr("string(id) AS feature", "'c' AS ref", "'-' AS strand", "id * 50 AS strt", "id * 50 + 900 AS stop")
    per = [r["count"] for r in overlaps.listed(segs, feats, 96).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == segs.join(feats.selectExpr("strt AS a", "stop AS b"), F.expr("strt <= b AND a <= stop")).count()
    assert len(per) >= 32 and max(per) < sum(per) / 8


def test_clusters_leave_no_shuffle_files(spark):
    """Each step's are deleted while the next ones run, but for the last one's; they added up to four times the input."""
    rows = spark.range(3000).selectExpr("'A' AS a_ref", "'+' AS a_strand", "id * 31 % 9001 AS a_strt", "id * 31 % 9001 + 40 AS a_end", "'B' AS b_ref", "'-' AS b_strand", "id * 47 % 8009 AS b_strt", "id * 47 % 8009 + 40 AS b_end")
    files = lambda: {f.split("_")[1] for f in spark.sparkContext._jvm.SparkSession.active().sparkContext().env().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n") if f.startswith("shuffle")}
    before = files()
    got = clustering.cluster_pairs(rows)
    until = time.time() + 10
    while len(files() - before) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(files() - before) <= 1 and got.agg(F.sum("no_splits")).first()[0] == 3000


def test_clusters(spark):
    rng = random.Random(8)
    rows = [(rng.choice("AB"), "+", (a := rng.randint(0, 3000)), a + 40, "C", rng.choice("+-"), (b := rng.randint(0, 3000)), b + 40) for _ in range(150)]
    rows += rows[:10] + [(None, "+", 1, 2, "C", "+", 1, 2), ("A", "+", 9, 2, "C", "+", 1, 2)]
    df = spark.createDataFrame(rows, "a_ref STRING, a_strand STRING, a_strt BIGINT, a_end BIGINT, b_ref STRING, b_strand STRING, b_strt BIGINT, b_end BIGINT")
    ok = [sorted([(r[0], r[1], r[2], r[3]), (r[4], r[5], r[6], r[7])]) for r in rows if r[0] and r[2] <= r[3]]
    root = list(range(len(ok)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    hit = lambda p, q: p[:2] == q[:2] and p[2] <= q[3] and q[2] <= p[3]
    for i in range(len(ok)):
        for j in range(i):
            if hit(ok[i][0], ok[j][0]) and hit(ok[i][1], ok[j][1]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ok)):
        groups[find(i)].append(ok[i])
    want = Counter((g[0][0][0], g[0][0][1], min(x[0][2] for x in g), max(x[0][3] for x in g), min(x[1][2] for x in g), max(x[1][3] for x in g), len(g)) for g in groups.values())
    got = Counter((r.fst_ref, r.fst_strand, r.fst_strt, r.fst_end, r.sec_strt, r.sec_end, r.no_splits) for r in clustering.cluster_pairs(df).collect())
    assert got == want


def test_hot_locus(spark):
    """Many distinct boxes at one locus give as many links as boxes in cells, not as pairs; the groups are those of all pairs."""
    rng = random.Random(12)
    boxes, v = [], 0
    for k in range(1500):
        x, y = (rng.randint(0, 400), rng.randint(0, 400)) if k % 3 else (rng.randint(3000, 60_000), rng.randint(-9000, 9000))
        boxes.append((k, 1 + (k % 50 == 0), x, x + rng.randint(3, 40), y, y + rng.randint(3, 40)))
    boxes.append((1500, 1, -70_000, 70_000, 200, 205))
    df = spark.createDataFrame(boxes, "v BIGINT, lane INT, xs BIGINT, xe BIGINT, ys BIGINT, ye BIGINT")
    links = clustering.box_links(df).collect()
    root = list(range(len(boxes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = lambda: Counter(frozenset(g) for g in _grouped(find, len(boxes)).values())
    for r in links:
        root[find(r.u)] = find(r.v)
    got, n_pairs = groups(), 0
    root[:] = range(len(boxes))
    for a in boxes:
        for b in boxes[: a[0]]:
            if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]:
                n_pairs += 1
                root[find(a[0])] = find(b[0])
    assert got == groups()
    hot = spark.createDataFrame([(k, 1, k % 40, k % 40 + 90, k // 40, k // 40 + 90) for k in range(1600)], df.schema)
    assert clustering.box_links(hot).count() < 20 * 1600  # of 1,279,200 pairs


def _grouped(find, n):
    out = defaultdict(set)
    for i in range(n):
        out[find(i)].add(i)
    return out


def test_detect(spark):
    """Three segments give three pairs; an annotated intron joins two; a record with one piece ends its read."""
    from ligaquery.operators import detect

    a, b = "AGGGGTCTTTCCGTCTTGCCGCGGGTACACTGCATCTTCACAGCGAGTTCAA", "TTCGATCAAGAAGAAC"
    rows = [
        (1, 0, "three", 0, 1, 100, 60, "20M50N20M70N5S20M", 3, "A" * 65), (2, 0, "spliced", 0, 1, 500, 60, "20M102N20M60N20M", 3, "A" * 60), (3, 0, "stops", 0, 1, 100, 60, "20M50N20M", 2, "A" * 40), (4, 0, "stops", 0, 1, 100, 60, "40M", 1, "A" * 40),
        (5, 0, "stops", 0, 1, 100, 60, "20M50N20M", 2, "A" * 40), (6, 0, "one", 0, 1, 100, 60, "40M", 1, "A" * 40), (7, 0, "short", 0, 1, 100, 60, "20M50N14M", 2, "A" * 34), (8, 0, "low", 0, 1, 100, 3, "20M50N20M", 2, "A" * 40), (9, 0, None, 0, 1, 100, 60, "20M50N20M", 2, "A" * 40),
        (10, 0, "golden", 0, 1, 100, 60, f"{len(a)}M50N{len(b)}M", 2, a + b),
    ]
    df = spark.createDataFrame(rows, "rec_no BIGINT, sample_idx INT, qname STRING, flag INT, refid INT, pos BIGINT, mapq INT, cigar STRING, xj INT, seq STRING")
    introns = spark.createDataFrame([(1, 523, 620), (2, 120, 169)], "refid INT, strt BIGINT, stop BIGINT")
    found = detect.pairs(df, introns)
    got = Counter((r.qname, r.rec_no, r.a_strt, r.a_stop, r.b_read_from, r.b_read_to) for r in found.collect())
    assert got == Counter([("three", 1, 100, 119, 21, 40), ("three", 1, 100, 119, 46, 65), ("three", 1, 170, 189, 46, 65), ("spliced", 2, 500, 641, 41, 60), ("stops", 3, 100, 119, 21, 40), ("golden", 10, 100, 99 + len(a), len(a) + 1, len(a) + len(b))])
    assert {r.qname: (r.n_pairs, r.route) for r in detect.routes(df, found).collect()} == {"three": (3, "multsplits"), "spliced": (1, "splits"), "stops": (1, "splits"), "one": (0, "single"), "short": (0, "none"), "low": (0, "none"), "golden": (1, "splits")}
    assert {(r.rec_no, r.seg_no) for r in detect.annotated_gaps(df, introns).collect()} == {(2, 0)}


def test_unannotated_clusters(spark):
    """Clusters that meet no feature become features, those of a feature's strand widen it."""
    from ligaquery.operators.annotation import with_clusters

    feats = spark.createDataFrame([("1", "A", "+", 100, 200), ("2", "A", "-", 150, 160), ("3", "B", None, None, None)], "feature STRING, seqid STRING, strand STRING, feat_strt BIGINT, feat_end BIGINT")
    rows = [("A", "+", 190, 220, "B", "+", 10, 20, 2), ("A", "-", 90, 105, "B", "+", 15, 30, 3), ("A", "+", 900, 910, "B", "-", 15, 30, 1), ("A", "-", 500, 510, "B", "+", 31, 40, 2)]
    clusters = spark.createDataFrame(rows, "fst_ref STRING, fst_strand STRING, fst_strt BIGINT, fst_end BIGINT, sec_ref STRING, sec_strand STRING, sec_strt BIGINT, sec_end BIGINT, no_splits BIGINT")
    got = {tuple(r) for r in with_clusters(feats, clusters).collect()}
    new = [("A", "-", 500, 510), ("B", "+", 10, 30), ("B", "+", 31, 40)]
    assert got == {("1", "A", "+", 100, 220, False), ("2", "A", "-", 150, 160, False), ("3", "B", None, None, None, False)} | {(f"cluster:{a}:{b}:{c}-{d}", a, b, c, d, True) for a, b, c, d in new}
    assert {r.feature for r in with_clusters(feats, clusters.limit(0)).collect()} == {"1", "2", "3"}


def test_bounds_met(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "CELL", 64)
    segs, feats, met = _overlap_case(random.Random(14))
    want = defaultdict(list)
    for s, f in met:
        if s[3] == f[2]:
            want[f].append(s)
    want = Counter({(f[0], min(s[4] for s in ss), max(s[5] for s in ss)): feats.count(f) for f, ss in want.items()})
    placed, spans = _overlap_tables(spark, segs, feats)
    assert Counter(map(tuple, overlaps.bounds_met(spans, placed.drop("seg_no", "sample_idx")).collect())) == want
    assert overlaps.bounds_met(spans, placed.drop("seg_no", "sample_idx").limit(0)).count() == 0


def test_clusters_of_a_hot_place(spark, monkeypatch):
    """4 million sides by features, none of which is written."""
    from ligaquery.operators import annotation

    settle, written = annotation.settle, []
    monkeypatch.setattr(annotation, "settle", lambda df, *gone: written.append(settle(df, *gone)) or written[-1])
    feats = spark.range(2000).selectExpr("string(id) AS feature", "'A' AS seqid", "IF(id % 2 = 0, '+', '-') AS strand", "1000 + id AS feat_strt", "6000 + id AS feat_end")
    clusters = spark.range(1000).selectExpr("'A' AS fst_ref", "'+' AS fst_strand", "900 + id AS fst_strt", "3100 + id AS fst_end", "'A' AS sec_ref", "'+' AS sec_strand", "2999 + id AS sec_strt", "7900 + id AS sec_end", "2L AS no_splits")
    got = annotation.with_clusters(feats, clusters).groupBy("strand", "is_cluster").agg(F.count("*"), F.min("feat_strt"), F.max("feat_strt"), F.min("feat_end"), F.max("feat_end"))
    assert sorted(map(tuple, got.collect())) == [("+", False, 1000, 900, 900, 8899, 8899), ("-", False, 1000, 1001, 2999, 6001, 7999)]
    assert max(t.count() for t in written) == 2000


def test_chain_component(spark):
    v = spark.createDataFrame([(i,) for i in range(40)], "v BIGINT")
    e = spark.createDataFrame([(i, i + 1) for i in range(29)], "u BIGINT, v BIGINT")
    got = {r.v: r.root for r in clustering.components(v, e).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[i] == i for i in range(30, 40))


def test_partner_resolution(spark):
    rows = [(1, 0, "a", "sense"), (1, 0, "b", "Antisense"), (2, 0, "a", "anti-sense"), (2, 0, "a", "ANTISENSE"), (3, 0, "a", "sense "), (3, 0, "b", "sense"), (4, 0, ".", "sense"), (5, 0, None, "sense"), (6, 0, "a", None), (7, 0, "a", "sense"), (7, 0, "b", "sense"), (7, 0, "c", "antisense")]
    df = spark.createDataFrame(rows, "rec_no BIGINT, sample_idx INT, partner STRING, orientation STRING")
    p = interactions.partners(df)
    assert sorted(map(tuple, interactions.resolve(p).collect())) == [(1, "a", "sense"), (2, "a", "antisense"), (7, "c", "antisense")]
    assert abs(sum(r.share for r in interactions.frequencies(p).collect()) - 1) < 1e-12


def test_wide_counts_and_combination(spark):
    t = spark.createDataFrame([("a", "sense", "b", "sense", i, 6 + i, 0.01 * (i + 1)) for i in range(2)], "fst_rna STRING, fst_ori STRING, sec_rna STRING, sec_ori STRING, sample_idx INT, supp_reads BIGINT, pval DOUBLE")
    s = spark.createDataFrame([(0, "ctrls", None), (1, "trtms", "x"), (2, "trtms", "x"), (3, "trtms", "X")], "sample_idx INT, grp STRING, cond_name STRING")
    row = interactions.wide_counts(t, s).first().asDict()
    assert [row[k] for k in ("ctrls_na_001", "trtms_x_001", "trtms_x_002", "trtms_X_001")] == [6, 7, 0, 0]
    got = {(r.grp, r.cond_name): (r.n_supported, r.padj) for r in interactions.combined_p(t, s).collect()}
    assert got["ctrls", None][1] == __import__("pytest").approx(0.01)
    h = -math.log(min(1, 0.02 * 2))
    assert got["trtms", "x"] == (1, __import__("pytest").approx(math.exp(-h) * (1 + h)))


def test_params():
    p = load_params("[detect]\nquality = 30 # x\nmmrate=0.2\n# minlen = 3\nother = 1\n", minlen=7)
    assert (p.quality, p.mmrate, p.minlen, p.wsize) == (30, 0.2, 7, 3)


# ---- sources and sinks ----


def test_fastq_split_and_write(spark, tmp_path):
    import gzip

    from ligaquery.sinks.writers import write_fastq
    from ligaquery.sources.readers import read_fastq

    recs = [(f"r{i} x", "ACGT" * (1 + i % 5), ("@+II" * (1 + i % 5))) for i in range(200)]
    text = "".join(f"@{r}\n{s}\n+\n{q}\n" for r, s, q in recs)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text(text[:-1])
    with gzip.open(tmp_path / "in/b.fastq.gz", "wt") as f:
        f.write(text)
    got = read_fastq(spark, str(tmp_path / "in"), split_bytes=333)
    assert got.rdd.getNumPartitions() > 5
    assert Counter((r.read_id, r.seq, r.qual) for r in got.collect()) == Counter(recs * 2)
    write_fastq(got.withColumn("route", F.lit("merged")), str(tmp_path / "out"), "route")
    assert read_fastq(spark, str(tmp_path / "out/route=merged")).count() == 400


def test_sam_bam_fasta(spark, tmp_path):
    import gzip

    from ligaquery.sinks.writers import write_sam
    from ligaquery.sources.readers import read_bam, read_fasta, read_sam

    sam = "@SQ\tSN:c1\tLN:9\nq1\t16\tc1\t5\t60\t3M\t*\t0\t0\tACG\tIII\tXJ:i:2\tXJ:i:9\tXA:Z:a:b\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nbad line\n"
    (tmp_path / "x.sam").write_text(sam)
    rows = read_sam(spark, str(tmp_path / "x.sam")).collect()
    assert [(r.qname, r.rname, r.pos) for r in rows] == [("q1", "c1", 4), ("q2", None, None)] and rows[0].tags == {"XJ": "2", "XA": "a:b"}
    write_sam(read_sam(spark, str(tmp_path / "x.sam")), str(tmp_path / "o"))
    assert sorted(map(str, read_sam(spark, str(tmp_path / "o")).collect())) == sorted(map(str, rows))
    body = struct.pack("<iiBBHHHiiii", 0, 4, 3, 60, 0, 1, 16, 3, -1, -1, 0) + b"q1\0" + struct.pack("<I", 3 << 4) + bytes([0x12, 0x40]) + bytes([40, 40, 40]) + b"XJi" + struct.pack("<i", 2) + b"XAZa:b\0"
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 9) + struct.pack("<i", len(body)) + body
    with gzip.open(tmp_path / "x.bam", "wb") as f:
        f.write(raw)
    r = read_bam(spark, str(tmp_path / "x.bam")).first()
    assert (r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, r.tags) == ("q1", 16, "c1", 4, "3M", "ACG", "III", {"XJ": "2", "XA": "a:b"})
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one", "ACGTAC"), ("two", "GG")]


def test_bam_split_at_blocks(spark, tmp_path):
    """Every record once at any split size, also where records run over several blocks."""
    import zlib

    from ligaquery.sources.readers import _BamReader, read_bam

    rng = random.Random(21)

    def record(k):
        name, n = f"read{k}".encode() + b"\0", rng.choice([1, 7, 40, 400])
        seq_, qual = bytes(rng.randrange(256) for _ in range((n + 1) // 2)), bytes(rng.randrange(41) for _ in range(n))
        body = struct.pack("<iiBBHHHiiii", rng.choice([-1, 0, 1]), rng.randrange(5000), len(name), 60, 0, 1, 0, n, -1, -1, 0) + name + struct.pack("<I", n << 4) + seq_ + qual + b"XJi" + struct.pack("<i", k)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 9000) for n in (b"c1", b"c2"))
    data = head + b"".join(record(k) for k in range(200))

    def block(b):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(b) + z.flush()
        return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC\2\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(b), len(b))

    at, out = 0, b""
    while at < len(data):
        n = rng.choice([60, 300, 2000])
        out, at = out + block(data[at : at + n]), at + n
    path = tmp_path / "s.bam"
    path.write_bytes(out + block(b""))
    for split in (37, 500, 4096, 1 << 20):
        r = _BamReader(str(path), split)
        got = [(row[1], row[9]["XJ"]) for p in r.partitions() for row in r.read(p)]
        assert got == [(f"read{k}", str(k)) for k in range(200)], split
    assert read_bam(spark, str(path), 1000).count() == 200


def test_manifest(spark, tmp_path):
    from ligaquery.sources.manifest import discover, manifest, outputs, with_suffix

    for g, c, n in (("ctrls", "cond1", 1), ("trtms", "cond1", 3), ("trtms", "cond2", 2), ("other", "x", 1)):
        d = tmp_path / g / c
        d.mkdir(parents=True)
        for i in range(n):
            for m in (1, 2):
                (d / f"S{i}_{c}_R{m}.fastq").write_text("@a\nA\n+\nI\n")
    (tmp_path / "trtms/cond2/S9_R1.fastq").write_text("@a")
    (tmp_path / "trtms/cond2/.DS_Store").write_text("")
    got = discover(spark, str(tmp_path), "preproc", "PE")
    assert got.count() == 12 and {r.role for r in got.collect()} == {"forward", "reverse"}
    assert discover(spark, str(tmp_path)).count() == 13
    rows = outputs(got, "/out", "preproc", "PE")
    first = rows.where("grp = 'trtms' AND condition = 'cond1' AND sample_no = 1").first()
    assert first.input.forward.endswith("/trtms/cond1/S1_cond1_R1.fastq") and first.input.reverse.endswith("/trtms/cond1/S1_cond1_R2.fastq")
    d = "/out/preproc/trtms/cond1/S1_cond1_"
    assert first.output.asDict() == {"forward": f"{d}preproc.fastq", **{k: f"{d}{k}.fastq" for k in ("R1only", "R2only", "R1unmerged", "R2unmerged")}}
    doc = json.loads(manifest(rows).first().doc)["preproc"]
    assert list(doc) == ["ctrls", "trtms"] and [(c["condition"], len(c["samples"])) for c in doc["trtms"]] == [("cond1", 3), ("cond2", 2)]
    assert doc["ctrls"][0]["samples"][0]["output"]["R2only"] == "/out/preproc/ctrls/cond1/S0_cond1_R2only.fastq" and set(doc["ctrls"][0]["samples"][0]) == {"input", "output"}
    named = lambda n, *a: one(spark, (n,), "n STRING", with_suffix(F.col("n"), *a))
    assert named("S1_matched.bam", "_single", ["_matched"]) == "S1_single.bam" and named("a.b.txt", "_x", []) == "a_x.b.txt" and named("plain", "_x", ["_R1"]) == "plain_x"
    assert named("S_fwd_R1.fq", "_p", ["_R1", "fwd"]) == "S__p.fq"
    aligned = outputs(spark.createDataFrame([("ctrls", "c", 0, "forward", "/i/S1_c_preproc.fastq")], "grp STRING, condition STRING, sample_no INT, role STRING, path STRING"), "/o", "align")
    assert aligned.first().output.matched == "/o/align/ctrls/c/S1_c_preproc_matched.bam"


def test_tables_and_numbers(spark, tmp_path):
    from ligaquery.sinks.writers import number, numbered_clusters, write_table
    from ligaquery.sources.readers import read_clusters

    df = spark.createDataFrame([(f"c{i % 3}", "+", i, i + 5, "d", "-", i, i + 5, i % 4, 6, 6) for i in range(30)], "fst_ref STRING, fst_strand STRING, fst_strt BIGINT, fst_end BIGINT, sec_ref STRING, sec_strand STRING, sec_strt BIGINT, sec_end BIGINT, no_splits BIGINT, fst_len BIGINT, sec_len BIGINT")
    n = numbered_clusters(df)
    assert sorted(int(r.clust_id[7:]) for r in n.collect()) == list(range(1, 31))
    first = {int(r.clust_id[7:]): (r.fst_ref, r.fst_strt) for r in n.collect()}
    assert [first[i] for i in range(1, 31)] == sorted(first.values())
    write_table(n, str(tmp_path / "c"))
    assert read_clusters(spark, str(tmp_path / "c")).count() == sum(i % 4 >= 2 for i in range(30))
    vals = [0.5, 3.0, None, 1e-7, 100.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v DOUBLE").select(number(F.col("v"))).collect()]
    assert got == ["0.5", "3", ".", "0", "100"]


def test_stream_counts(spark, tmp_path):
    import datetime as dt

    from ligaquery.streaming import partner_counts as pc

    day = lambda d: dt.datetime(2024, 1, d, 5)
    rows = [(0, "a", day(1)), (0, "a", day(1)), (0, ".", day(1)), (0, None, day(1)), (1, "b", day(2)), (0, "z", dt.datetime(2024, 6, 1)), (0, "a", None)]
    df = spark.createDataFrame(rows, "sample_idx INT, partner STRING, annotated_at TIMESTAMP")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = pc.start(pc.daily_counts(pc.landing(spark, str(tmp_path / "in"), df)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(90)
    got = sorted((str(r.day), r.sample_idx, r.partner, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01", 0, "a", 2), ("2024-01-02", 1, "b", 1)]


def test_stream_counts_every_row(spark, tmp_path):
    """Late rows and the newest days are counted, whatever the number of files in a batch."""
    import datetime as dt
    import os

    from ligaquery.streaming import partner_counts as pc

    stamps = [dt.datetime(2025, 7, 1, 5), dt.datetime(2023, 4, 1, 5), dt.datetime(2024, 1, 1, 5), dt.datetime(2023, 4, 1, 6)]
    for i, at in enumerate(stamps):  # newest first
        df = spark.createDataFrame([(0, "a", at), (0, ".", at), (0, "a", None)], "sample_idx INT, partner STRING, annotated_at TIMESTAMP")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.name[:2] != "f_":
                os.rename(f, f.with_name(f"f_{i}.parquet"))
                os.utime(f.with_name(f"f_{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    for n in (1, 100):
        for _ in range(2):  # the second start finds nothing new
            pc.start_all(pc.landing(spark, str(tmp_path / "in"), df, n), str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}")).awaitTermination(60)
        got = sorted((str(r.day), r.sample_idx, r.partner, r.n) for r in pc.totals(spark, str(tmp_path / f"out{n}")).collect())
        assert got == [("2023-04-01", 0, "a", 2), ("2024-01-01", 0, "a", 1), ("2025-07-01", 0, "a", 1)]


def test_fastq_blank_lines(spark, tmp_path):
    """Blank lines end no read, whatever the split; what is no record is an error."""
    import gzip

    import pytest

    from ligaquery.sources.readers import FastqSource, read_fastq

    recs = [(f"r{i}", "ACGT" * (i % 5), "@+II" * (i % 5)) for i in range(60)]
    text = "".join(f"@{r}\n{s}\n+\n{q}\n" + ("\n" * (i % 12) if i % 7 == 3 else "") for i, (r, s, q) in enumerate(recs))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text("\n" + text)
    with gzip.open(tmp_path / "in/b.fastq.gz", "wt") as f:
        f.write(text + "\n")
    assert Counter((r.read_id, r.seq, r.qual) for r in read_fastq(spark, str(tmp_path / "in"), split_bytes=300).collect()) == Counter(recs * 2)
    for n in range(1, 140):
        reader = FastqSource({"path": str(tmp_path / "in/a.fastq"), "splitBytes": n}).reader(None)
        assert [r[1:] for p in reader.partitions() for r in reader.read(p)] == recs, n
    (tmp_path / "bad.fastq").write_text(text + "no record\n" * 200 + text)
    for n in (10_000_000, 300):
        reader = FastqSource({"path": str(tmp_path / "bad.fastq"), "splitBytes": n}).reader(None)
        with pytest.raises(ValueError, match="no FASTQ record"):
            [list(reader.read(p)) for p in reader.partitions()]
