"""DuckDB equivalents of the reference queries, written on their own."""

from __future__ import annotations

from ligaquery.plans import attribute_sql

READS = """
    docs AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents),
    reads AS (SELECT doc_id, read_no::INT AS read_no, s[read_no * 150 + 1 : read_no * 150 + 150] AS seq
        FROM (SELECT doc_id, s, unnest(range(0, ceil(length(s) / 150)::BIGINT)) AS read_no FROM docs WHERE s <> '')),
    quals AS (SELECT *, list_transform(range(1, length(seq) + 1), lambda i: (doc_id * 7 + i * 3 + floor(i * i / 50)::BIGINT) % 41) AS q FROM reads)"""
PAIRS = """
    marked AS (SELECT *, row_number() OVER (PARTITION BY sample_idx, qname ORDER BY rec_no) - 1 AS i FROM split_records WHERE qname IS NOT NULL),
    pairs AS (SELECT a.sample_idx, a.qname, (a.i // 2)::INT AS pair_no, a.rec_no AS a_rec_no, b.rec_no AS b_rec_no, a.refid AS a_refid, b.refid AS b_refid, a.flag AS a_flag,
            b.flag AS b_flag, a.mapq AS a_mapq, b.mapq AS b_mapq, a.pos AS a_pos, b.pos AS b_pos, a.cigar AS a_cigar, b.cigar AS b_cigar, a.xc, a.xe
        FROM marked a JOIN marked b ON a.sample_idx = b.sample_idx AND a.qname = b.qname AND b.i = a.i + 1 AND a.i % 2 = 0)"""
PARTNERS = """
    partners AS (SELECT DISTINCT rec_no, sample_idx, partner, regexp_replace(lower(trim(orientation)), '[^a-z]', '', 'g') AS orientation FROM int_partners
        WHERE partner NOT IN ('', '.') AND regexp_replace(lower(trim(orientation)), '[^a-z]', '', 'g') IN ('sense', 'antisense')),
    per AS (SELECT rec_no, count(*) FILTER (orientation = 'sense') AS s, count(*) FILTER (orientation <> 'sense') AS a,
            max(partner) FILTER (orientation = 'sense') AS sp, max(partner) FILTER (orientation <> 'sense') AS ap FROM partners GROUP BY rec_no),
    resolved AS (SELECT rec_no, CASE WHEN s = 1 THEN sp ELSE ap END AS partner, CASE WHEN s = 1 THEN 'sense' ELSE 'antisense' END AS orientation FROM per WHERE s = 1 OR a = 1),
    found AS (SELECT p.sample_idx, p.qname, p.pair_no, xc, xe,
            CASE WHEN (x.partner, x.orientation) <= (y.partner, y.orientation) THEN x.partner ELSE y.partner END AS fst_rna,
            CASE WHEN (x.partner, x.orientation) <= (y.partner, y.orientation) THEN x.orientation ELSE y.orientation END AS fst_ori,
            CASE WHEN (x.partner, x.orientation) <= (y.partner, y.orientation) THEN y.partner ELSE x.partner END AS sec_rna,
            CASE WHEN (x.partner, x.orientation) <= (y.partner, y.orientation) THEN y.orientation ELSE x.orientation END AS sec_ori
        FROM pairs p JOIN resolved x ON x.rec_no = p.a_rec_no JOIN resolved y ON y.rec_no = p.b_rec_no)"""
SUPPORT = """
    supp AS (SELECT fst_rna, fst_ori, sec_rna, sec_ori, sample_idx, count(*) AS supp_reads, median(c) * max(c) AS gcs,
            CASE WHEN median(e) < 0 AND min(e) < 0 THEN -1 ELSE 1 END * sqrt(abs(median(e) * min(e))) AS ghs
        FROM (SELECT *, CASE WHEN NOT isnan(xc) AND xc <> 1000 THEN xc::DOUBLE END AS c, CASE WHEN NOT isnan(xe) AND xe <> 1000 THEN xe::DOUBLE END AS e FROM found) GROUP BY ALL)"""
FREQ = """
    cnt AS (SELECT rec_no, count(*) AS n FROM partners GROUP BY rec_no),
    freq AS (SELECT *, f / sum(f) OVER (PARTITION BY sample_idx) AS share FROM (
        SELECT sample_idx, orientation, partner, sum(1 / n) AS f FROM partners JOIN cnt USING (rec_no) GROUP BY ALL))"""
TESTED = """
    total AS (SELECT sample_idx, count(DISTINCT qname) AS n FROM split_records GROUP BY 1),
    prob AS (SELECT s.*, n, CASE WHEN s.fst_rna = s.sec_rna AND s.fst_ori = s.sec_ori THEN 1 ELSE 2 END * coalesce(a.share, 0) * coalesce(b.share, 0) AS p
        FROM supp s LEFT JOIN freq a ON (a.sample_idx, a.partner, a.orientation) = (s.sample_idx, fst_rna, fst_ori)
        LEFT JOIN freq b ON (b.sample_idx, b.partner, b.orientation) = (s.sample_idx, sec_rna, sec_ori) JOIN total t ON t.sample_idx = s.sample_idx),
    tested AS (SELECT *, CASE WHEN supp_reads < 5 THEN 1.0 WHEN supp_reads >= n OR p <= 0 THEN 1e-10 ELSE greatest(1e-10, 1 - list_sum(list_transform(range(0, supp_reads + 1),
        lambda k: exp(lgamma(n + 1) - lgamma(k + 1.0) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))))) END AS pval FROM prob)"""
NAMES = "nm AS (SELECT refid, refname FROM contigs)"
OVERLAPS = f"""{NAMES},
    met AS (SELECT s.seg_no, s.sample_idx, f.feat_no, CASE WHEN (CASE WHEN s.flag & 16 <> 0 THEN '-' ELSE '+' END) = f.strand THEN 'sense' ELSE 'antisense' END AS orientation
        FROM segments s JOIN nm USING (refid) JOIN features f ON f.seqid = nm.refname AND s.seg_strt <= f.feat_end AND f.feat_strt <= s.seg_end
        WHERE s.seg_strt <= s.seg_end AND f.feat_strt <= f.feat_end AND (f.feat_type IS NULL OR f.feat_type <> 'region'))"""


def _span(cigar: str, kinds: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({cigar}, '([0-9]+)[{kinds}]', 1), lambda x: x::INT)), 0)::INT"


def _end(s: str) -> str:
    return f"{s}_pos + {_span(f'{s}_cigar', 'MDN=X')} - 1"


def _clip(cigar: str, where: str) -> str:
    return f"coalesce(try_cast(regexp_extract({cigar}, '{where}', 1) AS INT), 0)"


def _detection() -> str:
    """Tables pieces(rec_no, refid, k, strt, stop, rf, rt), heads(rec_no, sample_idx, qname, flag, mapq, len, xj), segs and met.

    The pieces of a record put together come from the CIGARs of its two parts, not from its own.
    """
    span, read, head, tail = (lambda c: _span(c, "MDN=X")), (lambda c: _span(c, "MIS=X")), (lambda c: _clip(c, "^([0-9]+)S")), (lambda c: _clip(c, "[^0-9]([0-9]+)S$"))
    return f"""{PAIRS},
    introns AS (SELECT refid, transcript, strt, stop FROM ({attribute_sql.INTRONS}) JOIN contigs ON seqid = refname),
    two AS (SELECT 'p' || a_rec_no AS rec_no, sample_idx, 'p:' || qname || ':' || pair_no AS qname, a_flag AS flag, least(a_mapq, b_mapq) AS mapq, a_refid AS refid,
            CASE WHEN (a_pos, a_cigar, a_rec_no) <= (b_pos, b_cigar, b_rec_no) THEN a_pos ELSE b_pos END AS p1, CASE WHEN (a_pos, a_cigar, a_rec_no) <= (b_pos, b_cigar, b_rec_no) THEN a_cigar ELSE b_cigar END AS c1,
            CASE WHEN (a_pos, a_cigar, a_rec_no) <= (b_pos, b_cigar, b_rec_no) THEN b_pos ELSE a_pos END AS p2, CASE WHEN (a_pos, a_cigar, a_rec_no) <= (b_pos, b_cigar, b_rec_no) THEN b_cigar ELSE a_cigar END AS c2
        FROM pairs WHERE a_refid = b_refid AND a_pos IS NOT NULL AND b_pos IS NOT NULL),
    spliced AS (SELECT *, {span('c1')} AS s1, {span('c2')} AS s2, {read('c1')} AS l1, {read('c2')} AS l2 FROM two WHERE {span('c1')} > 0 AND {span('c2')} > 0 AND p2 > p1 + {span('c1')}),
    over AS (SELECT *, k || refid || ':' || transcript || ':' || strt AS rec_no, strt - 31 AS pos, stop - strt + 1 AS n FROM introns, (VALUES ('i'), ('x'), ('c')) t(k)),
    heads AS (
        SELECT 'r' || rec_no AS rec_no, sample_idx, qname, flag, mapq, refid, pos, {read('cigar')} AS len, count(*) OVER (PARTITION BY sample_idx, qname) AS xj FROM split_records WHERE qname IS NOT NULL
        UNION ALL SELECT rec_no, sample_idx, qname, flag, mapq, refid, p1, l1 + l2, 2 FROM spliced
        UNION ALL SELECT rec_no, 0, rec_no, 0, 60, refid, pos, CASE k WHEN 'c' THEN 90 ELSE 60 END, CASE k WHEN 'c' THEN 3 ELSE 2 END FROM over),
    passing AS (SELECT * FROM heads WHERE flag & 4 = 0 AND mapq > 10 AND len > 15),
    ok AS (SELECT * FROM (SELECT *, min(CASE WHEN xj < 2 THEN rec_no END) OVER (PARTITION BY sample_idx, qname) AS halt FROM passing WHERE pos IS NOT NULL AND refid IS NOT NULL) WHERE halt IS NULL OR rec_no < halt),
    pieces AS (
        SELECT 'r' || rec_no AS rec_no, refid, 0 AS k, pos AS strt, pos + {span('cigar')} - 1 AS stop, {head('cigar')} + 1 AS rf, {read('cigar')} - {tail('cigar')} AS rt FROM split_records WHERE cigar IS NOT NULL AND pos IS NOT NULL
        UNION ALL SELECT rec_no, refid, 0, p1, p1 + s1 - 1, {head('c1')} + 1, l1 - {tail('c1')} FROM spliced
        UNION ALL SELECT rec_no, refid, 1, p2, p2 + s2 - 1, l1 + {head('c2')} + 1, l1 + l2 - {tail('c2')} FROM spliced
        UNION ALL SELECT rec_no, refid, 0, pos, pos + 29, 1, 30 FROM over
        UNION ALL SELECT rec_no, refid, 1, pos + 30 + n + CASE k WHEN 'x' THEN 60 ELSE 0 END, pos + 59 + n + CASE k WHEN 'x' THEN 60 ELSE 0 END, 31, 60 FROM over
        UNION ALL SELECT rec_no, refid, 2, pos + 120 + 2 * n, pos + 149 + 2 * n, 61, 90 FROM over WHERE k = 'c'),
    good AS (SELECT p.* FROM pieces p JOIN ok USING (rec_no) WHERE rt >= rf),
    gaps AS (SELECT a.rec_no, a.k, a.refid, a.stop + 1 AS e_end, b.strt AS e_strt FROM good a JOIN good b ON a.rec_no = b.rec_no AND b.k = a.k + 1),
    known AS (SELECT DISTINCT g.rec_no, g.k FROM gaps g JOIN introns i ON g.refid = i.refid AND e_end BETWEEN i.strt - 6 AND i.strt + 4 AND abs(e_strt - (i.stop + 1)) <= 5),
    segs AS (SELECT rec_no, part::INT AS seg_no, min(strt) AS strt, max(stop) AS stop, min(rf)::INT AS read_from, max(rt)::INT AS read_to
        FROM (SELECT g.*, g.k - (SELECT count(*) FROM known n WHERE n.rec_no = g.rec_no AND n.k < g.k) AS part FROM good g) GROUP BY rec_no, part HAVING max(rt) - min(rf) + 1 >= 15),
    met AS (SELECT o.sample_idx, o.qname, o.rec_no, o.refid, a.seg_no AS a_seg_no, a.strt AS a_strt, a.stop AS a_stop, a.read_from AS a_read_from, a.read_to AS a_read_to,
            b.seg_no AS b_seg_no, b.strt AS b_strt, b.stop AS b_stop, b.read_from AS b_read_from, b.read_to AS b_read_to
        FROM segs a JOIN segs b ON a.rec_no = b.rec_no AND a.seg_no < b.seg_no JOIN ok o ON o.rec_no = a.rec_no WHERE b.read_from > a.read_to)"""


KEY = "fst_rna, fst_ori, sec_rna, sec_ori"
LABELS = """SELECT *, coalesce(cond_name, 'na') || '_' || lpad(replicate_no::VARCHAR, 3, '0') AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY grp, cond_name ORDER BY sample_idx)::INT AS replicate_no FROM samples)"""
COUNTERS = """SELECT sample_idx, count(*) AS reads, sum(n)::BIGINT AS records, count(*) FILTER (n // 2 = 1) AS splits, count(*) FILTER (n // 2 > 1) AS multsplits
    FROM (SELECT sample_idx, qname, count(*) AS n FROM split_records GROUP BY ALL) GROUP BY ALL"""


COMBINED = f"""m AS (SELECT grp, cond_name, count(*) AS m FROM samples GROUP BY ALL),
    s AS (SELECT sample_idx, samples.grp, samples.cond_name, m FROM samples JOIN m ON m.grp IS NOT DISTINCT FROM samples.grp AND m.cond_name IS NOT DISTINCT FROM samples.cond_name),
    r AS (SELECT t.*, grp, cond_name, m, row_number() OVER (PARTITION BY {KEY}, grp, cond_name ORDER BY pval, t.sample_idx) AS k FROM tested t JOIN s USING (sample_idx)),
    x AS (SELECT {KEY}, grp, cond_name, m, count(*) AS n_supported, -sum(ln(least(1, pval * m / k))) AS h FROM r GROUP BY ALL),
    comb AS (SELECT {KEY}, grp, cond_name, n_supported, greatest(1e-10, exp(-h) * list_sum(list_transform(range(0, m), lambda k: CASE WHEN k = 0 THEN 1 ELSE h ** k / exp(lgamma(k + 1.0)) END))) AS padj FROM x)"""
CLUSTERS = f"""WITH RECURSIVE {PAIRS},
    ends AS (SELECT (a_refid, CASE WHEN a_flag & 16 <> 0 THEN '-' ELSE '+' END, a_pos, {_end('a')}) AS a, (b_refid, CASE WHEN b_flag & 16 <> 0 THEN '-' ELSE '+' END, b_pos, {_end('b')}) AS b
        FROM pairs WHERE a_refid IS NOT NULL AND b_refid IS NOT NULL AND a_pos IS NOT NULL AND b_pos IS NOT NULL AND {_span('a_cigar', 'MDN=X')} > 0 AND {_span('b_cigar', 'MDN=X')} > 0),
    box AS (SELECT row_number() OVER () AS v, least(a, b) AS x, greatest(a, b) AS y FROM ends),
    link AS (SELECT p.v AS u, q.v AS v FROM box p JOIN box q ON p.x[1] = q.x[1] AND p.x[2] = q.x[2] AND p.y[1] = q.y[1] AND p.y[2] = q.y[2]
        AND p.x[3] <= q.x[4] AND q.x[3] <= p.x[4] AND p.y[3] <= q.y[4] AND q.y[3] <= p.y[4]),
    near(v, r) AS (SELECT v, u FROM link UNION SELECT l.v, n.r FROM near n JOIN link l ON l.u = n.v),
    comp AS (SELECT v, min(r) AS root FROM near GROUP BY v)
    SELECT any_value(x[1]) AS fst_ref, any_value(x[2]) AS fst_strand, min(x[3]) AS fst_strt, max(x[4]) AS fst_end, any_value(y[1]) AS sec_ref, any_value(y[2]) AS sec_strand,
        min(y[3]) AS sec_strt, max(y[4]) AS sec_end, count(*) AS no_splits, max(x[4]) - min(x[3]) + 1 AS fst_len, max(y[4]) - min(y[3]) + 1 AS sec_len FROM box JOIN comp USING (v) GROUP BY root"""
ANNOTATED = f"""{CLUSTERS.split("SELECT any_value")[0].rstrip()},
    clusters AS (SELECT any_value{CLUSTERS.split("SELECT any_value")[1]}),
    sides AS (SELECT DISTINCT refname AS ref, strand, strt, stop FROM (SELECT fst_ref AS r, fst_strand AS strand, fst_strt AS strt, fst_end AS stop FROM clusters WHERE no_splits >= 2
        UNION ALL SELECT sec_ref, sec_strand, sec_strt, sec_end FROM clusters WHERE no_splits >= 2) JOIN contigs ON refid = r),
    feats AS (SELECT feat_no::VARCHAR AS feature, seqid, strand, feat_strt::BIGINT AS feat_strt, feat_end::BIGINT AS feat_end FROM features WHERE feat_type IS NULL OR feat_type <> 'region'),
    hit AS (SELECT feature, f.strand AS fs, s.* FROM sides s JOIN feats f ON f.seqid = s.ref AND s.strt <= f.feat_end AND f.feat_strt <= s.stop AND f.feat_strt <= f.feat_end),
    wide AS (SELECT feature, min(strt) AS a, max(stop) AS b FROM hit WHERE fs = strand GROUP BY ALL),
    free AS (SELECT * FROM sides WHERE (ref, strand, strt, stop) NOT IN (SELECT (ref, strand, strt, stop) FROM hit)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY ref, strand ORDER BY strt, stop ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN strt <= max(stop) OVER (PARTITION BY ref, strand ORDER BY strt, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM free)),
    fresh AS (SELECT ref, strand, min(strt) AS a, max(stop) AS b FROM runs GROUP BY ref, strand, g),
    anno AS (SELECT f.feature, seqid, strand, least(feat_strt, a) AS feat_strt, greatest(feat_end, b) AS feat_end, false AS is_cluster FROM feats f LEFT JOIN wide w ON w.feature = f.feature
        UNION ALL SELECT 'cluster:' || ref || ':' || strand || ':' || a || '-' || b, ref, strand, a, b, true FROM fresh)"""
HITS = """hits AS (SELECT s.seg_no, s.sample_idx, feature, CASE WHEN (CASE WHEN s.flag & 16 <> 0 THEN '-' ELSE '+' END) = n.strand THEN 'sense' ELSE 'antisense' END AS orientation
        FROM segments s JOIN contigs USING (refid) JOIN anno n ON n.seqid = refname AND s.seg_strt <= n.feat_end AND n.feat_strt <= s.seg_end WHERE s.seg_strt <= s.seg_end AND n.feat_strt <= n.feat_end)"""


def oracle_sql() -> dict[str, str]:
    hamming = "list_sum(list_transform(range(1, 8), lambda i: (seq[o + i] <> 'AGATCGG'[i])::INT))"
    return {
        "pred1_read_filter": f"WITH {READS} SELECT doc_id, read_no, floor(list_sum(q) / len(q))::INT AS mean_q FROM quals WHERE len(q) >= 15 AND floor(list_sum(q) / len(q)) >= 20",
        "f1_reverse_complement": f"WITH {READS} SELECT doc_id, read_no, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads",
        "t4_adapter_offsets": f"""WITH {READS}, offs AS (SELECT doc_id, read_no, seq, unnest(range(0, length(seq) - 6)) AS o FROM reads WHERE length(seq) >= 7)
            SELECT doc_id, read_no, min(o)::INT AS at FROM offs WHERE {hamming} <= 1 GROUP BY ALL""",
        "t5_trimmed_reads": f"""WITH {READS}, offs AS (SELECT doc_id, read_no, seq, unnest(range(0, length(seq) - 6)) AS o FROM reads WHERE length(seq) >= 7),
            hits AS (SELECT doc_id, read_no, min(o) AS first_at FROM offs WHERE {hamming} <= 1 GROUP BY ALL),
            cut AS (SELECT doc_id, read_no, seq, q, coalesce(first_at, length(seq)) AS n FROM quals LEFT JOIN hits USING (doc_id, read_no))
            SELECT doc_id, read_no, seq[1:n] AS seq, n::INT AS n FROM cut WHERE n >= 15 AND floor(list_sum(q[1:n]) / n) >= 20""",
        # runs of common 5-mers are the common substrings of at least 5 bases; the longest, then the first in the first mate, wins
        "f12_merged_mates": f"""WITH {READS}, r AS (SELECT doc_id, read_no // 2 AS pair_no, read_no % 2 AS side, seq, len(q) >= 15 AND floor(list_sum(q) / len(q)) >= 15 AS ok FROM quals),
            mates AS (SELECT a.doc_id, a.pair_no, a.seq AS s1, reverse(translate(b.seq, 'ACGT', 'TGCA')) AS s2, a.ok AS ok1, b.ok AS ok2 FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pair_no = b.pair_no AND a.side = 0 AND b.side = 1),
            x AS (SELECT doc_id, pair_no, i, s1[i : i + 4] AS k FROM (SELECT *, unnest(range(1, length(s1) - 3)) AS i FROM mates WHERE ok1 AND ok2)),
            y AS (SELECT doc_id, pair_no, j, s2[j : j + 4] AS k FROM (SELECT *, unnest(range(1, length(s2) - 3)) AS j FROM mates WHERE ok1 AND ok2)),
            hits AS (SELECT doc_id, pair_no, i, j, i - row_number() OVER (PARTITION BY doc_id, pair_no, i - j ORDER BY i) AS g FROM x JOIN y USING (doc_id, pair_no, k)),
            runs AS (SELECT doc_id, pair_no, count(*) + 4 AS n, max(i) + 4 AS to_a, max(j) + 4 AS to_b FROM hits GROUP BY doc_id, pair_no, i - j, g),
            best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, pair_no ORDER BY n DESC, to_a, to_b) = 1)
            SELECT m.doc_id, m.pair_no::BIGINT AS pair_no, CASE WHEN n IS NOT NULL THEN 'merged' WHEN ok1 AND ok2 THEN 'unmerged' WHEN ok1 THEN 'R1only' WHEN ok2 THEN 'R2only' ELSE 'dropped' END AS route,
                CASE WHEN n IS NOT NULL THEN s1[1 : to_a] || s2[to_b + 1 :] END AS seq FROM mates m LEFT JOIN best b ON b.doc_id = m.doc_id AND b.pair_no = m.pair_no""",
        "t9_window_trim": f"""WITH {READS} SELECT doc_id, read_no, (len(q) - 3 * list_filter(range(0, len(q) // 3 + 1),
            lambda k: len(q) - 3 * k < 3 OR list_sum(q[len(q) - 3 * k - 2 : len(q) - 3 * k]) >= 75)[1])::INT AS stop FROM quals""",
        "f10_segments": f"""WITH c AS (SELECT rec_no, pos, cigar, coalesce(try_cast(regexp_extract(cigar, '^([0-9]+)S', 1) AS INT), 0) AS head,
                coalesce(try_cast(regexp_extract(cigar, '[^0-9]([0-9]+)S$', 1) AS INT), 0) AS tail FROM split_records WHERE pos IS NOT NULL AND cigar IS NOT NULL),
            s AS (SELECT rec_no, 0::INT AS seg_no, pos AS strt, pos + {_span('cigar', 'MDN=X')} - 1 AS stop, head + 1 AS read_from, {_span('cigar', 'MIS=X')} - tail AS read_to FROM c)
            SELECT * FROM s WHERE read_to - read_from + 1 >= 15""",
        "f10_spliced_segments": f"WITH {_detection()} SELECT * FROM segs",
        "j4_spliced_pairs": f"WITH {_detection()} SELECT rec_no, k::INT AS seg_no FROM known",
        "j2_segment_pairs": f"WITH {_detection()} SELECT * FROM met",
        "pred6_detected_routes": f"""WITH {_detection()}, n AS (SELECT sample_idx, qname, count(*) AS n FROM met GROUP BY ALL),
            per AS (SELECT sample_idx, qname, coalesce(bool_or(xj < 2 AND rec_no IN (SELECT rec_no FROM passing)), false) AS single FROM heads GROUP BY ALL)
            SELECT p.sample_idx, p.qname, coalesce(n, 0) AS n_pairs, CASE WHEN n > 1 THEN 'multsplits' WHEN n = 1 THEN 'splits' WHEN single THEN 'single' ELSE 'none' END AS route
            FROM per p LEFT JOIN n ON n.sample_idx IS NOT DISTINCT FROM p.sample_idx AND n.qname = p.qname""",
        "f6_feature_names": attribute_sql.NAMES,
        "w7_introns": attribute_sql.INTRONS,
        "a16_junctions": attribute_sql.JUNCTIONS,
        "a9_clusters": CLUSTERS,
        "pred4_record_filter": f"SELECT rec_no, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM split_records WHERE flag & 4 = 0 AND mapq > 10 AND {_span('cigar', 'MIS=X')} > 15",
        "d4_cigar_spans": f"""SELECT rec_no, {_span('cigar', 'MIS=X')} AS read_span, {_span('cigar', 'MDN=X')} AS ref_span,
            len(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]'))::INT AS n_ops FROM split_records""",
        "a2_sample_counters": COUNTERS,
        "pred11_routes": """SELECT sample_idx, qname, count(*) // 2 AS n_pairs, CASE count(*) // 2 WHEN 0 THEN 'single' WHEN 1 THEN 'splits' ELSE 'multsplits' END AS route
            FROM split_records WHERE qname IS NOT NULL GROUP BY ALL""",
        "k8_stats": f"""SELECT l.sample_idx, grp, label, coalesce(reads, 0) AS reads, coalesce(records, 0) AS records, coalesce(splits, 0) AS splits, coalesce(multsplits, 0) AS multsplits
            FROM ({LABELS}) l LEFT JOIN ({COUNTERS}) c USING (sample_idx)""",
        "a17_replicates": f"SELECT sample_idx, grp, cond_name, replicate_no, label FROM ({LABELS})",
        "j7_record_pairs": f"WITH {PAIRS} SELECT sample_idx, qname, pair_no, a_rec_no, b_rec_no FROM pairs",
        "pred8_distinct_segments": f"""WITH {PAIRS} SELECT a_rec_no, b_rec_no FROM pairs WHERE a_refid IS NOT NULL AND b_refid IS NOT NULL AND a_pos IS NOT NULL AND b_pos IS NOT NULL
            AND NOT (a_refid = b_refid AND a_pos <= {_end('b')} AND b_pos <= {_end('a')})""",
        "j3_overlaps": f"WITH {OVERLAPS} SELECT seg_no, feat_no, orientation FROM met",
        "a4_feature_frequency": f"""WITH {OVERLAPS} SELECT sample_idx, orientation, feat_no, round(sum(1 / n), 6) AS f
            FROM (SELECT *, count(*) OVER (PARTITION BY seg_no) AS n FROM met) GROUP BY ALL""",
        "pred20_resolved_segments": f"""WITH {OVERLAPS}, per AS (SELECT seg_no, count(*) FILTER (orientation = 'sense') AS s, count(*) FILTER (orientation <> 'sense') AS a,
            max(feat_no) FILTER (orientation = 'sense') AS sf, max(feat_no) FILTER (orientation <> 'sense') AS af FROM met GROUP BY 1)
            SELECT seg_no, CASE WHEN s = 1 THEN sf ELSE af END AS feat_no, CASE WHEN s = 1 THEN 'sense' ELSE 'antisense' END AS orientation FROM per WHERE s = 1 OR a = 1""",
        "j5_unannotated": f"WITH {OVERLAPS} SELECT seg_no FROM segments JOIN nm USING (refid) WHERE seg_strt <= seg_end AND seg_no NOT IN (SELECT seg_no FROM met)",
        "a5_frequencies": f"WITH {PARTNERS.split('resolved AS')[0].rstrip().rstrip(',')}, {FREQ} SELECT sample_idx, orientation, partner, round(f, 6) AS f, round(share, 9) AS share FROM freq",
        "f22_interactions": f"WITH {PAIRS}, {PARTNERS} SELECT sample_idx, qname, pair_no, {KEY} FROM found",
        "a6_support": f"WITH {PAIRS}, {PARTNERS}, {SUPPORT} SELECT {KEY}, sample_idx, supp_reads, round(gcs, 6) AS gcs, round(ghs, 6) AS ghs FROM supp",
        "f19_p_values": f"WITH {PAIRS}, {PARTNERS}, {SUPPORT}, {FREQ}, {TESTED} SELECT {KEY}, sample_idx, supp_reads, round(pval, 8) AS pval FROM tested",
        "a14_combined_p": f"WITH {PAIRS}, {PARTNERS}, {SUPPORT}, {FREQ}, {TESTED}, {COMBINED} SELECT {KEY}, grp, cond_name, n_supported, round(padj, 8) AS padj FROM comb",
        "k5_allints": f"""WITH {PAIRS}, {PARTNERS}, {SUPPORT}, {FREQ}, {TESTED}, {COMBINED}, lab AS ({LABELS}),
            ends AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY grp, cond_name ORDER BY replicate_no DESC) = 1),
            padj AS (SELECT c.*, e.sample_idx FROM comb c JOIN ends e ON e.grp IS NOT DISTINCT FROM c.grp AND e.cond_name IS NOT DISTINCT FROM c.cond_name)
            SELECT {KEY}, lab.grp, lab.cond_name, replicate_no, label, coalesce(t.supp_reads, 0) AS supp_reads, round(t.gcs, 6) AS gcs, round(t.ghs, 6) AS ghs, round(coalesce(t.pval, 1.0), 8) AS pval, round(p.padj, 8) AS padj
            FROM tested t FULL JOIN padj p USING ({KEY}, sample_idx) JOIN lab USING (sample_idx)""",
        "k6_replicate_counts": f"""WITH {PAIRS}, {PARTNERS}, {SUPPORT}, lab AS ({LABELS})
            SELECT concat_ws('_', fst_rna, sec_rna, fst_ori, sec_ori) AS id, grp, label, sample_idx, supp_reads FROM supp JOIN lab USING (sample_idx)""",
        "k8_run_stats": f"""WITH {PAIRS}, {PARTNERS}, lab AS ({LABELS}),
            readers AS (SELECT sample_idx, qname, count(*) AS n, count(*) FILTER (flag & 4 = 0 AND mapq > 10 AND {_span('cigar', 'MIS=X')} > 15 AND pos IS NOT NULL AND refid IS NOT NULL) AS u FROM split_records WHERE qname IS NOT NULL GROUP BY ALL),
            n AS (SELECT sample_idx, count(*) AS reads, count(*) FILTER (n = 1 AND u = 1) AS aligned, count(*) FILTER (n // 2 = 1) AS splits, count(*) FILTER (n // 2 > 1) AS multsplits FROM readers GROUP BY ALL),
            i AS (SELECT sample_idx, count(*) AS interactions FROM (SELECT DISTINCT sample_idx, {KEY} FROM found) GROUP BY ALL)
            SELECT lab.sample_idx, grp, label, coalesce(reads, 0) AS reads, coalesce(aligned, 0) AS aligned, coalesce(splits, 0) AS splits, coalesce(multsplits, 0) AS multsplits, coalesce(interactions, 0) AS interactions
            FROM lab LEFT JOIN n USING (sample_idx) LEFT JOIN i USING (sample_idx)""",
        "k4_interactions": f"""WITH {PAIRS}, {PARTNERS},
            names AS ({attribute_sql.NAMES}), anno AS (SELECT name, arg_min({{'b': biotype, 's': strand, 'p': product}}, feat_no) AS f FROM names JOIN features USING (feat_no) WHERE name IS NOT NULL GROUP BY name)
            SELECT qname, CASE WHEN a_flag & 16 <> 0 THEN '-' ELSE '+' END AS fst_strand, a_pos AS fst_strt, a_pos + {_span('a_cigar', 'MIS=X')} AS fst_end, ca.refname AS fst_ref, x.partner AS fst_name, fa.f.b AS fst_biotype, fa.f.s AS fst_anno_strand, fa.f.p AS fst_product, x.orientation AS fst_ori,
                CASE WHEN b_flag & 16 <> 0 THEN '-' ELSE '+' END AS sec_strand, b_pos AS sec_strt, b_pos + {_span('b_cigar', 'MIS=X')} AS sec_end, cb.refname AS sec_ref, y.partner AS sec_name, fb.f.b AS sec_biotype, fb.f.s AS sec_anno_strand, fb.f.p AS sec_product, y.orientation AS sec_ori,
                xc AS cmpl, '.' AS fst_aln, '.' AS sec_aln, xe AS mfe, '.' AS mfe_struc
            FROM pairs JOIN contigs ca ON ca.refid = a_refid JOIN contigs cb ON cb.refid = b_refid JOIN resolved x ON x.rec_no = a_rec_no JOIN resolved y ON y.rec_no = b_rec_no
            LEFT JOIN anno fa ON fa.name = x.partner LEFT JOIN anno fb ON fb.name = y.partner WHERE a_pos IS NOT NULL AND b_pos IS NOT NULL""",
        "j11_exon_genes": f"""WITH {attribute_sql.VALS}, {attribute_sql.FEATURES}, kids AS (SELECT DISTINCT feat_no FROM vals WHERE attr_key = 'parent'),
            l AS (SELECT fs.*, kids.feat_no IS NOT NULL AS has_parent FROM fs LEFT JOIN kids USING (feat_no)),
            o AS (SELECT *, last_value(CASE WHEN NOT has_parent THEN {{'no': feat_no, 'seq': seqid, 'a': feat_strt, 'b': feat_end}} END IGNORE NULLS) OVER (ORDER BY feat_no) AS g FROM l)
            SELECT feat_no, g.no AS gene_no FROM o WHERE feat_type = 'exon' AND has_parent AND g.seq = seqid AND feat_strt >= g.a AND feat_end <= g.b""",
        "u2_annotation": f"{ANNOTATED} SELECT * FROM anno",
        "j5_overlaps": f"{ANNOTATED}, {HITS} SELECT seg_no, feature, orientation FROM hits",
        "j5_feature_frequency": f"{ANNOTATED}, {HITS} SELECT sample_idx, orientation, feature, round(sum(1 / n), 6) AS f FROM (SELECT *, count(*) OVER (PARTITION BY seg_no) AS n FROM hits) GROUP BY ALL",
        "j5_resolved_segments": f"""{ANNOTATED}, {HITS}, rs AS (SELECT seg_no, count(*) FILTER (orientation = 'sense') AS s, count(*) FILTER (orientation <> 'sense') AS a,
            max(feature) FILTER (orientation = 'sense') AS sf, max(feature) FILTER (orientation <> 'sense') AS af FROM hits GROUP BY 1)
            SELECT seg_no, CASE WHEN s = 1 THEN sf ELSE af END AS feature, CASE WHEN s = 1 THEN 'sense' ELSE 'antisense' END AS orientation FROM rs WHERE s = 1 OR a = 1""",
        "k6_condition_counts": f"""WITH {PAIRS}, {PARTNERS}, {SUPPORT} SELECT {KEY}, grp, cond_name, sum(supp_reads)::BIGINT AS supp_reads, count(*) AS replicates
            FROM supp JOIN samples USING (sample_idx) GROUP BY ALL""",
        "k7_graph_nodes": f"""WITH {PAIRS}, {PARTNERS} SELECT DISTINCT l || '|' || o AS node_id, l AS label, o AS orientation
            FROM (SELECT fst_rna AS l, fst_ori AS o FROM found UNION SELECT sec_rna, sec_ori FROM found)""",
        "k7_graph_edges": f"""WITH {PAIRS}, {PARTNERS} SELECT DISTINCT fst_rna || '|' || fst_ori AS source, sec_rna || '|' || sec_ori AS target, 'basepairing' AS relation FROM found""",
    }
