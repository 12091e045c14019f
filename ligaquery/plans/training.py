"""Queries of the general training-data problems 2 to 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligaquery.operators import heavy_keys, hierarchy, packed, periods, quarantine
from ligaquery.plans import attribute_sql
from ligaquery.session import cut, table

VALUE_KEYS = ["alias", "dbxref", "ontology_term", "parent"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "int_partners").select("sample_idx", "partner").where("partner IS NOT NULL AND partner NOT IN ('', '.')")
    keys = ["sample_idx", "partner"]
    counts = heavy_keys.chunk_counts(heavy_keys.number_rows(rows, keys), keys)
    return heavy_keys.shares_at_least(counts, "sample_idx", 50).select(*keys)


def p2_partner_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "split_records").select("rec_no", F.col("xc").cast("double").alias("xc"), F.col("xe").cast("double").alias("xe"))
    scores = scores.withColumns({c: F.when(~F.isnan(c) & (F.col(c) != 1000), F.col(c)) for c in ("xc", "xe")})
    rows = table(spark, sf_dir, "int_partners").select("ip_no", "rec_no", "sample_idx", "partner", "orientation")
    joined = rows.join(scores, "rec_no", "left").drop("rec_no")
    keys = ["sample_idx", "partner"]
    stats = heavy_keys.chunk_stats(heavy_keys.number_rows(joined, keys, ["ip_no"]), keys, ["xc", "xe"], "orientation")
    return stats.select(*keys, "n_rows", "n_switches", *(x for s in ("xc", "xe") for x in (f"n_{s}", F.round(f"mean_{s}", 6).alias(f"mean_{s}"), f"min_{s}", f"max_{s}")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periods_and_gaps(table(spark, sf_dir, "segments"), ("sample_idx", "refid"), "seg_strt", "seg_end")


def _feature_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (x), links (p, c)) of the features: the first ID of a row, and each of its parents."""
    rows = table(spark, sf_dir, "features").where("feat_type IS NULL OR feat_type <> 'region'").select("attributes")
    of = lambda k: F.filter("vals", lambda v: v["attr_key"] == k)
    read = packed.packed_values(rows, "attributes", ["id", "parent"]).select(F.get(of("id"), F.lit(0))["val"].alias("c"), F.transform(of("parent"), lambda v: v["val"]).alias("ps"))
    read = cut(read.where("c IS NOT NULL").distinct())
    return read.select(F.col("c").alias("x")), read.select(F.explode("ps").alias("p"), "c")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(*_feature_links(spark, sf_dir)).select("feature_id", "root_id", "depth", "feature_path")


def p4_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way down to a feature with the number of ways that go on below it."""
    return hierarchy.hierarchy(*_feature_links(spark, sf_dir)).select("feature_id", "feature_path", "depth", "n_ways_down")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature with each feature below it, those on and above cycles included."""
    return hierarchy.descendants(*_feature_links(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_packed(table(spark, sf_dir, "features"), "feat_no", "attributes", VALUE_KEYS)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.check_gff(table(spark, sf_dir, "gff_lines"), table(spark, sf_dir, "contigs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.rejected(_checked(spark, sf_dir), "line_id")


def p6_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.accepted(_checked(spark, sf_dir), "line_id")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_partner_stats, p3_found, p4_found, p4_subtrees, p4_descendants, p5_found, p6_found, p6_features)}


def oracle_sql() -> dict[str, str]:
    fields = r"string_split(regexp_replace(line, '\r$', ''), chr(9))"
    plain = "regexp_full_match(f[{i}], '[0-9]+') AND try_cast(f[{i}] AS HUGEINT) BETWEEN 1 AND 2147483647"
    checked = f"""
        WITH r AS (SELECT line_id, {fields} AS f FROM gff_lines WHERE NOT regexp_full_match(line, '\\s*') AND NOT starts_with(line, '#')),
        c AS (SELECT line_id, f, CASE WHEN len(f) <> 9 THEN 'columns'
            WHEN (length(f[9]) - length(replace(f[9], '"', ''))) % 2 = 1 THEN 'quoting'
            WHEN f[1] NOT IN (SELECT refname FROM contigs) THEN 'seqid'
            WHEN NOT coalesce({plain.format(i=4)}, false) OR ({plain.format(i=5)} AND try_cast(f[4] AS HUGEINT) > try_cast(f[5] AS HUGEINT)) THEN 'start'
            WHEN f[7] NOT IN ('+', '-', '.', '?') THEN 'strand' END AS reason FROM r)"""
    covered = """
        WITH s AS (SELECT sample_idx, refid, seg_strt AS a, seg_end AS b FROM segments WHERE sample_idx IS NOT NULL AND refid IS NOT NULL AND seg_strt <= seg_end),
        m AS (SELECT *, max(b) OVER (PARTITION BY sample_idx, refid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s),
        g AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_idx, refid ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
        p AS (SELECT sample_idx, refid, k, min(a) AS strt, max(b) AS stop FROM g GROUP BY ALL)
        SELECT sample_idx, refid, 'period' AS kind, strt, stop FROM p UNION ALL
        SELECT * FROM (SELECT sample_idx, refid, 'gap', lag(stop) OVER (PARTITION BY sample_idx, refid ORDER BY strt) + 1 AS strt, strt - 1 FROM p) WHERE strt IS NOT NULL"""
    return {
        "p2_found": """
            WITH c AS (SELECT sample_idx, partner, count(*) AS n FROM int_partners WHERE partner NOT IN ('', '.') GROUP BY ALL)
            SELECT sample_idx, partner FROM (SELECT *, sum(n) OVER (PARTITION BY sample_idx) AS t FROM c) WHERE n * 50 >= t""",
        "p2_partner_stats": """
            WITH r AS (SELECT rec_no, CASE WHEN NOT isnan(xc) AND xc <> 1000 THEN xc::DOUBLE END AS xc, CASE WHEN NOT isnan(xe) AND xe <> 1000 THEN xe::DOUBLE END AS xe FROM split_records),
            j AS (SELECT i.*, xc, xe, row_number() OVER k AS rn, lag(orientation) OVER k AS prev FROM int_partners i LEFT JOIN r USING (rec_no) WINDOW k AS (PARTITION BY i.sample_idx, partner ORDER BY ip_no))
            SELECT sample_idx, partner, count(*) AS n_rows, count(*) FILTER (rn > 1 AND orientation IS DISTINCT FROM prev) AS n_switches,
                count(xc) AS n_xc, round(avg(xc), 6) AS mean_xc, min(xc) AS min_xc, max(xc) AS max_xc, count(xe) AS n_xe, round(avg(xe), 6) AS mean_xe, min(xe) AS min_xe, max(xe) AS max_xe
            FROM j GROUP BY ALL""",
        "p3_found": covered,
        "p4_found": attribute_sql.TREE,
        "p4_subtrees": attribute_sql.SUBTREES,
        "p4_descendants": attribute_sql.DESCENDANTS,
        "p5_found": attribute_sql.VALUES,
        "p6_found": f"{checked} SELECT line_id, reason FROM c WHERE reason IS NOT NULL",
        "p6_features": f"""{checked} SELECT line_id, f[1] AS seqid, f[2] AS source, f[3] AS feat_type, f[4]::INT AS feat_strt, CASE WHEN {plain.format(i=5)} THEN try_cast(f[5] AS INT) END AS feat_end,
            try_cast(f[6] AS DOUBLE) AS score, f[7] AS strand, try_cast(f[8] AS INT) AS phase, f[9] AS attributes FROM c WHERE reason IS NULL""",
    }
