"""DuckDB text that reads the packed attributes of ``features``."""

from __future__ import annotations

#: pieces outside quotes, the key of each, and its values: table vals(feat_no, attr_key, i, val)
VALS = r"""
    pieces AS (SELECT feat_no, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
        FROM (SELECT feat_no, regexp_extract_all(attributes, '(?:"[^"]*"|"[^"]*$|[^";,|/])+') AS ps FROM features)),
    keyed AS (SELECT feat_no, i, CASE WHEN regexp_matches(p, '^[^="]*[^="\s][^="]*=') THEN lower(trim(regexp_extract(p, '^([^="]+)=', 1)))
            WHEN regexp_matches(p, '^\s*[A-Za-z_]+\s+"') THEN lower(regexp_extract(p, '^\s*([A-Za-z_]+)', 1)) END AS k,
        trim(CASE WHEN regexp_matches(p, '^[^="]*[^="\s][^="]*=') THEN regexp_replace(p, '^[^="]+=', '')
            WHEN regexp_matches(p, '^\s*[A-Za-z_]+\s+"') THEN regexp_replace(p, '^\s*[A-Za-z_]+\s+', '') ELSE p END) AS v FROM pieces),
    carried AS (SELECT feat_no, i, last_value(k IGNORE NULLS) OVER (PARTITION BY feat_no ORDER BY i) AS attr_key, v FROM keyed),
    vals AS (SELECT feat_no, attr_key, i, url_decode(CASE WHEN length(v) >= 2 AND v[1] = '"' AND v[-1] = '"' THEN replace(v[2:-2], '""', '"') ELSE v END) AS val
        FROM carried WHERE attr_key IS NOT NULL AND trim(CASE WHEN length(v) >= 2 AND v[1] = '"' AND v[-1] = '"' THEN v[2:-2] ELSE v END) <> '')"""

FEATURES = "fs AS (SELECT * FROM features WHERE feat_type IS NULL OR feat_type <> 'region')"

EXONS = f"""{VALS}, {FEATURES},
    exons AS (SELECT DISTINCT seqid, val AS transcript, feat_strt, feat_end FROM fs JOIN vals USING (feat_no) WHERE attr_key = 'parent' AND feat_type = 'exon' AND feat_strt <= feat_end)"""

NAMES = f"""WITH {VALS}, {FEATURES}, firsts AS (SELECT feat_no, attr_key, arg_min(val, i) AS val FROM vals GROUP BY ALL),
    wide AS (SELECT feat_no, max(val) FILTER (attr_key = 'id') AS id, max(val) FILTER (attr_key = 'gene_name') AS gn, max(val) FILTER (attr_key = 'name') AS n,
        max(val) FILTER (attr_key = 'gene_biotype') AS gb, max(val) FILTER (attr_key = 'gene_type') AS gt, max(val) FILTER (attr_key = 'product') AS product FROM firsts GROUP BY feat_no)
    SELECT fs.feat_no, id, coalesce(gn, n) AS name, coalesce(gb, gt) AS biotype, product FROM fs LEFT JOIN wide USING (feat_no)"""

INTRONS = f"""WITH {EXONS}, nx AS (SELECT *, lead(feat_strt) OVER (PARTITION BY seqid, transcript ORDER BY feat_strt, feat_end) AS nxt FROM exons)
    SELECT seqid, transcript, feat_end + 1 AS strt, nxt - 1 AS stop FROM nx WHERE nxt > feat_end + 1"""

JUNCTIONS = f"""WITH {EXONS} SELECT seqid, transcript, count(*)::INT AS n_exons, string_agg(feat_strt || '-' || feat_end, ',' ORDER BY feat_strt, feat_end) AS exons FROM exons GROUP BY ALL"""

VALUES = f"""WITH {VALS} SELECT feat_no, attr_key, row_number() OVER (PARTITION BY feat_no, attr_key ORDER BY i)::INT AS val_pos, val
    FROM vals WHERE attr_key IN ('alias', 'dbxref', 'ontology_term', 'parent')"""

TREE = f"""WITH RECURSIVE {VALS}, {FEATURES},
    own AS (SELECT feat_no, arg_min(val, i) AS id FROM vals JOIN fs USING (feat_no) WHERE attr_key = 'id' GROUP BY feat_no),
    nodes AS (SELECT DISTINCT id FROM own),
    links AS (SELECT DISTINCT v.val AS p, own.id AS c FROM own JOIN vals v USING (feat_no) WHERE attr_key = 'parent' AND v.val IN (SELECT id FROM nodes)),
    up(n, a) AS (SELECT c, p FROM links UNION SELECT up.n, l.p FROM up JOIN links l ON l.c = up.a),
    ring AS (SELECT n FROM up WHERE n = a),
    bad AS (SELECT id, CASE WHEN id IN (SELECT n FROM ring) THEN -1 ELSE -2 END AS depth FROM nodes
        WHERE id IN (SELECT n FROM ring) OR id IN (SELECT n FROM up WHERE a IN (SELECT n FROM ring))),
    ways(feature_id, root_id, depth, feature_path) AS (
        SELECT id, id, 0, id FROM nodes WHERE id NOT IN (SELECT c FROM links)
        UNION ALL SELECT l.c, root_id, depth + 1, feature_path || '/' || l.c FROM ways JOIN links l ON l.p = feature_id WHERE l.c NOT IN (SELECT id FROM bad))
    SELECT feature_id, root_id, depth, feature_path FROM ways UNION ALL SELECT id, '', depth, '' FROM bad"""

DESCENDANTS = f"{TREE.split('ring AS')[0].rstrip().rstrip(',')} SELECT a AS feature_id, n AS descendant_id FROM up WHERE a <> n"

#: nodes that a cycle can be reached from have no number of ways down
SUBTREES = f"""{TREE.rsplit("SELECT feature_id, root_id", 1)[0].rstrip()},
    free AS (SELECT id FROM nodes WHERE id NOT IN (SELECT n FROM ring) AND id NOT IN (SELECT a FROM up WHERE n IN (SELECT n FROM ring))),
    walk(a, n) AS (SELECT p, c FROM links WHERE p IN (SELECT id FROM free) UNION ALL SELECT w.a, l.c FROM walk w JOIN links l ON l.p = w.n),
    below AS (SELECT a, count(*) AS k FROM walk GROUP BY a)
    SELECT feature_id, feature_path, depth, CASE WHEN feature_id IN (SELECT id FROM free) THEN coalesce(k, 0) END AS n_ways_down FROM ways LEFT JOIN below ON a = feature_id
    UNION ALL SELECT id, '', depth, NULL FROM bad"""
