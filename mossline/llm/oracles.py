"""SQL of the llm queries that plain SQL can express."""

P4_LATEST = """
WITH latest AS (
  SELECT node_id, code, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC NULLS LAST) AS k
  FROM nodes WHERE node_id IS NOT NULL
)
"""

P4_REBUILT = P4_LATEST + "SELECT node_id, code FROM latest WHERE k = 1 AND length(code) > 2000"

P4_FOUND = P4_LATEST + r"""
SELECT node_id,
       CASE WHEN list_max(list_transform(regexp_split_to_array(code, '\r\n|\r|\n'), lambda x: length(x))) > 2000 THEN 1 ELSE 0 END::INT AS forced
FROM latest WHERE k = 1 AND length(code) > 2000
"""

P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

# The published coefficients of Acklam's approximation.
QUANTILE = """
CASE WHEN p < 0.02425 THEN
  (((((-7.784894002430293e-03*l-3.223964580411365e-01)*l-2.400758277161838e+00)*l-2.549732539343734e+00)*l+4.374664141464968e+00)*l+2.938163982698783e+00)
  / ((((7.784695709041462e-03*l+3.224671290700398e-01)*l+2.445134137142996e+00)*l+3.754408661907416e+00)*l+1.0)
WHEN p > 0.97575 THEN
  -(((((-7.784894002430293e-03*h-3.223964580411365e-01)*h-2.400758277161838e+00)*h-2.549732539343734e+00)*h+4.374664141464968e+00)*h+2.938163982698783e+00)
  / ((((7.784695709041462e-03*h+3.224671290700398e-01)*h+2.445134137142996e+00)*h+3.754408661907416e+00)*h+1.0)
ELSE
  (((((-3.969683028665376e+01*r+2.209460984245205e+02)*r-2.759285104469687e+02)*r+1.383577518672690e+02)*r-3.066479806614716e+01)*r+2.506628277459239e+00)*q
  / (((((-5.447609879822406e+01*r+1.615858368580409e+02)*r-1.556989798598866e+02)*r+6.680131188771972e+01)*r-1.328068155288572e+01)*r+1.0)
END
"""

P6_FUSED = f"""
WITH raw AS (
  SELECT instance_id AS g, lower(trim(retriever)) AS s,
         regexp_replace(regexp_replace(replace(trim(file_path), '\\', '/'), '/(\\./|/)+', '/', 'g'), '^([ab]/|(\\.?/)+)', '') AS i,
         CASE WHEN isnan(score) THEN NULL ELSE score END AS score, rank::DOUBLE AS rank
  FROM rankings
), once AS (
  SELECT g, s, i, max(score) AS score, min(rank) AS rank FROM raw
  WHERE g IS NOT NULL AND i <> '' AND s IN ('bm25', 'dense', 'llm') AND coalesce(score, rank) IS NOT NULL GROUP BY g, s, i
), valued AS (
  SELECT g, s, i, CASE WHEN count(score) OVER l = count(*) OVER l THEN score WHEN count(rank) OVER l = count(*) OVER l THEN -rank
                       ELSE coalesce(score, coalesce(min(score) OVER l, 0.0) - 1.0 - abs(rank)) END AS v
  FROM once WINDOW l AS (PARTITION BY g, s)
), ranked AS (
  SELECT g, s, i, rank() OVER (PARTITION BY g, s ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY g, s, v) AS ties, count(*) OVER (PARTITION BY g, s) AS n_list FROM valued
), items AS (SELECT DISTINCT g, i FROM ranked), sizes AS (SELECT g, count(*) AS n FROM items GROUP BY g),
lists AS (SELECT DISTINCT g, s, n_list FROM ranked),
grid AS (
  SELECT items.g, items.i, lists.s, sizes.n,
         CASE WHEN ranked.i IS NULL THEN (sizes.n - lists.n_list) / 2.0 / sizes.n
              ELSE ((sizes.n - lists.n_list + ranked.below)::DOUBLE + ranked.ties / 2.0) / sizes.n END AS p,
         ranked.i IS NOT NULL AS present
  FROM items JOIN sizes USING (g) JOIN lists USING (g) LEFT JOIN ranked ON ranked.g = items.g AND ranked.i = items.i AND ranked.s = lists.s
), parts AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2.0 * ln(p)) AS l, CASE WHEN p < 1 THEN sqrt(-2.0 * ln(1.0 - p)) END AS h FROM grid),
fused AS (SELECT g AS instance_id, i AS file_path, round(avg({QUANTILE}), 9) AS fused, count(*) FILTER (WHERE present) AS n_lists FROM parts GROUP BY g, i)
"""

P6_FOUND = P6_FUSED + "SELECT instance_id, arg_min(file_path, struct_pack(a := -fused, b := -n_lists, c := file_path)) AS file_path FROM fused GROUP BY instance_id"

P6_RANKING = P6_FUSED + "SELECT instance_id, file_path, fused, rank() OVER (PARTITION BY instance_id ORDER BY fused DESC) AS position FROM fused"

# Groups of these tables are cliques of similar rows, so the smallest id among a row's neighbours names its group.
P1_GROUPS = """
WITH c AS (
  SELECT concept_id, coalesce(repo, '') AS repo, list_distinct(list_filter(coalesce(member_function_ids, []), lambda m: m IS NOT NULL AND m <> '')) AS m, centroid
  FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY built_at DESC) AS k FROM concepts WHERE concept_id IS NOT NULL) WHERE k = 1
), t AS (SELECT concept_id, repo, len(m) AS n, unnest(m) AS m FROM c),
o AS (SELECT a.concept_id AS a, b.concept_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.repo = b.repo AND a.m = b.m AND a.concept_id <> b.concept_id GROUP BY ALL),
near AS (SELECT a, b FROM o WHERE (k >= 2 AND k >= 0.28 * (na + nb - k)) OR (k = na AND k = nb)),
g AS (SELECT concept_id, repo, least(concept_id, coalesce(min(b), concept_id)) AS grp FROM c LEFT JOIN near ON a = concept_id WHERE len(m) > 0 GROUP BY concept_id, repo),
v AS (
  SELECT concept_id, repo, len(m) AS n, list_transform(centroid::DOUBLE[], lambda x: x / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS v
  FROM c WHERE len(centroid) = 64 AND len(list_filter(centroid, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]) > 0
), s AS (SELECT q.concept_id AS q, r.concept_id AS r, r.n, list_dot_product(q.v, r.v) AS cos FROM v q JOIN v r ON q.repo = r.repo AND q.n = 0 AND q.concept_id <> r.concept_id WHERE list_dot_product(q.v, r.v) >= 0.85),
placed AS (SELECT q AS concept_id, arg_max(g.grp, cos) AS grp FROM s JOIN g ON g.concept_id = r GROUP BY q),
rest AS (SELECT v.concept_id, least(v.concept_id, coalesce(min(s.r), v.concept_id)) AS grp FROM v LEFT JOIN s ON s.q = v.concept_id AND s.n = 0 WHERE v.n = 0 AND v.concept_id NOT IN (SELECT concept_id FROM placed) GROUP BY v.concept_id),
every AS (SELECT concept_id, grp FROM g UNION ALL SELECT * FROM placed UNION ALL SELECT * FROM rest)
"""

P1_FOUND = P1_GROUPS + "SELECT a.concept_id AS concept_a, b.concept_id AS concept_b FROM every a JOIN every b ON a.grp = b.grp AND a.concept_id < b.concept_id"

# The density of a concept is the number of rows near its latest row, by members or, without any, by centroid.
P1_CLUSTERS = P1_GROUPS + """, lone AS (SELECT concept_id, grp FROM every UNION ALL SELECT concept_id, concept_id FROM c WHERE concept_id NOT IN (SELECT concept_id FROM every)),
named AS (SELECT concept_id, min(concept_id) OVER (PARTITION BY grp) AS cluster FROM lone),
every_row AS (
  SELECT concept_id, coalesce(repo, '') AS repo, label, list_sort(list_distinct(list_filter(coalesce(member_function_ids, []), lambda m: m IS NOT NULL AND m <> ''))) AS m, member_function_ids AS plain, centroid,
         coalesce(len(centroid) = 64 AND len(list_filter(centroid, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]) > 0, false) AS usable
  FROM concepts WHERE concept_id IS NOT NULL
), sets AS (SELECT repo, m, count(*) AS w, row_number() OVER (ORDER BY repo, m) AS s FROM every_row WHERE len(m) > 0 GROUP BY repo, m),
st AS (SELECT s, repo, w, len(m) AS n, unnest(m) AS m FROM sets),
so AS (SELECT a.s AS a, b.s AS b, b.w, a.n AS na, b.n AS nb, count(*) AS k FROM st a JOIN st b ON a.repo = b.repo AND a.m = b.m AND a.s <> b.s GROUP BY ALL),
sd AS (SELECT repo, m, w + coalesce((SELECT sum(so.w) FROM so WHERE so.a = sets.s AND k >= 2 AND k >= 0.28 * (na + nb - k)), 0) AS density FROM sets),
faces AS (SELECT repo, centroid, count(*) AS w, list_transform(centroid::DOUBLE[], lambda x: x / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS u FROM every_row WHERE len(m) = 0 AND usable GROUP BY repo, centroid),
fd AS (SELECT a.repo, a.centroid, sum(b.w) AS density FROM faces a JOIN faces b ON a.repo = b.repo AND (a.centroid = b.centroid OR list_dot_product(a.u, b.u) >= 0.85) GROUP BY a.repo, a.centroid),
cd AS (SELECT c.concept_id, coalesce(sd.density, fd.density, 1) AS density FROM c LEFT JOIN sd ON sd.repo = c.repo AND sd.m = list_sort(c.m) LEFT JOIN fd ON fd.repo = c.repo AND len(c.m) = 0 AND fd.centroid = c.centroid),
content AS (SELECT concept_id, max(struct_pack(l := lower(trim(label)), m := plain)) AS x FROM every_row GROUP BY concept_id),
lab AS (SELECT cluster, label FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k FROM (SELECT cluster, x.l AS label, count(*) AS n FROM named JOIN content USING (concept_id) WHERE x.l <> '' GROUP BY ALL)) WHERE k = 1),
mem AS (SELECT cluster, list(m ORDER BY k) AS typical_members FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, m) AS k FROM (SELECT cluster, m, count(*) AS n FROM (SELECT cluster, concept_id, unnest(list_distinct(x.m)) AS m FROM named JOIN content USING (concept_id)) WHERE m <> '' GROUP BY ALL)) WHERE k <= 5 GROUP BY cluster),
top AS (SELECT cluster, count(*) AS size, list(concept_id ORDER BY k) FILTER (WHERE k <= 5) AS typical_concepts FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY density DESC, concept_id) AS k FROM named JOIN cd USING (concept_id)) GROUP BY cluster)
SELECT cluster, size, label, typical_concepts, typical_members FROM top LEFT JOIN lab USING (cluster) LEFT JOIN mem USING (cluster)
"""

P8_KEPT = "SELECT lower(trim(source)) AS source, max(max_repeats)::INT AS max_repeats, true AS within_cap, true AS near_target FROM mix_targets WHERE source IS NOT NULL GROUP BY 1"

# Blanks, line ends and letters as Python's Unicode patterns have them.
BLANKS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
P9_COUNTS = rf"""
SELECT doc_id, length(t)::BIGINT AS n_chars, len(regexp_extract_all(t, '{LETTERS}(?:[''’]{LETTERS})?'))::BIGINT AS n_words,
       len(list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x{{0b}}\f\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{BLANKS}]')))::BIGINT AS n_lines,
       coalesce(list_max(list_transform(regexp_extract_all(t, '[^{BLANKS}]+'), lambda x: length(x))), 0)::BIGINT AS longest_word
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

ORACLES = {"p1_found": P1_FOUND, "p1_clusters": P1_CLUSTERS, "p4_found": P4_FOUND, "p4_rebuilt": P4_REBUILT, "p6_found": P6_FOUND, "p6_ranking": P6_RANKING, "p7_decoded": P7_DECODED, "p8_kept": P8_KEPT, "p9_counts": P9_COUNTS}
