"""Queries of joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import variants as V
from siteloom.operators import consensus as C
from siteloom.operators import joins as J
from siteloom.operators import models as M
from siteloom.operators import windows as W
from siteloom.plans.registry import query
from siteloom.plans.relations import CONTIG, genotypes, second_input, sites
from siteloom.plans.stats_queries import FISHER

TRIOS = [("S1", "S2", "S3"), ("S4", "S5", "S6")]

_G = """, i AS (SELECT chrom, pos, ref || '>' || array_to_string(alts, ',') AS what, 0 AS input, site_id FROM site UNION ALL SELECT chrom, pos, ref || '>' || array_to_string(alts, ','), 1, site_id FROM site2),
p AS (SELECT chrom, pos, what, input, min(site_id) AS site_id FROM i GROUP BY ALL),
g AS (SELECT chrom, pos, what, CAST(sum(1 << input) AS BIGINT) AS mask, count(*) AS n FROM p GROUP BY chrom, pos, what)
"""


def both(spark: SparkSession, d: str) -> list[DataFrame]:
    return [sites(spark, d), second_input(spark, d)]


@query(_G + "SELECT chrom, pos, what, mask FROM g")
def isec_bitmap(spark: SparkSession, d: str) -> DataFrame:
    return J.groups(both(spark, d)).select("chrom", "pos", "what", "mask")


@query(_G + "SELECT chrom, pos, what FROM g WHERE n = 2")
def isec_n2(spark: SparkSession, d: str) -> DataFrame:
    return J.in_exactly(J.groups(both(spark, d)), 2).select("chrom", "pos", "what")


@query("SELECT site_id FROM site s WHERE NOT EXISTS (SELECT 1 FROM site2 t WHERE t.chrom = s.chrom AND t.pos = s.pos AND t.ref = s.ref AND t.alts = s.alts)")
def isec_complement(spark: SparkSession, d: str) -> DataFrame:
    a, b = both(spark, d)
    return J.only_first(a, [b]).select("site_id")


@query(_G + "SELECT chrom, pos, what FROM g WHERE mask = 2")
def isec_exact_mask(spark: SparkSession, d: str) -> DataFrame:
    return J.with_mask(J.groups(both(spark, d)), "01").select("chrom", "pos", "what")


@query(_G + "SELECT p.site_id FROM p JOIN g ON p.chrom = g.chrom AND p.pos = g.pos AND p.what = g.what WHERE g.n >= 2 AND p.input = 1")
def isec_write(spark: SparkSession, d: str) -> DataFrame:
    inputs = both(spark, d)
    return J.write_input(J.in_at_least(J.groups(inputs), 2), inputs, 1).select("site_id")


@query(""", c AS (SELECT *, CASE kind WHEN 'none' THEN 'other' WHEN 'sym' THEN 'other' WHEN 'snp' THEN 'snp' WHEN 'mnp' THEN 'other' ELSE 'indel' END AS k, 0 AS input FROM site
  UNION ALL SELECT *, CASE WHEN site_id % 8 = 1 THEN 'indel' WHEN kind IN ('none', 'sym', 'mnp') THEN 'other' WHEN kind = 'snp' THEN 'snp' ELSE 'indel' END, 1 FROM site2),
q AS (SELECT chrom, pos, CASE WHEN k IN ('snp', 'indel') THEN k ELSE ref || '>' || array_to_string(alts, ',') END AS what, count(DISTINCT input) AS n FROM c GROUP BY 1, 2, 3) SELECT chrom, pos, what FROM q WHERE n = 2""")
def isec_collapse_both(spark: SparkSession, d: str) -> DataFrame:
    return J.in_exactly(J.groups(both(spark, d), "both"), 2).select("chrom", "pos", "what")


_U = """, u AS (SELECT *, 0 AS input FROM site UNION ALL SELECT *, 1 FROM site2), m AS (SELECT chrom, pos, ref, array_to_string(alts, ',') AS alt, string_agg(DISTINCT id, ';' ORDER BY id) AS id, max(qual) AS qual,
  list_sort(list_distinct(flatten(list(filters)))) AS f, CAST(sum(dp) AS BIGINT) AS dp, count(DISTINCT input) AS n_inputs FROM u GROUP BY chrom, pos, ref, array_to_string(alts, ','))
"""


@query(_U + "SELECT chrom, pos, ref, alt, n_inputs FROM m")
def merge_exact(spark: SparkSession, d: str) -> DataFrame:
    return J.merge_exact(both(spark, d)).select("chrom", "pos", "ref", "alt", "n_inputs")


@query(_U + "SELECT chrom, pos, ref, alt, coalesce(id, '') AS id, qual, dp, CASE WHEN len(list_filter(f, lambda x: x <> 'PASS')) > 0 THEN array_to_string(list_filter(f, lambda x: x <> 'PASS'), ';') ELSE 'PASS' END AS filter FROM m")
def merge_field_rules(spark: SparkSession, d: str) -> DataFrame:
    return J.merge_exact(both(spark, d)).select("chrom", "pos", "ref", "alt", "id", "qual", "dp", "filter")


@query(", s AS (SELECT DISTINCT sample, ploidy FROM gt), x AS (SELECT t.site_id, s.sample, CASE WHEN g.site_id IS NULL THEN 0 ELSE g.a0 END AS a0, CASE WHEN s.ploidy = 1 THEN NULL WHEN g.site_id IS NULL THEN 0 ELSE g.a1 END AS a1 FROM site t CROSS JOIN s LEFT JOIN gt g ON g.site_id = t.site_id AND g.sample = s.sample) SELECT site_id, sample, (a0 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT AS n_called, coalesce(a0 > 0, false)::INT + coalesce(a1 > 0, false)::INT AS n_alt FROM x")
def merge_missing_to_ref(spark: SparkSession, d: str) -> DataFrame:
    g = J.merge_samples(sites(spark, d), [genotypes(spark, d)], missing_to_ref=True)
    return g.select("site_id", "sample", F.size(G.called(F.col("alleles"))).alias("n_called"), F.size(F.filter("alleles", lambda a: a > 0)).alias("n_alt"))


@query(""", u AS (SELECT *, 0 AS input FROM site UNION ALL SELECT *, 1 FROM site2), l AS (SELECT chrom, pos, max(length(ref)) AS n FROM u GROUP BY chrom, pos),
h AS (SELECT u.chrom, u.pos, max(u.ref) AS ref FROM u JOIN l ON u.chrom = l.chrom AND u.pos = l.pos AND length(u.ref) = l.n GROUP BY u.chrom, u.pos),
g AS (SELECT u.*, h.ref AS top, bool_and(starts_with(h.ref, u.ref)) OVER (PARTITION BY u.chrom, u.pos) AS fit FROM u JOIN h ON u.chrom = h.chrom AND u.pos = h.pos),
r AS (SELECT *, CASE WHEN fit THEN '' ELSE input || ' ' || site_id END AS part, CASE WHEN fit THEN top ELSE ref END AS mref FROM g),
a AS (SELECT chrom, pos, part, mref, input, site_id, unnest(range(len(alts))) AS i, unnest(alts) AS x, ref FROM r),
p AS (SELECT chrom, pos, part, mref, CASE WHEN starts_with(x, '<') THEN x ELSE x || substr(mref, length(ref) + 1) END AS x, min(input * 1e12 + site_id * 10 + i) AS o FROM a GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT chrom, pos, part, string_agg(x, ',' ORDER BY o) AS alt FROM p GROUP BY chrom, pos, part), n AS (SELECT chrom, pos, part, mref, count(*) AS n_inputs FROM r GROUP BY chrom, pos, part, mref)
SELECT n.chrom, n.pos, n.mref AS ref, coalesce(s.alt, '') AS alt, CAST(n.n_inputs AS INT) AS n_inputs FROM n LEFT JOIN s ON n.chrom = s.chrom AND n.pos = s.pos AND n.part = s.part""")
def merge_union_alts(spark: SparkSession, d: str) -> DataFrame:
    m = J.merge_alleles(both(spark, d))
    return m.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), F.size("maps").alias("n_inputs"))


@query(""", b AS (SELECT chrom, pos, "end" FROM site WHERE kind = 'sym' UNION ALL SELECT chrom, pos + 3, "end" + 5 FROM site WHERE kind = 'sym' AND site_id % 2 = 0),
e AS (SELECT chrom, pos AS p FROM b UNION SELECT chrom, "end" + 1 FROM b), s AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) - 1 AS "end" FROM e)
SELECT s.chrom, s.start, s."end", count(*) AS depth FROM s JOIN b ON b.chrom = s.chrom AND b.pos <= s.start AND b."end" >= s."end" GROUP BY ALL""")
def interval_split(spark: SparkSession, d: str) -> DataFrame:
    a = sites(spark, d).where("end is not null").select("site_id", "chrom", "pos", "end")
    b = a.where("site_id % 2 = 0").select("chrom", (F.col("pos") + 3).alias("pos"), (F.col("end") + 5).alias("end"))
    return J.split_at_breaks(a.select("chrom", "pos", "end").union(b))


@query(""", l AS (SELECT chrom, pos, ref, alts, count(*) AS n FROM site GROUP BY ALL), r AS (SELECT chrom, pos, ref, alts, count(*) AS n FROM site2 GROUP BY ALL)
SELECT CAST(sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) AS BIGINT) AS both, CAST(sum(greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0)) AS BIGINT) AS left_only, CAST(sum(greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0)) AS BIGINT) AS right_only
FROM l FULL JOIN r ON l.chrom = r.chrom AND l.pos = r.pos AND l.ref = r.ref AND l.alts = r.alts""")
def stats_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return J.pairwise(*both(spark, d))


@query(""", b AS (SELECT site_id, sample, a0 AS b0, CASE WHEN sample_id = 2 THEN 0 ELSE a1 END AS b1 FROM gt WHERE site_id % 2 = 0 AND ploidy = 2), x AS (SELECT g.site_id, g.sample, b.site_id IS NULL OR (list_sort([a0, a1]) = list_sort([b0, b1])) AS same, (a0 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT AS c FROM gt g LEFT JOIN b ON g.site_id = b.site_id AND g.sample = b.sample)
SELECT site_id, sample, CAST(CASE WHEN same THEN c ELSE 0 END AS INT) AS n_called FROM x""")
def isec_gt(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d)
    other = g.where("site_id % 2 = 0 and size(alleles) = 2").withColumn("alleles", F.when(F.col("sample_id") == 2, F.array(F.get("alleles", F.lit(0)), F.lit(0))).otherwise(F.col("alleles")))
    return J.isec_gt(g, other).select("site_id", "sample", F.size(G.called(F.col("alleles"))).alias("n_called"))


_TRIO = """, t AS (SELECT c.site_id, i AS trio, c.a0 AS c0, c.a1 AS c1, f.a0 AS f0, f.a1 AS f1, m.a0 AS m0, m.a1 AS m1 FROM (VALUES (0, 1, 2, 3), (1, 4, 5, 6)) v(i, a, b, e)
  JOIN gt c ON c.sample_id = a JOIN gt f ON f.sample_id = b AND f.site_id = c.site_id JOIN gt m ON m.sample_id = e AND m.site_id = c.site_id),
s AS (SELECT *, CASE WHEN c0 IS NULL OR c1 IS NULL OR f0 IS NULL OR f1 IS NULL OR m0 IS NULL OR m1 IS NULL THEN 'miss' WHEN NOT ((c0 IN (f0, f1) AND c1 IN (m0, m1)) OR (c1 IN (f0, f1) AND c0 IN (m0, m1))) THEN 'err'
  WHEN greatest(c0, c1, f0, f1, m0, m1) > 0 THEN 'good_alt' ELSE 'good' END AS state FROM t)
"""


@query(_TRIO + "SELECT site_id, CAST(trio AS INT) AS trio FROM s WHERE state = 'err'")
def mendel_errors(spark: SparkSession, d: str) -> DataFrame:
    return J.mendel(J.trio_rows(genotypes(spark, d), TRIOS)).where("state = 'err'").select("site_id", "trio")


@query(_TRIO + "SELECT CAST(trio AS INT) AS trio, count(*) FILTER (state = 'good') AS good, count(*) FILTER (state = 'good_alt') AS good_alt, count(*) FILTER (state = 'err') AS err, count(*) FILTER (state = 'miss') AS miss FROM s GROUP BY trio")
def mendelian_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.mendel_counts(J.trio_rows(genotypes(spark, d), TRIOS))


@query(_TRIO + """, x AS (SELECT s.*, o.kind = 'snp' AND o.ref || o.alts[1] IN ('AG', 'GA', 'CT', 'TC') AS ts, o.kind = 'snp' AND o.ref || o.alts[1] NOT IN ('AG', 'GA', 'CT', 'TC') AS tv, state IN ('good_alt', 'err') AND greatest(c0, c1, f0, f1, m0, m1) > 0 AS nonref,
  state <> 'miss' AND ((c0 > 0 AND c0 NOT IN (f0, f1, m0, m1)) OR (c1 > 0 AND c1 NOT IN (f0, f1, m0, m1))) AS novel FROM s JOIN site o ON s.site_id = o.site_id)
SELECT CAST(trio AS INT) AS trio, count(*) FILTER (state <> 'miss') AS n_pass, count(*) FILTER (nonref) AS nonref, count(*) FILTER (state = 'err') AS errors, count(*) FILTER (novel) AS novel, count(*) FILTER (nonref AND ts) AS ts, count(*) FILTER (nonref AND tv) AS tv FROM x GROUP BY trio""")
def trio_stats(spark: SparkSession, d: str) -> DataFrame:
    return J.trio_stats(J.trio_rows(genotypes(spark, d), TRIOS), sites(spark, d))


@query(_TRIO + "SELECT site_id, CAST(trio AS INT) AS trio FROM s WHERE state = 'err' AND trio = 0")
def dnm_naive(spark: SparkSession, d: str) -> DataFrame:
    return J.de_novo_naive(J.trio_rows(genotypes(spark, d), TRIOS[:1])).select("site_id", "trio")


@query(_TRIO + """, p AS (SELECT t.trio, o.chrom, o.pos, o.site_id, CASE WHEN c0 IN (f0, f1) AND c1 IN (m0, m1) AND NOT (c1 IN (f0, f1) AND c0 IN (m0, m1)) THEN 1 WHEN c1 IN (f0, f1) AND c0 IN (m0, m1) AND NOT (c0 IN (f0, f1) AND c1 IN (m0, m1)) THEN 0 END AS phase
  FROM t JOIN site o ON t.site_id = o.site_id WHERE c0 <> c1 AND f0 IS NOT NULL AND f1 IS NOT NULL AND m0 IS NOT NULL AND m1 IS NOT NULL),
q AS (SELECT *, lag(phase) OVER (PARTITION BY trio, chrom ORDER BY pos, site_id) AS was FROM p WHERE phase IS NOT NULL)
SELECT CAST(trio AS INT) AS trio, count(*) AS informative, count(*) FILTER (phase <> was) AS switches FROM q GROUP BY trio""")
def switch_rate(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d)
    t = J.trio_rows(g, TRIOS)
    full = lambda c: F.forall(c, lambda a: a.isNotNull())
    s = sites(spark, d)
    return J.switch_rate(t.where(full("child") & full("father") & full("mother")), s, s.select("site_id"))


@query(", t AS (SELECT x.site_id, CAST(x.sample_id // 2 AS INT) AS pair, x.ad0 AS a, x.ad1 AS b, y.ad0 AS c, y.ad1 AS d FROM gt x JOIN gt y ON x.site_id = y.site_id AND y.sample_id = x.sample_id + 1 WHERE x.sample_id IN (1, 3))" + FISHER.format(keys="site_id, pair"))
def ad_bias(spark: SparkSession, d: str) -> DataFrame:
    return J.pair_bias(genotypes(spark, d), [("S1", "S2"), ("S3", "S4")]).withColumn("p", F.round("p", 6))


@query(""", e AS (SELECT *, pos + length(ref) - 1 AS e, coalesce(qual, 0) AS q FROM site)
SELECT site_id FROM e s WHERE NOT EXISTS (SELECT 1 FROM e t WHERE t.chrom = s.chrom AND t.site_id <> s.site_id AND t.pos <= s.e AND t.e >= s.pos AND (t.q > s.q OR (t.q = s.q AND (t.pos < s.pos OR (t.pos = s.pos AND t.site_id < s.site_id)))))""")
def overlap_min_qual(spark: SparkSession, d: str) -> DataFrame:
    return J.overlap_min_qual(sites(spark, d)).select("site_id")


@query(""", n AS (SELECT site_id, sample, coalesce(a0 > 0, false)::INT + coalesce(a1 > 0, false)::INT AS x FROM gt WHERE a0 IS NOT NULL AND (ploidy = 1 OR a1 IS NOT NULL)),
q AS (SELECT s.site_id AS a, t.site_id AS b FROM site s JOIN site t ON s.chrom = t.chrom AND t.pos - s.pos <= 20 AND (t.pos > s.pos OR (t.pos = s.pos AND t.site_id > s.site_id))),
m AS (SELECT q.a, q.b, count(*) AS n, sum(u.x) AS sx, sum(v.x) AS sy, sum(u.x * u.x) AS sxx, sum(v.x * v.x) AS syy, sum(u.x * v.x) AS sxy FROM q JOIN n u ON u.site_id = q.a JOIN n v ON v.site_id = q.b AND u.sample = v.sample GROUP BY q.a, q.b)
SELECT a, b, CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE) AS r2 FROM m WHERE n * sxx > sx * sx AND n * syy > sy * sy""")
def ld_r2(spark: SparkSession, d: str) -> DataFrame:
    return J.ld_r2(genotypes(spark, d), sites(spark, d), 20)


_DIST = """, p AS (SELECT DISTINCT chrom, pos FROM site), w AS (SELECT chrom, pos, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS dist_back, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) - pos AS dist_fwd FROM p)
"""


@query(_DIST + "SELECT site_id, least(dist_back, dist_fwd) AS dist_near FROM site s JOIN w ON s.chrom = w.chrom AND s.pos = w.pos")
def variant_distance_nearest(spark: SparkSession, d: str) -> DataFrame:
    return W.variant_distance(sites(spark, d)).select("site_id", "dist_near")


@query(_DIST + "SELECT site_id, coalesce(dist_back, 0) AS dist_back, coalesce(dist_fwd, 0) AS dist_fwd FROM site s JOIN w ON s.chrom = w.chrom AND s.pos = w.pos")
def variant_distance_both(spark: SparkSession, d: str) -> DataFrame:
    return W.variant_distance(sites(spark, d)).select("site_id", F.coalesce("dist_back", F.lit(0)).alias("dist_back"), F.coalesce("dist_fwd", F.lit(0)).alias("dist_fwd"))


@query(""", c AS (SELECT site_id, chrom, pos, sum(CASE WHEN list_contains(filters, 'PASS') THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 99 FOLLOWING) AS n FROM site)
SELECT site_id, CAST(max(n) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_cluster FROM c""")
def cluster_size(spark: SparkSession, d: str) -> DataFrame:
    return W.cluster_size(sites(spark, d), 100, F.array_contains("filters", "PASS")).select("site_id", "n_cluster")


_ISLE = """, e AS (SELECT *, coalesce("end", pos + length(ref) - 1) AS e FROM site), n AS (SELECT *, CASE WHEN pos - max(e) OVER (PARTITION BY chrom ORDER BY pos, site_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS nw FROM e),
i AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY pos, site_id ROWS UNBOUNDED PRECEDING) AS isle FROM n)
"""


@query(_ISLE + "SELECT site_id, count(*) OVER (PARTITION BY chrom, isle) > 1 AS overlaps FROM i")
def overlaps_simple(spark: SparkSession, d: str) -> DataFrame:
    return W.overlapping(sites(spark, d), V.end(F.col("pos"), F.col("ref"), F.col("end"))).select("site_id", "overlaps")


@query("SELECT site_id, count(*) OVER (PARTITION BY chrom, pos) > 1 AS dup FROM site")
def dup_positions(spark: SparkSession, d: str) -> DataFrame:
    return W.duplicated(sites(spark, d)).select("site_id", "dup")


@query(""", c AS (SELECT g.ploidy AS pl, g.sample, s.chrom, s.pos, s.site_id FROM gt g JOIN site s ON g.site_id = s.site_id WHERE a0 IS NOT NULL OR a1 IS NOT NULL),
l AS (SELECT *, lag(pl) OVER (PARTITION BY sample, chrom ORDER BY pos, site_id) AS was FROM c), r AS (SELECT *, sum(CASE WHEN was = pl THEN 0 ELSE 1 END) OVER (PARTITION BY sample, chrom ORDER BY pos, site_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT sample, chrom, CAST(pl AS INT) AS ploidy, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM r GROUP BY sample, chrom, run, pl""")
def check_ploidy(spark: SparkSession, d: str) -> DataFrame:
    return W.ploidy_runs(genotypes(spark, d).join(sites(spark, d).select("site_id", "chrom", "pos"), "site_id"))


@query(""", b AS (SELECT chrom, pos, site_id, pos AS e, dp, dp // 20 AS g FROM site), l AS (SELECT *, lag(g) OVER (PARTITION BY chrom ORDER BY pos, site_id) AS was FROM b),
r AS (SELECT *, sum(CASE WHEN was IS NOT DISTINCT FROM g THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos, site_id ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT chrom, min(pos) AS start, max(e) AS "end", CAST(g AS BIGINT) AS grp, min(dp) AS min_dp, count(*) AS n FROM r GROUP BY chrom, block, g""")
def gvcf_compress(spark: SparkSession, d: str) -> DataFrame:
    rows = sites(spark, d).withColumn("end", F.col("pos")).withColumn("gq", F.col("dp"))
    return W.gvcf_blocks(rows, F.floor(F.col("dp") / 20)).select("chrom", "start", "end", "grp", "min_dp", "n")


@query("SELECT site_id, chrom, pos FROM site")
def sort_sites(spark: SparkSession, d: str) -> DataFrame:
    return J.sort_sites(sites(spark, d)).select("site_id", "chrom", "pos")


@query(""", x AS (SELECT site_id, sample, a, p FROM (SELECT site_id, sample, 1 AS a, gq AS p FROM gt UNION ALL SELECT site_id, sample, 2, dp FROM gt UNION ALL SELECT site_id, sample, 3, ad1 FROM gt)), r AS (SELECT *, row_number() OVER (PARTITION BY site_id, sample ORDER BY p DESC, a) AS rank FROM x)
SELECT site_id, sample, CAST(a AS INT) AS allele, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def topk_local_alleles(spark: SparkSession, d: str) -> DataFrame:
    p = F.explode(F.array(F.struct(F.lit(1).alias("allele"), F.col("gq").alias("p")), F.struct(F.lit(2).alias("allele"), F.col("dp").alias("p")), F.struct(F.lit(3).alias("allele"), F.get("ad", F.lit(1)).alias("p"))))
    return J.top_local_alleles(genotypes(spark, d).select("site_id", "sample", p.alias("x")).select("site_id", "sample", "x.*"), 2).select("site_id", "sample", "allele", "rank")


@query("SELECT 0 AS input, site_id FROM site UNION ALL SELECT 1, site_id FROM site2")
def concat_all(spark: SparkSession, d: str) -> DataFrame:
    return J.concat(both(spark, d)).select("input", "site_id")


_CC = ", u AS (SELECT *, 0 AS input FROM site UNION ALL SELECT *, 1 FROM site2), r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos{0} ORDER BY input, site_id) AS nth FROM u) SELECT CAST(input AS INT) AS input, site_id FROM r WHERE nth = 1"


@query(_CC.format(", ref, alts"))
def concat_rmdup_exact(spark: SparkSession, d: str) -> DataFrame:
    return J.concat(both(spark, d), "exact").select("input", "site_id")


@query(_CC.format(""))
def concat_rmdup_all(spark: SparkSession, d: str) -> DataFrame:
    return J.concat(both(spark, d), "all").select("input", "site_id")


@query(_CC.format(", CASE WHEN kind = 'snp' AND (input = 0 OR site_id % 8 <> 1) THEN 'snp' ELSE ref || '>' || array_to_string(alts, ',') END"))
def concat_rmdup_snps(spark: SparkSession, d: str) -> DataFrame:
    return J.concat(both(spark, d), "snps").select("input", "site_id")


@query(", r AS (SELECT site_id, row_number() OVER (PARTITION BY chrom, pos, ref, list_sort(alts) ORDER BY site_id) AS nth FROM (SELECT * FROM site UNION ALL SELECT * REPLACE (site_id + 1000000 AS site_id) FROM site WHERE site_id % 4 = 0)) SELECT site_id FROM r WHERE nth = 1")
def norm_rmdup_exact(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    more = s.where("site_id % 4 = 0").withColumn("site_id", F.col("site_id") + 1000000)
    return J.concat([s.union(more).withColumn("alts", F.array_sort("alts"))], "exact").select("site_id")


@query("SELECT site_id, array_to_string(alts, ',') AS alt, len(alts) AS n_rows FROM site WHERE len(alts) > 0 AND site_id NOT IN (SELECT s.site_id FROM site s JOIN site t ON s.chrom = t.chrom AND s.pos = t.pos AND s.site_id <> t.site_id)")
def join_multiallelic(spark: SparkSession, d: str) -> DataFrame:
    from siteloom.operators.rewrite import join_multiallelic, split_multiallelic

    s = W.duplicated(sites(spark, d)).where("not dup").drop("dup")
    return join_multiallelic(split_multiallelic(s).where("alt_index > 0")).select("site_id", F.array_join("alts", ",").alias("alt"), "n_rows")


@query(""", v AS (SELECT chrom, pos, alts[1] AS alt FROM site WHERE kind = 'snp'), d AS (SELECT chrom, pos, min(alt) AS alt FROM v GROUP BY chrom, pos),
b AS (SELECT c.chrom, p.pos, coalesce(d.alt, substr('ACGT', 1 + p.pos % 4, 1)) AS b FROM (SELECT DISTINCT chrom FROM site) c CROSS JOIN (SELECT unnest(range(1, 100001)) AS pos) p LEFT JOIN d ON d.chrom = c.chrom AND d.pos = p.pos)
SELECT chrom, string_agg(b, '' ORDER BY pos) AS seq FROM b GROUP BY chrom""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    every = sites(spark, d)
    v = every.where(V.class_label(V.variant_class(F.col("ref"), F.col("alts"))) == "snp").groupBy("chrom", "pos").agg(F.min(F.get("alts", F.lit(0))).alias("alt"))
    base = F.expr("substring('ACGT', cast(1 + pos % 4 as int), 1)")
    return C.consensus_of(C.synthetic_reference(every.select("chrom").distinct(), CONTIG, base), v.withColumn("ref", base))


#: The 27 genotype combinations of a trio: copies, prior with mutations, and whether Mendel's rules forbid them.
_DNM = """, one(f, x, p, m) AS (VALUES (0, 0, 1 - 1e-8, 1.0), (0, 1, 1e-8, 0.0), (1, 0, 0.5, 0.5), (1, 1, 0.5, 0.5), (2, 0, 1e-8, 0.0), (2, 1, 1 - 1e-8, 1.0)),
pr(f, p) AS (VALUES (0, (1 - 1e-3) * (1 - 1e-3)), (1, 2 * 1e-3 * (1 - 1e-3)), (2, 1e-3 * 1e-3)),
tr AS (SELECT a.f, b.f AS m, a.x + b.x AS c, CAST(sum(a.p * b.p) AS DOUBLE) AS p, sum(a.m * b.m) = 0 AS nw FROM one a CROSS JOIN one b GROUP BY a.f, b.f, a.x + b.x),
ll AS (SELECT site_id, sample_id, [ad0 * ln(0.99::DOUBLE) + ad1 * ln(0.01::DOUBLE), (ad0 + ad1) * ln(0.5::DOUBLE), ad0 * ln(0.01::DOUBLE) + ad1 * ln(0.99::DOUBLE)] AS l FROM gt),
pl AS (SELECT site_id, sample_id, list_transform(l, lambda x: round(-4.34294481903::DOUBLE * (x - list_max(l)))) AS l FROM ll),
ev AS (SELECT c.site_id, i AS trio, tr.nw, tr.p * q.p * r.p * pow(10::DOUBLE, -(c.l[tr.c + 1] + f.l[tr.f + 1] + m.l[tr.m + 1]) / 10) AS p FROM (VALUES (0, 1, 2, 3), (1, 4, 5, 6)) v(i, a, b, e)
  JOIN pl c ON c.sample_id = a JOIN pl f ON f.sample_id = b AND f.site_id = c.site_id JOIN pl m ON m.sample_id = e AND m.site_id = c.site_id CROSS JOIN tr JOIN pr q ON q.f = tr.f JOIN pr r ON r.f = tr.m)
SELECT site_id, CAST(trio AS INT) AS trio, round(sum(p) FILTER (nw) / sum(p), 9) AS p FROM ev GROUP BY site_id, trio"""


@query(_DNM)
def trio_dnm(spark: SparkSession, d: str) -> DataFrame:
    return M.de_novo_posterior(M.with_likelihoods(genotypes(spark, d)), TRIOS).withColumn("p", F.round("p", 9))


@query(""", f AS (SELECT site_id, CAST(count(*) FILTER (a > 0) AS DOUBLE) / count(a) AS q FROM al WHERE a IS NOT NULL GROUP BY site_id),
p AS (SELECT sample, CASE WHEN ploidy = 2 AND (a0 > 0) <> (a1 > 0) THEN 0.01 WHEN a0 > 0 THEN q * 0.99 ELSE (1 - q) * 0.99 END AS hap, CASE WHEN ploidy = 2 AND (a0 > 0) <> (a1 > 0) THEN 2 * q * (1 - q) WHEN a0 > 0 THEN q * q ELSE (1 - q) * (1 - q) END AS dip
  FROM gt g JOIN f ON g.site_id = f.site_id WHERE q > 0 AND q < 1 AND a0 IS NOT NULL AND (ploidy = 1 OR a1 IS NOT NULL))
SELECT sample, count(*) AS n, round(avg(ln(hap)), 6) AS haploid, round(avg(ln(dip)), 6) AS diploid, CASE WHEN avg(ln(hap)) > avg(ln(dip)) THEN 'M' WHEN avg(ln(hap)) < avg(ln(dip)) THEN 'F' ELSE 'U' END AS sex FROM p GROUP BY sample""")
def guess_ploidy_gt(spark: SparkSession, d: str) -> DataFrame:
    return M.guess_ploidy(genotypes(spark, d)).withColumn("haploid", F.round("haploid", 6)).withColumn("diploid", F.round("diploid", 6))


@query(_TRIO + """, o AS (SELECT t.trio, t.site_id, f0 = 1 AS father, g.ad0 AS r, g.ad1 AS v FROM t JOIN gt g ON g.site_id = t.site_id AND g.sample_id = 1 + 3 * trio WHERE (f0 = 1 AND f1 = 1 AND m0 = 0 AND m1 = 0) OR (f0 = 0 AND f1 = 0 AND m0 = 1 AND m1 = 1))
SELECT CAST(trio AS INT) AS trio, count(*) AS n, round(sum(CASE WHEN father THEN v * ln(2 / 3.0::DOUBLE) + r * ln(1 - 2 / 3.0::DOUBLE) ELSE v * ln(1 / 3.0::DOUBLE) + r * ln(1 - 1 / 3.0::DOUBLE) END), 6) AS paternal,
  round(sum(CASE WHEN father THEN v * ln(1 / 3.0::DOUBLE) + r * ln(1 - 1 / 3.0::DOUBLE) ELSE v * ln(2 / 3.0::DOUBLE) + r * ln(1 - 2 / 3.0::DOUBLE) END), 6) AS maternal FROM o GROUP BY trio""")
def parental_origin(spark: SparkSession, d: str) -> DataFrame:
    out = M.parental_origin(genotypes(spark, d), TRIOS)
    return out.withColumn("paternal", F.round("paternal", 6)).withColumn("maternal", F.round("maternal", 6))


@query(""", o AS (SELECT chrom, pos, site_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, site_id) AS n FROM site),
walk(chrom, n, older, last, site_id, kept) AS (SELECT DISTINCT chrom, CAST(0 AS BIGINT), CAST(-1000 AS BIGINT), CAST(-1000 AS BIGINT), CAST(NULL AS BIGINT), false FROM site
  UNION ALL SELECT o.chrom, o.n, CASE WHEN o.pos - w.older >= 100 THEN w.last ELSE w.older END, CASE WHEN o.pos - w.older >= 100 THEN o.pos ELSE w.last END, o.site_id, o.pos - w.older >= 100 FROM walk w JOIN o ON o.chrom = w.chrom AND o.n = w.n + 1)
SELECT site_id FROM walk WHERE kept""", recursive=True)
def prune_sites(spark: SparkSession, d: str) -> DataFrame:
    return M.prune(sites(spark, d), 100, 2).select("site_id")
