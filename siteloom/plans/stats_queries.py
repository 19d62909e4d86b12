"""Queries of statistics and computed tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import prob
from siteloom.operators import filters as FL
from siteloom.operators import stats as S
from siteloom.operators import tags as T
from siteloom.plans.registry import query
from siteloom.plans.relations import genotypes, regions, sites

_ALT = """, alt AS (SELECT *, unnest(alts) AS alt, unnest(range(len(alts))) AS nth FROM site),
ts AS (SELECT *, kind = 'snp' AND ref || alt IN ('AG', 'GA', 'CT', 'TC') AS ts, kind = 'snp' AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC') AS tv FROM alt)
"""
_SN = """count(*) AS records, count(*) FILTER (kind = 'none') AS no_alts, count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (kind = 'mnp') AS mnps, count(*) FILTER (kind IN ('ins', 'del')) AS indels,
  count(*) FILTER (kind = 'sym') AS others, count(*) FILTER (len(alts) > 1) AS multiallelic, count(*) FILTER (len(alts) > 1) AS multiallelic_snps"""


@query(f"SELECT {_SN} FROM site")
def stats_sn(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(sites(spark, d))


@query(f"SELECT id IS NOT NULL AS known, {_SN} FROM site GROUP BY id IS NOT NULL")
def stats_sn_by_id(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(sites(spark, d).withColumn("known", F.col("id").isNotNull()), ["known"])


@query(_ALT + "SELECT count(*) FILTER (ts) AS ts, count(*) FILTER (tv) AS tv, count(*) FILTER (ts AND nth = 0) AS ts_1st, count(*) FILTER (tv AND nth = 0) AS tv_1st, CAST(count(*) FILTER (ts) AS DOUBLE) / count(*) FILTER (tv) AS ratio, CAST(count(*) FILTER (ts AND nth = 0) AS DOUBLE) / count(*) FILTER (tv AND nth = 0) AS ratio_1st FROM ts")
def stats_tstv(spark: SparkSession, d: str) -> DataFrame:
    return S.tstv(sites(spark, d))


@query(_ALT + "SELECT type, count(alt.site_id) AS n FROM (SELECT a || '>' || b AS type FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(a), (VALUES ('A'), ('C'), ('G'), ('T')) y(b) WHERE a <> b) t LEFT JOIN alt ON kind = 'snp' AND ref || '>' || alt = type GROUP BY type")
def stats_st(spark: SparkSession, d: str) -> DataFrame:
    return S.substitutions(sites(spark, d))


@query(_ALT + ", b AS (SELECT *, CASE WHEN site_id % 100 <= 10 THEN 0 WHEN site_id % 100 <= 50 THEN 1 WHEN site_id % 100 <= 90 THEN 2 ELSE 3 END AS bin FROM alt) SELECT bin, count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (kind IN ('ins', 'del')) AS indels, count(*) FILTER (kind IN ('mnp', 'sym')) AS others FROM b GROUP BY bin")
def stats_af(spark: SparkSession, d: str) -> DataFrame:
    return S.by_frequency_bin(sites(spark, d), (F.col("site_id") % 100) / 100.0, [0.1, 0.5, 0.9])


@query(_ALT + "SELECT qual, count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (ts) AS ts, count(*) FILTER (tv) AS tv, count(*) FILTER (kind IN ('ins', 'del')) AS indels FROM ts GROUP BY qual")
def stats_qual(spark: SparkSession, d: str) -> DataFrame:
    return S.by_quality(sites(spark, d))


@query(""", i AS (SELECT site_id, CASE kind WHEN 'ins' THEN 2 ELSE -2 END AS length FROM site WHERE kind IN ('ins', 'del')),
c AS (SELECT length, count(*) AS genotypes, sum(CASE WHEN dp > 0 THEN CAST(ad1 AS DOUBLE) / dp END) AS s, count(CASE WHEN dp > 0 THEN 1 END) AS n FROM i JOIN gt ON i.site_id = gt.site_id WHERE a0 = 1 OR a1 = 1 GROUP BY length),
l AS (SELECT length, count(*) AS sites FROM i GROUP BY length)
SELECT CAST(l.length AS INT) AS length, l.sites, c.genotypes, round(c.s / c.n, 9) AS mean_vaf FROM l JOIN c ON l.length = c.length""")
def stats_idd(spark: SparkSession, d: str) -> DataFrame:
    return S.indel_lengths(sites(spark, d), genotypes(spark, d)).withColumn("mean_vaf", F.round("mean_vaf", 9))


@query(""", g AS (SELECT CASE WHEN dp < 5 THEN 0 WHEN dp > 45 THEN 10 ELSE (dp - 5) // 5 + 1 END AS bin, count(*) AS n FROM gt GROUP BY 1),
s AS (SELECT CASE WHEN dp < 5 THEN 0 WHEN dp > 45 THEN 10 ELSE (dp - 5) // 5 + 1 END AS bin, count(*) AS n FROM site GROUP BY 1)
SELECT CAST(coalesce(g.bin, s.bin) AS INT) AS bin, coalesce(g.n, 0) AS genotypes, 100.0::DOUBLE * coalesce(g.n, 0) / sum(g.n) OVER () AS genotypes_pct, coalesce(s.n, 0) AS sites, 100.0::DOUBLE * coalesce(s.n, 0) / sum(s.n) OVER () AS sites_pct FROM g FULL JOIN s ON g.bin = s.bin""")
def stats_depth(spark: SparkSession, d: str) -> DataFrame:
    return S.depth(sites(spark, d), genotypes(spark, d), 5, 45, 5)


_FRAME = """, i AS (SELECT site_id, chrom, pos, ref, kind, pos + length(ref) - 1 AS e FROM site WHERE kind IN ('ins', 'del')),
h AS (SELECT i.site_id, r.name, CASE WHEN kind = 'ins' THEN 2 ELSE greatest(0, least(i.e, r."end") - greatest(i.pos + 1, r.start) + 1) END AS len FROM i JOIN region r ON r.chrom = i.chrom AND i.pos <= r."end" AND i.e >= r.start),
f AS (SELECT site_id, min(name) AS exon, first(len ORDER BY name) AS len FROM h GROUP BY site_id),
o AS (SELECT i.site_id, f.exon, CASE WHEN f.exon IS NULL THEN 'na' WHEN len % 3 <> 0 THEN 'out' ELSE 'in' END AS frame FROM i LEFT JOIN f ON i.site_id = f.site_id)
"""


@query(_FRAME + "SELECT frame, count(*) AS n FROM o GROUP BY frame")
def stats_frameshift(spark: SparkSession, d: str) -> DataFrame:
    return S.frameshifts(sites(spark, d), regions(spark, d)).groupBy("frame").agg(F.count("*").alias("n"))


@query(_FRAME + "SELECT site_id, coalesce(exon, -1) AS exon, frame FROM o")
def frameshifts(spark: SparkSession, d: str) -> DataFrame:
    return S.frameshifts(sites(spark, d), regions(spark, d)).select("site_id", F.coalesce("exon", F.lit(-1)).alias("exon"), "frame")


@query(_ALT + ", n AS (SELECT site_id, a, count(*) AS n FROM al WHERE a > 0 GROUP BY site_id, a) SELECT count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (ts) AS ts, count(*) FILTER (tv) AS tv, count(*) FILTER (kind IN ('ins', 'del')) AS indels FROM ts JOIN n ON ts.site_id = n.site_id AND n.a = ts.nth + 1 AND n.n = 1")
def stats_singletons(spark: SparkSession, d: str) -> DataFrame:
    return S.singletons(sites(spark, d), FL.allele_counts(genotypes(spark, d)))


@query(""", t AS (SELECT g.*, s.kind, s.kind = 'snp' AND s.ref || s.alts[1] IN ('AG', 'GA', 'CT', 'TC') AS ts, s.kind = 'snp' AND s.ref || s.alts[1] NOT IN ('AG', 'GA', 'CT', 'TC') AS tv, coalesce(g.a0 > 0, false) OR coalesce(g.a1 > 0, false) AS alt FROM gt g JOIN site s ON g.site_id = s.site_id)
SELECT sample, count(*) FILTER (ploidy = 2 AND a0 = 0 AND a1 = 0) AS ref_hom, count(*) FILTER (a0 = a1 AND a0 > 0) AS nonref_hom, count(*) FILTER (a0 <> a1) AS het, count(*) FILTER (alt AND ts) AS ts, count(*) FILTER (alt AND tv) AS tv,
  count(*) FILTER (alt AND kind IN ('ins', 'del')) AS indels, CAST(sum(dp) AS DOUBLE) / count(*) AS avg_depth, count(*) FILTER (ploidy = 1 AND a0 = 0) AS hap_ref, count(*) FILTER (ploidy = 1 AND a0 > 0) AS hap_alt,
  count(*) FILTER (a0 IS NULL OR (ploidy = 2 AND a1 IS NULL)) AS missing FROM t GROUP BY sample""")
def stats_psc(spark: SparkSession, d: str) -> DataFrame:
    return S.per_sample(genotypes(spark, d), sites(spark, d))


@query("SELECT sample, CAST(round(CAST(ad1 AS DOUBLE) / dp / 0.05::DOUBLE) AS INT) AS bin, count(*) AS n FROM gt WHERE (a0 > 0 OR a1 > 0) AND dp > 0 GROUP BY 1, 2")
def stats_vaf(spark: SparkSession, d: str) -> DataFrame:
    return S.read_share(genotypes(spark, d))


@query(_ALT + "SELECT CAST(least(greatest(dp * 6 // 60, 0), 5) AS INT) AS bin, count(*) FILTER (ts) AS ts, count(*) FILTER (tv) AS tv FROM ts WHERE kind = 'snp' AND nth = 0 GROUP BY 1")
def stats_user_tstv(spark: SparkSession, d: str) -> DataFrame:
    return S.tstv_by_tag(sites(spark, d), F.col("dp"), 0, 60, 6)


@query(""", n AS (SELECT site_id, count(a) AS an, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2 FROM al GROUP BY site_id)
SELECT s.site_id, coalesce(an, 0) AS an, CASE len(alts) WHEN 0 THEN '' WHEN 1 THEN '' || coalesce(n1, 0) ELSE coalesce(n1, 0) || ',' || coalesce(n2, 0) END AS ac FROM site s LEFT JOIN n ON s.site_id = n.site_id""")
def fill_an_ac(spark: SparkSession, d: str) -> DataFrame:
    return T.fill_an_ac(genotypes(spark, d), sites(spark, d)).select("site_id", "an", F.array_join(F.col("ac").cast("array<string>"), ",").alias("ac"))


_TAGS = """, t AS (SELECT *, (a0 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT AS c, coalesce(a0 > 0, false)::INT + coalesce(a1 > 0, false)::INT AS v, coalesce(a0 = 0, false)::INT + coalesce(a1 = 0, false)::INT AS k0, coalesce(a0 = 1, false)::INT + coalesce(a1 = 1, false)::INT AS k1,
  coalesce(a0 = 2, false)::INT + coalesce(a1 = 2, false)::INT AS k2, CASE WHEN sample_id <= 3 THEN 'P1' ELSE 'P2' END AS pop FROM gt)
SELECT {by}, CAST(sum(c) AS BIGINT) AS an, CAST(sum(v) AS BIGINT) AS ac, CAST(sum(CASE WHEN a0 <> a1 THEN v ELSE 0 END) AS BIGINT) AS ac_het, CAST(sum(CASE WHEN a0 = a1 THEN v ELSE 0 END) AS BIGINT) AS ac_hom, CAST(sum(CASE WHEN c = 1 THEN v ELSE 0 END) AS BIGINT) AS ac_hemi,
  CASE WHEN sum(c) > 0 THEN CAST(sum(v) AS DOUBLE) / CAST(sum(c) AS DOUBLE) END AS af, CASE WHEN sum(c) > 0 THEN CAST(list_reverse_sort([sum(k0), sum(k1), sum(k2)])[2] AS DOUBLE) / CAST(sum(c) AS DOUBLE) END AS maf,
  count(*) FILTER (c > 0) AS ns, CAST(count(*) FILTER (c < ploidy) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS f_missing FROM t GROUP BY {by}"""


@query(_TAGS.format(by="site_id"))
def fill_tags_core(spark: SparkSession, d: str) -> DataFrame:
    return T.fill_tags(genotypes(spark, d))


@query(_TAGS.format(by="site_id, pop"))
def fill_tags_by_pop(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d).withColumn("pop", F.when(F.col("sample_id") <= 3, "P1").otherwise("P2"))
    return T.fill_tags(g, ("site_id", "pop"))


_HWE = """, g AS (SELECT site_id, (a0 = 0)::INT + (a1 = 0)::INT AS r, (a0 > 0)::INT + (a1 > 0)::INT AS v, ((a0 = 0) <> (a1 = 0))::INT AS h FROM gt WHERE ploidy = 2 AND a0 IS NOT NULL AND a1 IS NOT NULL),
s AS (SELECT site_id, CAST(least(sum(r), sum(v)) AS INT) AS rare, CAST(sum(r) + sum(v) AS INT) // 2 AS n, CAST(sum(h) AS INT) AS h FROM g GROUP BY site_id),
w AS (SELECT *, list_transform(range(rare % 2, rare + 1, 2), lambda k: [k, exp(k * ln(2) - lgamma(k + 1) - lgamma((rare - k) // 2 + 1) - lgamma(n - k - (rare - k) // 2 + 1))]) AS ws, exp(h * ln(2) - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma(n - h - (rare - h) // 2 + 1)) AS w0 FROM s)
SELECT site_id, CASE WHEN rare = 0 OR h > rare OR (rare - h) % 2 <> 0 THEN 1.0::DOUBLE ELSE round(list_sum(list_transform(list_filter(ws, lambda x: x[2] <= w0 * (1 + 1e-9)), lambda x: x[2])) / list_sum(list_transform(ws, lambda x: x[2])), 6) END AS hwe,
  CASE WHEN rare = 0 OR h > rare OR (rare - h) % 2 <> 0 THEN 1.0::DOUBLE ELSE round(list_sum(list_transform(list_filter(ws, lambda x: x[1] >= h), lambda x: x[2])) / list_sum(list_transform(ws, lambda x: x[2])), 6) END AS exc_het FROM w"""


@query(_HWE)
def fill_hwe(spark: SparkSession, d: str) -> DataFrame:
    return T.fill_hwe(genotypes(spark, d)).select("site_id", F.round("hwe", 6).alias("hwe"), F.round("exc_het", 6).alias("exc_het"))


@query("SELECT site_id, sample, CASE WHEN ad0 + ad1 > 0 THEN CAST(ad1 AS DOUBLE) / CAST(ad0 + ad1 AS DOUBLE) END AS vaf1 FROM gt")
def fill_vaf(spark: SparkSession, d: str) -> DataFrame:
    return T.fill_vaf(genotypes(spark, d)).select("site_id", "sample", "vaf1")


@query("SELECT site_id, CAST(sum(ad0 + 2 * ad1) AS DOUBLE) AS x FROM gt GROUP BY site_id")
def fill_func_sum(spark: SparkSession, d: str) -> DataFrame:
    from siteloom.functions.expression import compile_value

    return T.fill_sum(genotypes(spark, d), "x", compile_value("FMT/AD[0] + 2*FMT/AD[1]"))


@query("SELECT count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (kind IN ('ins', 'del')) AS indels, count(*) FILTER (kind = 'mnp') AS mnps, count(*) FILTER (kind = 'sym') AS others, count(*) AS sites, (SELECT count(DISTINCT sample) FROM gt) AS samples FROM site")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return S.counts(sites(spark, d), genotypes(spark, d))


@query(""", t AS (SELECT g.*, s.kind, coalesce(g.a0 > 0, false) OR coalesce(g.a1 > 0, false) AS alt, a0 IS NULL OR (ploidy = 2 AND a1 IS NULL) AS mis FROM gt g JOIN site s ON g.site_id = s.site_id)
SELECT sample, count(*) FILTER (NOT mis) AS n_pass, count(*) FILTER (alt) AS nonref, count(*) FILTER (a0 = 0 AND a1 = 0) AS rr, count(*) FILTER (a0 = a1 AND a0 > 0) AS aa, count(*) FILTER (a0 <> a1) AS het, count(*) FILTER (ploidy = 1 AND a0 > 0) AS hemi,
  count(*) FILTER (alt AND kind = 'snp') AS snv, count(*) FILTER (alt AND kind IN ('ins', 'del')) AS indel, count(*) FILTER (mis) AS missing FROM t GROUP BY ROLLUP (sample)""")
def smpl_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_rollup(genotypes(spark, d), sites(spark, d))


@query("SELECT sample, count(*) FILTER (kind = 'ins') AS ins, count(*) FILTER (kind = 'del') AS del, count(*) AS out_frame, CAST(0 AS BIGINT) AS in_frame FROM gt g JOIN site s ON g.site_id = s.site_id WHERE kind IN ('ins', 'del') AND (a0 = 1 OR a1 = 1) GROUP BY sample")
def indel_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.indel_stats(genotypes(spark, d), sites(spark, d))


@query(""", p AS (SELECT CASE WHEN a0 = 0 AND a1 = 0 THEN (1 - f) * (1 - f) WHEN a0 > 0 AND a0 = a1 THEN f * f WHEN least(a0, a1) = 0 AND greatest(a0, a1) > 0 THEN 2 * f * (1 - f) END AS p FROM (SELECT *, CAST((site_id % 8) / 8.0 AS FLOAT) AS f FROM gt WHERE ploidy = 2 AND a0 IS NOT NULL AND a1 IS NOT NULL))
SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n FROM p WHERE p IS NOT NULL GROUP BY 1""")
def af_dist(spark: SparkSession, d: str) -> DataFrame:
    af = sites(spark, d).select("site_id", ((F.col("site_id") % 8) / 8.0).alias("af"))
    return S.frequency_distribution(genotypes(spark, d), af, 10)


@query(", b AS (SELECT length(ref) AS r, length(alts[1]) AS a FROM site WHERE len(alts) > 0), x AS (SELECT r AS length, 1 AS k FROM b UNION ALL SELECT a, 2 FROM b UNION ALL SELECT r + a, 3 FROM b) SELECT CAST(length AS INT) AS length, count(*) FILTER (k = 1) AS n_ref, count(*) FILTER (k = 2) AS n_alt, count(*) FILTER (k = 3) AS n_sum FROM x GROUP BY length")
def allele_length(spark: SparkSession, d: str) -> DataFrame:
    return S.allele_lengths(sites(spark, d))


@query(", g AS (SELECT site_id, least(a0, coalesce(a1, a0)) AS x, greatest(a0, coalesce(a1, a0)) AS y, ploidy, bit_or(1::BIGINT << (sample_id - 1)) AS mask FROM gt WHERE a0 IS NOT NULL AND (ploidy = 1 OR a1 IS NOT NULL) GROUP BY ALL) SELECT mask, count(*) AS n FROM g GROUP BY mask")
def gt_isec(spark: SparkSession, d: str) -> DataFrame:
    return S.shared_genotypes(genotypes(spark, d))


@query(", x AS (SELECT al.site_id, a, sample_id IN (1, 2, 3) AS ca FROM al WHERE a IS NOT NULL AND sample_id <= 6), n AS (SELECT site_id, a, bool_or(ca) AND NOT bool_or(NOT ca) AS only_case FROM x GROUP BY site_id, a), v AS (SELECT site_id, bool_or(only_case) AS novel FROM n GROUP BY site_id) SELECT x.site_id, count(*) FILTER (ca AND a = 0) AS case_ref, count(*) FILTER (ca AND a > 0) AS case_alt, count(*) FILTER (NOT ca AND a = 0) AS control_ref, count(*) FILTER (NOT ca AND a > 0) AS control_alt, any_value(novel) AS novel FROM x JOIN v ON x.site_id = v.site_id GROUP BY x.site_id")
def contrast_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.contrast(genotypes(spark, d), ["S1", "S2", "S3"], ["S4", "S5", "S6"])


#: Fisher's P of a 2x2 table (a, b, c, d) of a relation t, for the oracles.
FISHER = """, e AS (SELECT *, a + b + c + d AS n FROM t),
w AS (SELECT *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda x: exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)
  - lgamma(n + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))) AS ps, exp(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1) - lgamma(n + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p0 FROM e)
SELECT {keys}, round(list_sum(list_filter(ps, lambda p: p <= p0 * (1 + 1e-7))), 6) AS p FROM w
"""


@query(", x AS (SELECT site_id, a, sample_id <= 3 AS ca FROM al WHERE a IS NOT NULL AND sample_id <= 6), t AS (SELECT site_id, count(*) FILTER (ca AND a = 0) AS a, count(*) FILTER (ca AND a > 0) AS b, count(*) FILTER (NOT ca AND a = 0) AS c, count(*) FILTER (NOT ca AND a > 0) AS d FROM x GROUP BY site_id)" + FISHER.format(keys="site_id"))
def contrast_p(spark: SparkSession, d: str) -> DataFrame:
    c = S.contrast(genotypes(spark, d), ["S1", "S2", "S3"], ["S4", "S5", "S6"])
    return c.select("site_id", prob.fisher_two_sided(F.col("case_ref"), F.col("case_alt"), F.col("control_ref"), F.col("control_alt")).alias("p")).withColumn("p", F.round("p", 6))


@query(""", p AS (SELECT site_id, CASE WHEN gq < 40 THEN 0.75 ELSE 0.25 END AS p0, 0.125 AS p1, CASE WHEN gq < 40 THEN 0.125 ELSE 0.625 END AS p2 FROM gt),
s AS (SELECT site_id, CAST(sum(p1 + 2 * p2) AS DOUBLE) AS e, CAST(sum(p1 + 4 * p2 - (p1 + 2 * p2) * (p1 + 2 * p2)) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY site_id)
SELECT site_id, round(CASE WHEN e / (2 * n) > 0 AND e / (2 * n) < 1 THEN 1 - v / (2 * n * (e / (2 * n)) * (1 - e / (2 * n))) ELSE 1.0 END, 9) AS info FROM s""")
def impute_info(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("gq") < 40
    gp = F.array(F.when(low, 0.75).otherwise(0.25), F.lit(0.125), F.when(low, 0.125).otherwise(0.625))
    return S.impute_info(genotypes(spark, d), gp).withColumn("info", F.round("info", 9))


@query("SELECT site_id, sample, CASE WHEN a0 IS NULL OR (ploidy = 2 AND a1 IS NULL) THEN -1.0::DOUBLE ELSE CAST((a0 > 0)::INT + coalesce((a1 > 0)::INT, 0) AS DOUBLE) END AS dosage FROM gt")
def dosage_gt(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("site_id", "sample", T.dosage(F.col("alleles")).alias("dosage"))


@query(", n AS (SELECT sample, chrom, count(*) AS n FROM gt g JOIN site s ON g.site_id = s.site_id WHERE a0 IS NOT NULL OR a1 IS NOT NULL GROUP BY 1, 2) SELECT a.sample, b.chrom, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT sample FROM gt) a CROSS JOIN (SELECT DISTINCT chrom FROM site) b LEFT JOIN n ON n.sample = a.sample AND n.chrom = b.chrom WHERE coalesce(n.n, 0) < 1250")
def check_sparsity(spark: SparkSession, d: str) -> DataFrame:
    return S.sparse(genotypes(spark, d), sites(spark, d), 1250)


@query(", n AS (SELECT site_id, count(a) AS an, count(*) FILTER (a > 0) AS ac FROM al GROUP BY site_id) SELECT site_id, an, ac, CAST(least(ac, an - ac) AS DOUBLE) / an AS maf FROM n WHERE an > 0 AND CAST(least(ac, an - ac) AS DOUBLE) / an > 0.25")
def computed_maf(spark: SparkSession, d: str) -> DataFrame:
    t = T.fill_tags(genotypes(spark, d)).where("an > 0")
    mac = F.least(F.col("ac"), F.col("an") - F.col("ac"))
    return t.select("site_id", "an", "ac", (mac / F.col("an")).alias("maf")).where("maf > 0.25")


@query(_HWE.replace("SELECT site_id, CASE", ", q AS (SELECT site_id, CASE", 1) + """), m AS (SELECT site_id, CAST(count(*) FILTER (a > 0) AS DOUBLE) / count(a) AS af FROM al WHERE a IS NOT NULL GROUP BY site_id),
b AS (SELECT CAST(least(floor(100 * least(af, 1 - af)), 49) AS INT) AS bin, hwe FROM q JOIN m ON q.site_id = m.site_id), l AS (SELECT bin, count(*) AS n, list_sort(list(hwe)) AS ps FROM b GROUP BY bin)
SELECT bin, n, ps[1 + CAST(floor((n - 1) * 0.25 + 0.5) AS INT)] AS p25, ps[1 + CAST(floor((n - 1) * 0.5 + 0.5) AS INT)] AS p50, ps[1 + CAST(floor((n - 1) * 0.75 + 0.5) AS INT)] AS p75 FROM l""")
def stats_hwe(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d)
    return S.hardy_weinberg(T.fill_hwe(g).withColumn("hwe", F.round("hwe", 6)), T.fill_tags(g).select("site_id", "af"))


@query("""SELECT CAST(a AS INT) AS grp, n, p25, p50, p75 FROM (SELECT gq // 25 AS a, count(*) AS n, list_sort(list(dp))[1 + CAST(floor((count(*) - 1) * 0.25 + 0.5) AS INT)] AS p25,
  list_sort(list(dp))[1 + CAST(floor((count(*) - 1) * 0.5 + 0.5) AS INT)] AS p50, list_sort(list(dp))[1 + CAST(floor((count(*) - 1) * 0.75 + 0.5) AS INT)] AS p75 FROM gt GROUP BY 1)""")
def nearest_rank_depth(spark: SparkSession, d: str) -> DataFrame:
    v = genotypes(spark, d).select(F.floor(F.col("gq") / 25).cast("int").alias("grp"), "dp")
    return S.nearest_rank(v, "grp", "dp", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query(_FRAME + """, c AS (SELECT g.sample, o.frame, s.kind = 'ins' AS ins, ploidy = 2 AND NOT (coalesce(a0 = 1, false) AND coalesce(a1 = 1, false)) AS het FROM gt g JOIN site s ON g.site_id = s.site_id JOIN o ON o.site_id = g.site_id WHERE a0 = 1 OR a1 = 1)
SELECT sample, count(*) FILTER (frame = 'in') AS in_frame, count(*) FILTER (frame = 'out') AS out_frame, count(*) FILTER (frame = 'na') AS not_applicable, count(*) FILTER (ins AND het) AS ins_het, count(*) FILTER (ins AND NOT het) AS ins_hom,
  count(*) FILTER (NOT ins AND het) AS del_het, count(*) FILTER (NOT ins AND NOT het) AS del_hom FROM c GROUP BY sample""")
def stats_psi(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    return S.sample_indels(genotypes(spark, d), S.frameshifts(s, regions(spark, d)), s)


@query(", n AS (SELECT site_id, count(a) AS an, count(*) FILTER (a > 0) AS ac FROM al GROUP BY site_id), g AS (SELECT abs(CAST(CAST(ac AS DOUBLE) / an AS FLOAT) - CAST((site_id % 8) / 8.0 AS FLOAT)) AS gap FROM n WHERE an > 0) SELECT CAST(least(floor(CAST(gap AS DOUBLE) * 10), 9) AS INT) AS bin, count(*) AS n FROM g GROUP BY 1")
def af_deviation(spark: SparkSession, d: str) -> DataFrame:
    af = sites(spark, d).select("site_id", ((F.col("site_id") % 8) / 8.0).alias("af"))
    return S.frequency_deviation(T.fill_tags(genotypes(spark, d)), af, 10)


@query("SELECT CAST(CASE kind WHEN 'ins' THEN 2 ELSE -2 END AS INT) AS length, count(*) AS n FROM site WHERE kind IN ('ins', 'del') GROUP BY 1")
def indel_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.length_histogram(sites(spark, d))


@query(""", i AS (SELECT site_id, kind, ref, alts[1] AS alt, ref || repeat('TT', CAST(site_id % 6 AS INT)) || 'ACAC' AS base FROM site WHERE kind IN ('ins', 'del')),
u AS (SELECT *, unnest(range(1, 11)) AS u FROM i), k AS (SELECT *, unnest(range(1, 40)) AS k FROM u),
f AS (SELECT site_id, kind, ref, alt, base, u, max(k) AS n FROM k WHERE length(substr(base, 2, CAST(u AS INT))) > 0 AND substr(base, 2, CAST(k * u AS INT)) = repeat(substr(base, 2, CAST(u AS INT)), CAST(k AS INT)) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n * u DESC, u) AS nth FROM f WHERE n > 1),
c AS (SELECT *, CASE WHEN kind = 'ins' THEN substr(alt, 2) ELSE substr(ref, 2) END AS changed FROM b WHERE nth = 1)
SELECT CAST(least(10, n) AS INT) AS times, kind = 'ins' AS ins, length(changed) % u = 0 AND changed = repeat(substr(base, 2, CAST(u AS INT)), CAST(length(changed) // u AS INT)) AS ok, count(*) AS n FROM c GROUP BY ALL""".replace("k AS (SELECT *, unnest(range(1, 40))", "kk AS (SELECT *, unnest(range(1, 40))").replace("FROM k WHERE length", "FROM kk WHERE length"))
def indel_contexts(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).withColumn("base", F.concat("ref", F.repeat(F.lit("TT"), (F.col("site_id") % 6).cast("int")), F.lit("ACAC")))
    return S.indel_contexts(s)
