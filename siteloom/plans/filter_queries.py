"""Queries of filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions.expression import compile_filter
from siteloom.operators import filters as O
from siteloom.operators import stats as S
from siteloom.plans.registry import query
from siteloom.plans.relations import genotypes, regions, sites

_ACS = """, an AS (SELECT s.site_id, count(al.a) AS an, count(al.a) FILTER (al.a = 0) AS n0, count(al.a) FILTER (al.a = 1) AS n1, count(al.a) FILTER (al.a = 2) AS n2, len(any_value(s.alts)) AS na
  FROM site s JOIN al ON s.site_id = al.site_id GROUP BY s.site_id)
"""


@query(""", v AS (SELECT chrom, ref || unnest(alts) AS c FROM site WHERE qual > 200 AND len(alts) > 0 AND kind = 'snp')
SELECT chrom, count(*) FILTER (c IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (c NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM v GROUP BY chrom""")
def flagship_tstv_by_contig(spark: SparkSession, d: str) -> DataFrame:
    return S.tstv(sites(spark, d).where(compile_filter('QUAL>200 & TYPE="snp"')), "chrom").select("chrom", "ts", "tv")


@query("SELECT site_id, chrom, pos FROM site WHERE (qual >= 300 AND NOT coalesce(dp < 10, false)) OR (list_contains(filters, 'q10') AND id IS NOT NULL)")
def filter_expression(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).where(compile_filter('(QUAL>=300 & !(DP<10)) | (FILTER="q10" && ID!=".")')).select("site_id", "chrom", "pos")


@query("SELECT site_id FROM site WHERE NOT coalesce(qual < 100, false) AND len(list_filter(alts, lambda x: x = 'A')) = 0")
def filter_missing_and_lists(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).where(compile_filter('!(QUAL<100) & ALT!="A"')).select("site_id")


@query("""SELECT site_id, sample, CASE WHEN ploidy = 1 THEN CASE WHEN a0 IS NULL THEN 'mis' WHEN a0 = 0 THEN 'R' ELSE 'A' END
  WHEN a0 IS NULL AND a1 IS NULL THEN 'mis' WHEN a0 = 0 AND a1 = 0 THEN 'RR' WHEN a0 > 0 AND a0 = a1 THEN 'AA' WHEN a0 > 0 AND a1 > 0 THEN 'aA' WHEN a0 >= 0 AND a1 >= 0 THEN 'RA' ELSE 'half' END AS class,
  ploidy = 2 AND a0 IS NOT NULL AND a0 IS DISTINCT FROM a1 AS is_het FROM gt""")
def gt_classes(spark: SparkSession, d: str) -> DataFrame:
    g, a = genotypes(spark, d), F.col("alleles")
    name = F.when(G.all_missing(a), "mis")
    for c in ("R", "A", "RR", "AA", "aA", "RA"):
        name = name.when(G.is_class(a, c), c)
    return g.select("site_id", "sample", name.otherwise("half").alias("class"), G.is_class(a, "het").alias("is_het"))


@query("SELECT site_id, CAST(sum(CASE WHEN gq >= 30 AND dp > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, CAST(sum(CASE WHEN gq >= 30 AND dp > 10 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS f_pass FROM gt GROUP BY site_id HAVING sum(CASE WHEN gq >= 30 AND dp > 10 THEN 1 ELSE 0 END) * 2 >= count(*)")
def f_pass(spark: SparkSession, d: str) -> DataFrame:
    ok = compile_filter("FMT/GQ>=30 & FMT/DP>10", sample=True)
    per = genotypes(spark, d).groupBy("site_id").agg(F.count_if(ok).alias("n_pass"), F.count("*").alias("n"))
    return per.select("site_id", "n_pass", (F.col("n_pass") / F.col("n")).alias("f_pass")).where("f_pass >= 0.5")


@query("SELECT site_id, CAST(count(*) FILTER (a0 IS NULL OR (ploidy = 2 AND a1 IS NULL)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS f_missing FROM gt GROUP BY site_id HAVING count(*) FILTER (a0 IS NULL OR (ploidy = 2 AND a1 IS NULL)) > 0")
def f_missing(spark: SparkSession, d: str) -> DataFrame:
    per = genotypes(spark, d).groupBy("site_id").agg((F.count_if(G.any_missing(F.col("alleles"))) / F.count("*")).alias("f_missing"))
    return per.where("f_missing > 0")


@query("SELECT site_id, id FROM site WHERE id IN (SELECT 'rs' || p_partkey FROM part WHERE p_size < 25)")
def id_in_file(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/part.parquet").where("p_size < 25").select(F.concat(F.lit("rs"), "p_partkey").alias("id"))
    return O.id_in(sites(spark, d), ids).select("site_id", "id")


@query("SELECT site_id, pos FROM site s WHERE EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.pos BETWEEN r.start AND r.\"end\")")
def regions_pos(spark: SparkSession, d: str) -> DataFrame:
    return O.in_regions(sites(spark, d), regions(spark, d), "pos").select("site_id", "pos")


@query("SELECT site_id, pos FROM site s WHERE EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.pos <= r.\"end\" AND coalesce(s.\"end\", s.pos + length(s.ref) - 1) >= r.start)")
def regions_record(spark: SparkSession, d: str) -> DataFrame:
    return O.in_regions(sites(spark, d), regions(spark, d), "record").select("site_id", "pos")


@query("""SELECT site_id, pos FROM site s WHERE EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom
  AND s.pos + CASE WHEN kind IN ('ins', 'del') THEN 1 ELSE 0 END <= r."end" AND CASE WHEN kind = 'ins' THEN s.pos + 1 ELSE coalesce(s."end", s.pos + length(s.ref) - 1) END >= r.start)""")
def regions_variant(spark: SparkSession, d: str) -> DataFrame:
    return O.in_regions(sites(spark, d), regions(spark, d), "variant").select("site_id", "pos")


@query("SELECT site_id, pos FROM site s WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.pos BETWEEN r.start AND r.\"end\")")
def targets_exclude(spark: SparkSession, d: str) -> DataFrame:
    return O.in_regions(sites(spark, d), regions(spark, d), "pos", exclude=True).select("site_id", "pos")


@query("SELECT site_id, array_to_string(filters, ';') AS filter FROM site WHERE list_has_any(filters, ['q10', 'PASS'])")
def apply_filters(spark: SparkSession, d: str) -> DataFrame:
    return O.has_filter(sites(spark, d), "q10", "PASS").select("site_id", F.array_join("filters", ";").alias("filter"))


@query("SELECT site_id FROM site WHERE kind IN ('ins', 'del', 'mnp')")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return O.of_types(sites(spark, d), "indel", "mnp").select("site_id")


@query("SELECT site_id FROM site WHERE kind NOT IN ('snp', 'none')")
def type_exclude(spark: SparkSession, d: str) -> DataFrame:
    return O.of_types(sites(spark, d), "snp", "ref", exclude=True).select("site_id")


@query(_ACS + "SELECT site_id, an FROM an WHERE an - n0 >= 3")
def min_ac(spark: SparkSession, d: str) -> DataFrame:
    return O.by_count(sites(spark, d), genotypes(spark, d), "nref", lowest=3).select("site_id", "an")


@query(_ACS + "SELECT site_id, an FROM an WHERE an > 0 AND CAST(CASE na WHEN 0 THEN n0 WHEN 1 THEN least(n0, n1) ELSE least(n0, n1, n2) END AS DOUBLE) / CAST(an AS DOUBLE) <= 0.2")
def max_af_minor(spark: SparkSession, d: str) -> DataFrame:
    return O.by_frequency(sites(spark, d), genotypes(spark, d), "minor", highest=0.2).select("site_id", "an")


@query(_ACS + "SELECT site_id, an FROM an WHERE an - greatest(n0, n1, n2) BETWEEN 1 AND 4")
def nonmajor_count(spark: SparkSession, d: str) -> DataFrame:
    return O.by_count(sites(spark, d), genotypes(spark, d), "nonmajor", 1, 4).select("site_id", "an")


@query("SELECT site_id FROM site WHERE len(alts) + 1 BETWEEN 3 AND 9")
def allele_count_filter(spark: SparkSession, d: str) -> DataFrame:
    return O.n_alleles_between(sites(spark, d), 3, 9).select("site_id")


@query("SELECT site_id, id FROM site WHERE id IS NOT NULL")
def known_sites(spark: SparkSession, d: str) -> DataFrame:
    return O.known(sites(spark, d)).select("site_id", "id")


@query("SELECT s.site_id FROM site s JOIN (SELECT site_id FROM gt GROUP BY site_id HAVING bool_and(phased OR ploidy = 1)) p ON s.site_id = p.site_id")
def phased_sites(spark: SparkSession, d: str) -> DataFrame:
    return O.phased_sites(sites(spark, d), genotypes(spark, d)).select("site_id")


@query("SELECT site_id FROM gt GROUP BY site_id HAVING bool_and(a0 IS NULL AND a1 IS NULL)")
def uncalled_sites(spark: SparkSession, d: str) -> DataFrame:
    return O.uncalled_sites(sites(spark, d), genotypes(spark, d)).select("site_id")


@query("SELECT site_id FROM gt GROUP BY site_id HAVING NOT bool_or(a0 IS NOT NULL AND a1 IS NOT NULL AND a0 <> a1)")
def genotype_filter(spark: SparkSession, d: str) -> DataFrame:
    return O.with_genotype(sites(spark, d), genotypes(spark, d), "het", exclude=True).select("site_id")


@query("SELECT site_id, CASE WHEN coalesce(qual > 250, false) AND dp >= 20 THEN 'PASS' ELSE array_to_string(list_filter(filters, lambda x: x <> 'PASS') || ['LowQD'], ';') END AS filter FROM site")
def soft_filter(spark: SparkSession, d: str) -> DataFrame:
    out = O.soft_filter(sites(spark, d), compile_filter("QUAL>250 & DP>=20"), "LowQD", "+x")
    return out.select("site_id", F.array_join("filters", ";").alias("filter"))


@query("""SELECT site_id, CASE WHEN EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.pos <= r."end" AND coalesce(s."end", s.pos + length(s.ref) - 1) >= r.start)
  THEN array_to_string(list_filter(filters, lambda x: x <> 'PASS') || ['Mask'], ';') ELSE array_to_string(filters, ';') END AS filter FROM site s""")
def mask_regions(spark: SparkSession, d: str) -> DataFrame:
    return O.mask_regions(sites(spark, d), regions(spark, d), "Mask").select("site_id", F.array_join("filters", ";").alias("filter"))


@query("""SELECT site_id, count(a) AS an, count(a) FILTER (a = 1) AS ac1 FROM (SELECT g.site_id, CASE WHEN g.gq >= 20 THEN x.a END AS a FROM gt g JOIN al x ON g.site_id = x.site_id AND g.sample_id = x.sample_id) GROUP BY site_id""")
def set_gts_missing(spark: SparkSession, d: str) -> DataFrame:
    from siteloom.operators.rewrite import set_failed_genotypes

    g = set_failed_genotypes(genotypes(spark, d), compile_filter("GQ>=20", sample=True), None)
    return g.select("site_id", F.explode("alleles").alias("a")).groupBy("site_id").agg(F.count("a").alias("an"), F.count_if(F.col("a") == 1).alias("ac1"))


@query(""", g AS (SELECT *, CASE WHEN kind = 'sym' THEN 'indel' WHEN kind IN ('ins', 'del') THEN 'indel' ELSE kind END AS c, pos + length(ref) - 1 AS e FROM site)
SELECT s.site_id FROM g s WHERE s.c = 'snp' AND EXISTS (SELECT 1 FROM g o WHERE o.chrom = s.chrom AND o.c = 'indel' AND ((o.pos <= s.pos AND s.pos - o.e <= 5) OR (o.pos >= s.pos AND o.pos - s.e <= 5)))""")
def snp_gap(spark: SparkSession, d: str) -> DataFrame:
    return O.has_filter(O.snp_gap(sites(spark, d), 5), "SnpGap").select("site_id")


@query(""", g AS (SELECT *, pos + length(ref) - 1 AS e FROM site WHERE kind IN ('sym', 'ins', 'del')),
h AS (SELECT *, CASE WHEN pos - max(e) OVER (PARTITION BY chrom ORDER BY pos, site_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 40 THEN 0 ELSE 1 END AS n FROM g),
c AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY pos, site_id ROWS UNBOUNDED PRECEDING) AS chain FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, chain ORDER BY greatest(coalesce(qual, 0), 0) DESC, pos, site_id) AS nth FROM c)
SELECT site_id FROM r WHERE nth > 1""")
def indel_gap(spark: SparkSession, d: str) -> DataFrame:
    return O.has_filter(O.indel_gap(sites(spark, d), 40), "IndelGap").select("site_id")


@query(""", t AS (SELECT site_id, sample, CASE WHEN a0 IS NULL AND a1 IS NULL THEN NULL WHEN a0 IS NULL THEN '' || a1 WHEN a1 IS NULL THEN '' || a0 ELSE least(a0, a1) || '/' || greatest(a0, a1) END AS g FROM gt),
p AS (SELECT site_id, min(g) FILTER (sample IN ('S1', 'S2')) AS lo, max(g) FILTER (sample IN ('S1', 'S2')) AS hi, coalesce(list(g) FILTER (sample NOT IN ('S1', 'S2') AND g IS NOT NULL), []) AS o FROM t GROUP BY site_id)
SELECT site_id FROM p WHERE lo = hi AND NOT list_contains(o, lo)""")
def gt_subset(spark: SparkSession, d: str) -> DataFrame:
    return O.gt_subset(sites(spark, d), genotypes(spark, d), ["S1", "S2"]).select("site_id")
