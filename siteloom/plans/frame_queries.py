"""Queries over frames with INFO maps and samples, as they are read from VCF: expressions, templates, rewrites, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import prob
from siteloom.functions import variants as V
from siteloom.functions.expression import compile_filter, compile_value, vcf_scope
from siteloom.functions.lets import number
from siteloom.functions.template import render_sites
from siteloom.operators import consensus as C
from siteloom.operators import filters as FL
from siteloom.operators import joins as J
from siteloom.operators import merge as M
from siteloom.operators import normalize as N
from siteloom.operators import rewrite as O
from siteloom.operators import tags as TG
from siteloom.plans.registry import query
from siteloom.plans.relations import CONTIG, genotypes, regions, second_input, sites
from siteloom.plans.rewrite_queries import _GT, call
from siteloom.plans.stats_queries import FISHER
from siteloom.sources import bcf, bgzf, companions, sinks, store
from siteloom.sources.header import Header, merge_headers
from siteloom.sources.scratch import scratch_path
from siteloom.sources.vcf import SAMPLES, read_vcf, write_vcf


def frame(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Sites with samples: INFO DP and END, FORMAT GT, DP, GQ and AD."""
    g = genotypes(spark, d).withColumn("gt_raw", G.render(F.col("alleles"), F.col("phased")))
    packed = g.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_id", F.struct("sample", "gt_raw", "alleles", "phased", "dp", "gq", "ad").alias("x")))), lambda r: r["x"]).alias("xs"))
    plain = lambda c: F.array(c.cast("string"))
    samples = F.transform("xs", lambda x: F.struct(x["sample"].alias("sample"), x["gt_raw"].alias("gt_raw"), x["alleles"].alias("alleles"), x["phased"].alias("phased"), F.create_map(F.lit("DP"), plain(x["dp"]), F.lit("GQ"), plain(x["gq"]), F.lit("AD"), x["ad"].cast("array<string>")).alias("fmt")))
    s = sites(spark, d) if of is None else of
    info = F.when(F.col("end").isNull(), F.create_map(F.lit("DP"), plain(F.col("dp")))).otherwise(F.create_map(F.lit("DP"), plain(F.col("dp")), F.lit("END"), plain(F.col("end"))))
    out = s.join(packed, "site_id").withColumn("info", info).withColumn("samples", samples).withColumn("format", F.array(*map(F.lit, ("GT", "DP", "GQ", "AD"))))
    return out.drop("xs", "dp")


#: Per-site aggregates of the samples, for the oracles.
_PER = """, per AS (SELECT site_id, count(*) AS n, CAST(sum(dp) AS DOUBLE) AS s, min(dp) AS lo, max(dp) AS hi, CAST(median(dp) AS DOUBLE) AS med, stddev_pop(CAST(dp AS DOUBLE)) AS sd, count(*) FILTER (dp <> 0) AS nz,
  count(*) FILTER (gq > 50) AS good, count(*) FILTER (ad1 > 3) AS reads, count(*) FILTER (a0 IS NULL OR (ploidy = 2 AND a1 IS NULL)) AS mis FROM gt GROUP BY site_id)
"""


@query(_PER + "SELECT site_id, s AS total, s / n AS mean, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, med AS middle, round(sd, 6) AS spread, nz AS n_nonzero FROM per")
def expr_aggregates(spark: SparkSession, d: str) -> DataFrame:
    x = lambda t: compile_value(t, vcf_scope())
    return frame(spark, d).select("site_id", x("SUM(FMT/DP)").alias("total"), x("AVG(FMT/DP)").alias("mean"), x("MIN(FMT/DP)").alias("low"), x("SMPL_MAX(FMT/DP)").alias("high"), x("MEDIAN(FMT/DP)").alias("middle"), F.round(x("STDEV(FMT/DP)"), 6).alias("spread"), x("COUNT(FMT/DP)").cast("long").alias("n_nonzero"))


@query(_PER + "SELECT p.site_id FROM per p JOIN site s ON s.site_id = p.site_id WHERE p.good >= 2 AND (CAST(p.reads AS DOUBLE) / p.n < 0.5 OR p.hi > 40) AND s.dp > 10 AND CAST(p.mis AS DOUBLE) / p.n < 0.4")
def expr_record_lookup(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d).where(compile_filter("N_PASS(GQ>50)>=2 & (F_PASS(AD[1]>3)<0.5 | MAX(FMT/DP)>40) & DP>10 & F_MISSING<0.4", vcf_scope())).select("site_id")


@query("SELECT site_id, CAST(length(ref) AS INT) AS ref_len, CAST(list_max(list_transform(alts, lambda a: length(a))) AS INT) AS alt_len FROM site WHERE len(list_filter(alts, lambda a: length(a) >= 2)) > 0")
def expr_strlen(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).where(compile_filter("STRLEN(ALT)>=2"))
    return s.select("site_id", compile_value("STRLEN(REF)").alias("ref_len"), F.array_max(compile_value("STRLEN(ALT)")).cast("int").alias("alt_len"))


@query("SELECT site_id, sample, CAST(abs(dp - 30) AS DOUBLE) AS off, round(least(-4.3429::DOUBLE * ln((gq + 1) / 101.0::DOUBLE), 99.0), 6) AS score FROM gt")
def expr_abs_phred(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("site_id", "sample", compile_value("ABS(DP-30)").alias("off"), F.round(compile_value("PHRED((GQ+1)/101)"), 6).alias("score"))


_BINOM = """, b AS (SELECT *, ad0 + ad1 AS n, least(ad0, ad1) AS k FROM gt),
w AS (SELECT *, CASE WHEN n = 0 THEN -1.0::DOUBLE WHEN ad0 = ad1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2::DOUBLE))))) END AS p FROM b)
"""


@query(_BINOM + "SELECT site_id, sample, round(p + 1e-9, 5) AS p FROM w")
def expr_binom(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("site_id", "sample", F.round(compile_value("BINOM(AD[0],AD[1])") + 1e-9, 5).alias("p"))


@query(", t AS (SELECT site_id, sample, dp AS a, gq AS b, ad0 AS c, ad1 AS d FROM gt WHERE sample_id = 1)" + FISHER.format(keys="site_id, sample"))
def expr_fisher(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d).where("sample_id = 1").withColumn("pl", F.array("dp", "gq", F.get("ad", F.lit(0)), F.get("ad", F.lit(1))))
    return g.select("site_id", "sample", F.round(compile_value("FISHER(PL)"), 6).alias("p"))


@query("SELECT site_id, sample FROM gt WHERE (dp * 2 + 1 > gq / 3.0) AND dp % 7 = 3 AND -dp < -4 AND gq - dp * 1.5 <= 60")
def expr_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).where(compile_filter("DP*2+1 > GQ/3 & DP%7=3 & -DP < -4 & GQ-DP*1.5 <= 60")).select("site_id", "sample")


@query("SELECT site_id, id FROM site WHERE id IS NOT NULL AND regexp_matches(id, '^rs[12]') AND len(list_filter(alts, lambda a: regexp_matches(a, 'T$'))) = 0")
def expr_regex(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).where(compile_filter('ID~"^rs[12]" & ALT!~"T$"')).select("site_id", "id")


@query("SELECT site_id FROM site WHERE NOT coalesce(qual > 100, false) AND ref <> 'A' AND NOT list_contains(filters, 'q10')")
def expr_negation(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).where(compile_filter('!(QUAL>100) && REF!="A" && FILTER!="q10"')).select("site_id")


@query("""SELECT s.site_id FROM site s JOIN (SELECT site_id, list(ad1 ORDER BY sample_id) AS r, list(a0 ORDER BY sample_id) AS x, list(coalesce(a1, -1) ORDER BY sample_id) AS y, list(ploidy ORDER BY sample_id) AS p FROM gt GROUP BY site_id) g ON s.site_id = g.site_id
WHERE g.r[1] > 3 AND (len(s.alts) > 1 OR s.alts[1] = 'T') AND coalesce(g.p[2] = 2 AND g.x[2] IS NOT NULL AND g.x[2] IS DISTINCT FROM CASE WHEN g.y[2] < 0 THEN NULL ELSE g.y[2] END, false)""")
def expr_subscripts(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d).where(compile_filter('FMT/AD[0:1]>3 & (N_ALT>1 | ALT[0]="T") & GT[1:*]="het"', vcf_scope())).select("site_id")


@query(""", l AS (SELECT site_id, list(dp ORDER BY sample_id) AS d, list(gq ORDER BY sample_id) AS q, list(sample ORDER BY sample_id) AS n FROM gt GROUP BY site_id)
SELECT site_id FROM l WHERE list_max(d[2:4]) > 40 AND (q[1] < 50 OR coalesce(q[4], 100) < 50) AND len(list_filter(list_zip(d, n), lambda x: x[2] IN ('S2', 'S5') AND x[1] < 30)) > 0""")
def expr_sample_sets(spark: SparkSession, d: str) -> DataFrame:
    named = {"some.txt": ["S2", "S5"]}
    return frame(spark, d).where(compile_filter("MAX(FMT/DP[1-3:0])>40 & FMT/GQ[0,3:0]<50 & FMT/DP[@some.txt]<30", vcf_scope(), files=named.__getitem__)).select("site_id")


@query("""SELECT s.site_id FROM site s JOIN (SELECT site_id, count(a) AS an, count(a) FILTER (a > 0) AS ac, bool_or(a = 0) AS r FROM al GROUP BY site_id) n ON n.site_id = s.site_id
WHERE s.kind IN ('snp', 'ins') AND n.ac >= 2 AND list_has_any(s.filters, ['PASS', 'q10']) AND s.id IS NOT NULL AND len(s.alts) + 1 BETWEEN 2 AND 2 AND coalesce(s.qual > 50, false)
  AND EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.pos BETWEEN r.start AND r."end")""")
def view_conjunction(spark: SparkSession, d: str) -> DataFrame:
    s, g = sites(spark, d), genotypes(spark, d)
    s = FL.has_filter(FL.known(FL.n_alleles_between(s, 2, 2)), "PASS", "q10").where(compile_filter("QUAL>50"))
    s = FL.of_types(s, "snp", "indel").where(V.ilen(F.col("ref"), F.col("alts")).isNotNull() & (F.length("ref") == 1))
    s = FL.in_regions(s, regions(spark, d), "pos")
    return FL.by_count(s, g, "nref", lowest=2).select("site_id")


# templates


@query("""SELECT site_id, pos || '-' || coalesce("end", pos + length(ref) - 1) || chr(9) || dp || ' ' || dp || '%' || chr(92) || coalesce(array_to_string(alts, ','), '.') AS line FROM (SELECT * REPLACE (CASE WHEN len(alts) = 0 THEN NULL ELSE alts END AS alts) FROM site)""")
def tpl_fields(spark: SparkSession, d: str) -> DataFrame:
    return render_sites(sites(spark, d), r"%POS-%END\t%INFO/DP %/DP%%\\%ALT", keep=("site_id",))


@query("""SELECT s.site_id, coalesce(s.alts[2], '.') || string_agg(' ' || g.sample || ':' || g.ad1 || '/' || g.ad0 || ',' || g.ad1, '' ORDER BY g.sample_id) AS line FROM site s JOIN gt g ON s.site_id = g.site_id GROUP BY s.site_id, s.alts""")
def tpl_subscripts(spark: SparkSession, d: str) -> DataFrame:
    return render_sites(frame(spark, d), r"%ALT{1}[ %SAMPLE:%AD{1}/%AD]", keep=("site_id",))


@query(_PER + "SELECT p.site_id, s.pos || ' ' || p.reads || ' ' || CAST(p.s AS BIGINT) || ' ' || p.lo || ' ' || p.hi AS line FROM per p JOIN site s ON s.site_id = p.site_id")
def tpl_calls_with_subscripts(spark: SparkSession, d: str) -> DataFrame:
    return render_sites(frame(spark, d), r"%POS %N_PASS(AD[1]>3) %SUM(FMT/DP) %MIN(FMT/DP) %MAX(FMT/DP)", keep=("site_id",))


@query("SELECT g.site_id, (2 * count(*)) || string_agg(' ' || (ad0 + ad1) || ':' || greatest(ad0, ad1) || ':2', '' ORDER BY sample_id) AS line FROM gt g GROUP BY g.site_id")
def tpl_per_sample(spark: SparkSession, d: str) -> DataFrame:
    return render_sites(frame(spark, d), r"%SMPL_COUNT(FMT/AD)[ %SMPL_SUM(AD):%SMAX(AD):%SMPL_COUNT(AD)]", keep=("site_id",))


@query(_BINOM + """, h AS (SELECT *, CASE WHEN a0 IS NULL OR ploidy = 1 OR a1 IS NULL OR greatest(a0, a1) > 1 THEN NULL WHEN a0 = 0 THEN ad0 ELSE ad1 END AS x, CASE WHEN a0 IS NULL OR ploidy = 1 OR a1 IS NULL OR greatest(a0, a1) > 1 THEN NULL WHEN a1 = 0 THEN ad0 ELSE ad1 END AS y FROM w)
SELECT site_id, string_agg(sample || '=' || CASE WHEN x IS NULL OR (x = 0 AND y = 0) THEN '.' WHEN x = y THEN '0' WHEN p >= 1 - 1e-9 THEN '0' ELSE '+' END, ' ' ORDER BY sample_id) AS line FROM h GROUP BY site_id""")
def tpl_pbinom(spark: SparkSession, d: str) -> DataFrame:
    f = render_sites(frame(spark, d), r"[%SAMPLE=%PBINOM(AD) ]", keep=("site_id",))
    return f.select("site_id", F.rtrim(F.regexp_replace("line", r"=(?!0 )[0-9][0-9.]*", "=+")).alias("line"))


# rewrites


@query("SELECT site_id, CAST(0 AS INT) AS n_samples, CAST(0 AS INT) AS n_format FROM site WHERE site_id IN (SELECT site_id FROM gt)")
def drop_genotypes(spark: SparkSession, d: str) -> DataFrame:
    return O.drop_genotypes(frame(spark, d)).select("site_id", F.size("samples").alias("n_samples"), F.size("format").alias("n_format"))


@query("SELECT site_id, CASE WHEN len(alts) = 0 THEN '<*>' ELSE array_to_string(alts, ',') END AS alt FROM site")
def trim_symbolic(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).withColumn("alts", F.concat("alts", F.array(F.lit("<*>"))))
    return O.trim_symbolic(s).select("site_id", F.array_join("alts", ",").alias("alt"))


@query("SELECT site_id, array_to_string(list_transform(filters, lambda f: CASE WHEN f = 'q10' THEN 'lowq' ELSE f END), ';') AS filter, CAST(dp AS VARCHAR) AS depth FROM site WHERE site_id IN (SELECT site_id FROM gt)")
def rename_annotations(spark: SparkSession, d: str) -> DataFrame:
    f = O.rename_annotations(frame(spark, d), {"INFO/DP": "DEPTH", "FILTER/q10": "lowq", "FORMAT/GQ": "Q"})
    return f.select("site_id", F.array_join("filters", ";").alias("filter"), F.col("info")["DEPTH"][0].alias("depth"))


@query("SELECT site_id, CASE sample WHEN 'S1' THEN 'first' WHEN 'S7' THEN 'last' ELSE sample END AS sample FROM gt")
def reheader_samples(spark: SparkSession, d: str) -> DataFrame:
    return O.rename_samples(genotypes(spark, d), {"S1": "first", "S7": "last"}).select("site_id", "sample")


@query(f"SELECT site_id, sample, CASE (sample_id % 3) WHEN 0 THEN '.' WHEN 1 THEN coalesce('' || a0, '.') ELSE CASE WHEN ploidy = 1 THEN coalesce('' || a0, '.') || CASE WHEN phased THEN '|' ELSE '/' END || coalesce('' || a0, '.') ELSE {_GT.format('a0', 'a1')} END END AS gt FROM gt")
def fix_ploidy(spark: SparkSession, d: str) -> DataFrame:
    return call(O.fix_ploidy(genotypes(spark, d), F.col("sample_id") % 3)).select("site_id", "sample", "gt")


@query("""SELECT g.site_id, count(*) FILTER (a0 = 0) + count(*) FILTER (a1 = 0) AS n_ref FROM gt g JOIN (SELECT *, substr('ACGT', 1 + pos % 4, 1) AS base, translate(alts[1], 'ACGT', 'TGCA') AS ca, translate(ref, 'ACGT', 'TGCA') AS cr FROM site) s ON s.site_id = g.site_id
WHERE NOT (kind = 'snp' AND len(alts) = 1 AND ref <> base AND (alts[1] = base OR (cr <> base AND ca = base))) GROUP BY g.site_id
UNION ALL SELECT g.site_id, count(*) FILTER (a0 = 1) + count(*) FILTER (a1 = 1) AS n_ref FROM gt g JOIN (SELECT *, substr('ACGT', 1 + pos % 4, 1) AS base, translate(alts[1], 'ACGT', 'TGCA') AS ca, translate(ref, 'ACGT', 'TGCA') AS cr FROM site) s ON s.site_id = g.site_id
WHERE kind = 'snp' AND len(alts) = 1 AND ref <> base AND (alts[1] = base OR (cr <> base AND ca = base)) GROUP BY g.site_id""")
def norm_swap_genotypes(spark: SparkSession, d: str) -> DataFrame:
    base = F.substring(F.lit("ACGT"), (1 + F.col("pos") % 4).cast("int"), F.lit(1))
    _, g = O.orient_to_reference(sites(spark, d), genotypes(spark, d), base)
    return g.select("site_id", F.explode("alleles").alias("a")).groupBy("site_id").agg(F.count_if(F.col("a") == 0).alias("n_ref"))


@query("""SELECT site_id, chrom, pos, ref, alt, CAST(i AS INT) AS allele FROM (SELECT *, unnest(alts) AS alt, unnest(range(1, len(alts) + 1)) AS i FROM site WHERE kind <> 'mnp')
UNION ALL SELECT site_id, chrom, pos, substr(ref, 1, 1), substr(alts[1], 1, 1), 1 FROM site WHERE kind = 'mnp' AND substr(ref, 1, 1) <> substr(alts[1], 1, 1)
UNION ALL SELECT site_id, chrom, pos + 1, substr(ref, 2, 1), substr(alts[1], 2, 1), 1 FROM site WHERE kind = 'mnp' AND substr(ref, 2, 1) <> substr(alts[1], 2, 1)""")
def atomize_alleles(spark: SparkSession, d: str) -> DataFrame:
    return N.atomize(sites(spark, d)).select("site_id", "chrom", "pos", "ref", "alt", "allele")


def _reference(spark: SparkSession, d: str) -> DataFrame:
    return C.synthetic_reference(sites(spark, d).select("chrom").distinct(), CONTIG, F.expr("substring('ACGT', cast(1 + pos % 4 as int), 1)"))


@query("SELECT site_id, CASE WHEN length(ref) = 1 THEN substr('ACGT', 1 + pos % 4, 1) ELSE ref END AS ref FROM site")
def fill_from_fasta(spark: SparkSession, d: str) -> DataFrame:
    return N.fill_from_reference(sites(spark, d), _reference(spark, d)).select("site_id", "ref")


@query("SELECT site_id, substr('ACGT', 1 + pos % 4, 1) || CASE WHEN pos < 100000 THEN substr('ACGT', 1 + (pos + 1) % 4, 1) ELSE '' END AS base FROM site WHERE pos % 65536 <> 0")
def reference_bases(spark: SparkSession, d: str) -> DataFrame:
    return C.bases_at(sites(spark, d).where("pos % 65536 <> 0"), _reference(spark, d), 2).select("site_id", "base")


@query("SELECT site_id, sample, round(pow(10, -gq / 100.0::DOUBLE) / t, 4) AS p0, round(pow(10, -dp / 100.0::DOUBLE) / t, 4) AS p1, round(0.5::DOUBLE / t, 4) AS p2 FROM (SELECT *, pow(10, -gq / 100.0::DOUBLE) + pow(10, -dp / 100.0::DOUBLE) + 0.5 AS t FROM gt)")
def gl_to_gp(spark: SparkSession, d: str) -> DataFrame:
    gl = F.array(-F.col("gq") / 100, -F.col("dp") / 100, F.log10(F.lit(0.5)))
    p = O.gl_to_gp(gl)
    return genotypes(spark, d).select("site_id", "sample", *(F.round(F.get(p, F.lit(i)).cast("double"), 4).alias(f"p{i}") for i in range(3)))


@query("SELECT site_id, sample, dp || ',.,' || ad1 AS r, dp || ',.,.,' || ad1 || ',.,' || gq AS g FROM gt")
def localized_to_full(spark: SparkSession, d: str) -> DataFrame:
    show = lambda v: F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
    laa = F.array(F.lit(2))
    r = N.localized_to_full(F.array("dp", F.get("ad", F.lit(1))), laa, F.lit(3), "R")
    g = N.localized_to_full(F.array("dp", F.get("ad", F.lit(1)), "gq"), laa, F.lit(3), "G")
    return genotypes(spark, d).select("site_id", "sample", show(r).alias("r"), show(g).alias("g"))


@query("SELECT site_id, CAST(1 AS INT) AS n_info, 'DP,GT' AS tags FROM site WHERE site_id IN (SELECT site_id FROM gt)")
def split_keep_tags(spark: SparkSession, d: str) -> DataFrame:
    f = O.keep_tags(frame(spark, d), ["DP"], ["GT", "DP"])
    return f.select("site_id", F.size("info").alias("n_info"), F.array_join(F.array_sort("format"), ",").alias("tags"))


@query("""SELECT g.site_id, sample, dp || ',' || gq AS r, CASE WHEN k = 2 THEN gq || '' ELSE dp || '' END AS a, dp || ',' || CASE WHEN k = 2 THEN ad0 || ',' || ad1 ELSE gq || ',' || (dp + gq) END AS v FROM (SELECT *, 1 + CAST(site_id % 2 AS INT) AS k FROM gt) g""")
def remap_vectors(spark: SparkSession, d: str) -> DataFrame:
    kept = F.array(F.lit(0), (1 + F.col("site_id") % 2).cast("int"))
    show = lambda v: F.array_join(v.cast("array<string>"), ",")
    reads = [F.get("ad", F.lit(i)) for i in (0, 1)]
    full = F.array(F.col("dp"), F.col("gq"), F.col("dp") + F.col("gq"), reads[0], F.lit(-1), reads[1])
    even = F.col("site_id") % 2 == 1
    return genotypes(spark, d).select(
        "site_id", "sample", show(O.pick_by_number(F.when(even, F.array(F.col("dp"), F.lit(-1), F.col("gq"))).otherwise(F.array(F.col("dp"), F.col("gq"), F.lit(-1))), kept, "R")).alias("r"),
        show(O.pick_by_number(F.array("dp", "gq"), kept, "A")).alias("a"), show(O.pick_by_number(full, kept, "G")).alias("v"),
    )


@query("SELECT site_id, sample, CAST(x * (x + 1) // 2 + y AS INT) AS slot, CAST((x + 1) * (x + 2) // 2 AS INT) AS n FROM (SELECT *, greatest(gq % 5, dp % 4) AS x, least(gq % 5, dp % 4) AS y FROM gt)")
def genotype_slots(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("gq") % 5).cast("int"), (F.col("dp") % 4).cast("int")
    return genotypes(spark, d).select("site_id", "sample", V.genotype_index(a, b).alias("slot"), V.genotype_count(F.greatest(a, b) + 1).alias("n"))


@query("SELECT site_id, sample, CASE WHEN a0 IS NULL THEN '.' ELSE '' || a0 END || CASE WHEN ploidy = 1 THEN '' ELSE ' ' || CASE WHEN a1 IS NULL THEN '.' ELSE '' || a1 END END AS parsed, phased OR ploidy = 1 AS phase FROM gt")
def gt_parse(spark: SparkSession, d: str) -> DataFrame:
    t = call(genotypes(spark, d)).select("site_id", "sample", "gt")
    return t.select("site_id", "sample", F.array_join(F.transform(G.parse(F.col("gt")), lambda x: F.coalesce(x.cast("string"), F.lit("."))), " ").alias("parsed"), G.is_phased(F.col("gt")).alias("phase"))


_SETGT = "CASE WHEN {hit} THEN {new} ELSE " + _GT.format("a0", "a1") + " END"


@query("SELECT site_id, sample, " + _SETGT.format(hit="a0 IS NULL AND a1 IS NULL", new=_GT.format("0", "0")) + " AS gt FROM gt")
def setgt_all_missing(spark: SparkSession, d: str) -> DataFrame:
    return call(O.set_genotypes(genotypes(spark, d), "./.", "0")).select("site_id", "sample", "gt")


@query("SELECT site_id, sample, CASE WHEN ploidy = 1 THEN coalesce('' || a0, '.') ELSE coalesce('' || a1, '.') || CASE WHEN phased THEN '|' ELSE '/' END || coalesce('' || a0, '.') END AS gt FROM gt")
def setgt_inverted(spark: SparkSession, d: str) -> DataFrame:
    return call(O.set_genotypes(genotypes(spark, d), "a", "i")).select("site_id", "sample", "gt")


@query("SELECT site_id, sample, CASE WHEN gq < 20 THEN '0|1' ELSE " + _GT.format("a0", "a1") + " END AS gt FROM gt")
def setgt_custom(spark: SparkSession, d: str) -> DataFrame:
    return call(O.set_genotypes(genotypes(spark, d), compile_filter("GQ<20", sample=True), "c:0|1")).select("site_id", "sample", "gt")


@query("SELECT g.site_id, sample, CASE WHEN ploidy = 1 THEN coalesce('' || a0, '.') ELSE coalesce('' || a0, '.') || '|' || coalesce('' || a1, '.') END AS gt FROM gt g")
def setgt_phased(spark: SparkSession, d: str) -> DataFrame:
    return call(O.set_genotypes(genotypes(spark, d), "a", "p")).select("site_id", "sample", "gt")


@query("SELECT site_id, sample, CASE WHEN sample IN ('S2', 'S4') AND gq < 50 THEN " + _GT.format("0", "0") + " ELSE " + _GT.format("a0", "a1") + " END AS gt FROM gt")
def setgt_some_samples(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d)
    return call(O.set_genotypes(g, compile_filter("GQ<50", sample=True) & F.col("sample").isin("S2", "S4"), "0")).select("site_id", "sample", "gt")


@query(", c AS (SELECT chrom, id, list_distinct(list(site_id)) AS s FROM site WHERE id IS NOT NULL GROUP BY ALL) SELECT chrom, pos, coalesce(id, ref || '>' || array_to_string(alts, ',')) AS what, min(site_id) AS site_id FROM site GROUP BY 1, 2, 3")
def isec_collapse_id(spark: SparkSession, d: str) -> DataFrame:
    g = J.groups([sites(spark, d)], "id")
    return g.select("chrom", "pos", "what", F.try_element_at("sites", F.lit(0)).alias("site_id"))


@query("SELECT input || ':' || sample AS sample FROM (SELECT DISTINCT sample FROM gt) CROSS JOIN (VALUES (2), (3)) v(input) UNION ALL SELECT DISTINCT sample FROM gt")
def merge_force_samples(spark: SparkSession, d: str) -> DataFrame:
    names = tuple(sorted(r["sample"] for r in genotypes(spark, d).select("sample").distinct().collect()))  # a header's samples
    merged = merge_headers([Header(samples=names)] * 3, force_samples=True)
    return spark.createDataFrame([(s,) for s in merged.samples], "sample string")


# merging

_PRECISE = "CASE WHEN length(ref) = 1 AND length(a) = 1 THEN 'snp' WHEN length(a) > length(ref) AND starts_with(a, ref) THEN 'ins' WHEN length(ref) > length(a) AND starts_with(ref, a) THEN 'del' ELSE 'other' END"
_EXACT = "'=' || ref || '>' || array_to_string(alts, ',')"
_KEYS = {
    "none": _EXACT,
    "all": "''",
    "id": f"coalesce('id ' || id, {_EXACT})",
    "snp-ins-del": f"CASE WHEN len(kinds) = 1 AND kinds[1] <> 'other' THEN kinds[1] ELSE {_EXACT} END",
    "both": f"CASE WHEN kinds = ['snp'] THEN 'snp' WHEN len(kinds) > 0 AND len(list_filter(kinds, lambda k: k NOT IN ('ins', 'del'))) = 0 THEN 'indel' ELSE {_EXACT} END",
    "snps": f"CASE WHEN kinds = ['snp'] THEN 'snp' ELSE {_EXACT} END",
}
#: Records of both inputs by the groups that they merge in: mref is the group's REF, part tells apart those whose REFs don't fit.
_MERGE = """, u AS (SELECT *, 0 AS input FROM site {where} UNION ALL SELECT *, 1 FROM site2 {where}),
w AS (SELECT *, list_sort(list_distinct(list_transform(alts, lambda a: {precise}))) AS kinds FROM u), c AS (SELECT *, {key} AS mkey FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, mkey, input ORDER BY site_id) AS turn FROM c),
l AS (SELECT chrom, pos, mkey, turn, max(length(ref)) AS n FROM t GROUP BY ALL),
h AS (SELECT t.chrom, t.pos, t.mkey, t.turn, max(t.ref) AS top FROM t JOIN l ON t.chrom = l.chrom AND t.pos = l.pos AND t.mkey = l.mkey AND t.turn = l.turn AND length(t.ref) = l.n GROUP BY ALL),
g AS (SELECT t.*, h.top, bool_and(starts_with(h.top, t.ref)) OVER (PARTITION BY t.chrom, t.pos, t.mkey, t.turn) AS fit FROM t JOIN h ON t.chrom = h.chrom AND t.pos = h.pos AND t.mkey = h.mkey AND t.turn = h.turn),
r AS (SELECT *, CASE WHEN fit THEN '' ELSE input || ' ' || site_id END AS part, CASE WHEN fit THEN top ELSE ref END AS mref FROM g),
"""
_MODE = _MERGE + """x AS (SELECT *, unnest(range(len(alts))) AS i, unnest(alts) AS x FROM r),
p AS (SELECT chrom, pos, mkey, turn, part, CASE WHEN starts_with(x, '<') THEN x ELSE x || substr(mref, length(ref) + 1) END AS x, min(input * 1e12 + site_id * 10 + i) AS o FROM x GROUP BY 1, 2, 3, 4, 5, 6),
s AS (SELECT chrom, pos, mkey, turn, part, string_agg(x, ',' ORDER BY o) AS alt FROM p GROUP BY ALL), n AS (SELECT chrom, pos, mkey, turn, part, mref, count(*) AS n_inputs, max(qual) AS qual, sum(dp) AS dp FROM r GROUP BY ALL)
SELECT n.chrom, n.pos, n.mref AS ref, coalesce(s.alt, '') AS alt, CAST(n.n_inputs AS INT) AS n_inputs, n.qual, CAST(n.dp AS VARCHAR) AS dp FROM n LEFT JOIN s ON n.chrom = s.chrom AND n.pos = s.pos AND n.mkey = s.mkey AND n.turn = s.turn AND n.part = s.part"""


def bare(s: DataFrame) -> DataFrame:
    """Sites as a frame without samples."""
    return s.withColumn("info", F.create_map(F.lit("DP"), F.array(F.col("dp").cast("string")))).withColumn("format", F.array().cast("array<string>")).withColumn("samples", F.array().cast(SAMPLES))


def _by_mode(mode: str) -> None:
    def merged(spark: SparkSession, d: str) -> DataFrame:
        m = M.merge([bare(sites(spark, d)), bare(second_input(spark, d))], mode)
        return m.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), F.size("inputs").alias("n_inputs"), "qual", F.col("info")["DP"][0].alias("dp"))

    query(_MODE.format(where="", precise=_PRECISE, key=_KEYS[mode]), "merge_mode_" + mode.replace("-", "_"))(merged)


for _mode in _KEYS:
    _by_mode(_mode)


_CALLED = "WHERE site_id IN (SELECT site_id FROM gt)"


@query(_MERGE.format(where=_CALLED, precise=_PRECISE, key="''") + """v AS (SELECT r.chrom, r.pos, g.sample || CASE input WHEN 1 THEN 'b' ELSE '' END AS sample, r.mref AS allele, g.ad0 AS reads, r.part, r.turn FROM r JOIN gt g ON g.site_id = r.site_id
UNION ALL SELECT r.chrom, r.pos, g.sample || CASE input WHEN 1 THEN 'b' ELSE '' END, CASE WHEN starts_with(r.alts[1], '<') THEN r.alts[1] ELSE r.alts[1] || substr(mref, length(ref) + 1) END, g.ad1, r.part, r.turn FROM r JOIN gt g ON g.site_id = r.site_id WHERE len(r.alts) > 0)
SELECT chrom, pos, sample, allele, CAST(reads AS BIGINT) AS reads FROM v""")
def merge_arg(spark: SparkSession, d: str) -> DataFrame:
    """Reads by allele of merged records: a vector of Number R."""
    a = frame(spark, d)
    other = frame(spark, d, second_input(spark, d)).withColumn("samples", F.transform("samples", lambda s: s.withField("sample", F.concat(s["sample"], F.lit("b")))))
    m = M.merge([a, other], "all", {"FORMAT/AD": "R"})
    alleles = F.concat(F.array("ref"), F.col("alts"))
    each = F.flatten(F.transform("samples", lambda s: F.zip_with(alleles, s["fmt"]["AD"], lambda x, n: F.struct(s["sample"].alias("sample"), x.alias("allele"), number(n, "long").alias("reads")))))
    return m.select("chrom", "pos", F.explode(each).alias("x")).select("chrom", "pos", "x.*").where("reads is not null")


@query(_MERGE.format(where=_CALLED, precise=_PRECISE, key="''") + """al2 AS (SELECT r.*, unnest([ref] || alts) AS x, unnest(range(len(alts) + 1)) AS i FROM r),
pd AS (SELECT *, CASE WHEN i = 0 THEN mref WHEN starts_with(x, '<') THEN x ELSE x || substr(mref, length(ref) + 1) END AS y FROM al2)
SELECT r.chrom, r.pos, g.sample || CASE input WHEN 1 THEN 'b' ELSE '' END AS sample, coalesce((SELECT y FROM pd WHERE pd.site_id = r.site_id AND pd.input = r.input AND pd.i = g.a0), '.') AS first
FROM r JOIN gt g ON g.site_id = r.site_id""")
def merge_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """The base of each first allele, by merged indices."""
    other = frame(spark, d, second_input(spark, d)).withColumn("samples", F.transform("samples", lambda s: s.withField("sample", F.concat(s["sample"], F.lit("b")))))
    m = M.merge([frame(spark, d), other], "all")
    alleles = F.concat(F.array("ref"), F.col("alts"))
    each = F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), F.coalesce(F.get(alleles, F.get(s["alleles"], F.lit(0))), F.lit(".")).alias("first")))
    return m.select("chrom", "pos", F.explode(each).alias("x")).select("chrom", "pos", "x.*")


@query(""", blk AS (SELECT site_id, chrom, pos, "end" AS e, 0 AS input FROM site WHERE kind = 'sym' UNION ALL SELECT site_id, chrom, pos + 3, "end" + 5, 1 FROM site WHERE kind = 'sym' AND site_id % 2 = 0),
var AS (SELECT site_id, chrom, pos FROM site WHERE kind = 'snp' AND site_id % 5 = 0), pts AS (SELECT chrom, pos AS p FROM blk UNION SELECT chrom, e + 1 FROM blk UNION SELECT chrom, pos FROM var UNION SELECT chrom, pos + 1 FROM var)
SELECT CAST(input AS INT) AS input, site_id, blk.chrom, p AS pos FROM blk JOIN pts ON pts.chrom = blk.chrom AND p >= blk.pos AND p <= e UNION ALL SELECT 1, site_id, chrom, pos FROM var""")
def merge_gvcf(spark: SparkSession, d: str) -> DataFrame:
    """Reference blocks of two inputs cut at each other's edges and variants."""
    s = sites(spark, d).select("site_id", "chrom", "pos", "ref", "alts", "end")
    a = s.where("end is not null").withColumn("alts", F.array(F.lit("<*>")))
    b = a.where("site_id % 2 = 0").withColumn("pos", F.col("pos") + 3).withColumn("end", F.col("end") + 5)
    snps = s.where(V.class_label(V.variant_class(F.col("ref"), F.col("alts"))) == "snp").where("site_id % 5 = 0")
    cut = M.expand_reference_blocks([a, b.unionByName(snps)])
    return cut[0].withColumn("input", F.lit(0)).unionByName(cut[1].withColumn("input", F.lit(1))).select("input", "site_id", "chrom", "pos")


@query(", i AS (SELECT chrom, pos, CASE WHEN pos <= 40000 THEN 0 WHEN pos <= 70000 THEN 1 ELSE 2 END AS input FROM site UNION ALL SELECT chrom, pos, 1 FROM site WHERE pos BETWEEN 39000 AND 39500), s AS (SELECT chrom, input, min(pos) AS lo, max(pos) AS hi FROM i GROUP BY ALL) SELECT a.chrom, CAST(a.input AS INT) AS first, CAST(b.input AS INT) AS second FROM s a JOIN s b ON a.chrom = b.chrom AND b.input = a.input + 1 AND b.lo <= a.hi")
def concat_overlaps(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    return J.overlapping_inputs([s.where("pos <= 40000"), s.where("(pos > 40000 and pos <= 70000) or pos between 39000 and 39500"), s.where("pos > 70000")])


@query("SELECT site_id, row_number() OVER (ORDER BY chrom, pos, lower(ref), lower(array_to_string(alts, ',')), site_id) AS nth FROM site")
def sort_by_name(spark: SparkSession, d: str) -> DataFrame:
    return J.numbered(J.sort_sites(sites(spark, d), names=True).select("site_id"), scratch_path(spark, "sorted")).select("site_id", F.col("nth").cast("long").alias("nth"))


@query("SELECT chrom, pos, CASE WHEN 2 = 2 THEN ref || '>' || array_to_string(alts, ',') END AS what, '11' AS inputs FROM site s WHERE EXISTS (SELECT 1 FROM site2 t WHERE t.chrom = s.chrom AND t.pos = s.pos AND t.ref = s.ref AND t.alts = s.alts)")
def isec_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "isec")
    inputs = [bare(sites(spark, d)), bare(second_input(spark, d))]
    h = header_of(spark, d).with_samples()
    sinks.write_intersection_files(inputs, [h, h], path, 2)
    # by the text of the alleles as it stands in the files
    first, second = (bgzf.read_vcf_gz(spark, f"{path}/000{i}")[1].groupBy(*J.collapse_key()).agg(F.count("*").alias(f"n{i}")) for i in (0, 1))
    seen = spark.read.option("sep", "\t").csv(f"{path}/sites", schema="chrom string, pos long, what string, inputs string")
    at = ["chrom", "pos", "what"]
    met = seen.join(first, at).join(second, at)
    return met.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("n0").cast("int")))).select(*at, "inputs")


# computed tags and consequences


@query(_PER + "SELECT site_id, CAST(2 * good + 1 AS DOUBLE) AS x, s / n AS y, CAST(mis AS DOUBLE) / n AS z FROM per")
def fill_expressions(spark: SparkSession, d: str) -> DataFrame:
    f = TG.fill_expressions(frame(spark, d), {"X": "2*N_PASS(GQ>50)+1", "Y": "AVG(FMT/DP)", "Z": "F_MISSING"})
    return f.select("site_id", *(F.col("info")[t][0].cast("double").alias(t.lower()) for t in "XYZ"))


_VEP = """, c AS (SELECT o_orderkey AS site_id, o_orderkey % 4 AS k FROM orders), t AS (SELECT site_id, unnest([
  {'g': 'G1', 'c': 'intron_variant', 's': 12, 'can': '', 'pick': '1', 'n': 0}, {'g': 'G2', 'c': 'missense_variant', 's': 24, 'can': CASE WHEN k = 0 THEN 'YES' ELSE '' END, 'pick': '', 'n': 1},
  {'g': 'G3', 'c': 'synonymous_variant&stop_gained', 's': 33, 'can': CASE WHEN k = 1 THEN 'YES' ELSE '' END, 'pick': '', 'n': 2}, {'g': 'G4', 'c': 'synonymous_variant', 's': 21, 'can': CASE WHEN k < 2 THEN 'YES' ELSE '' END, 'pick': '', 'n': 3}]) AS x FROM c)
"""


def _consequences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    yes = lambda c: F.when(c, "YES").otherwise("")
    each = [F.lit("A|intron_variant|G1||1"), F.concat(F.lit("A|missense_variant|G2|"), yes(k == 0), F.lit("|")), F.concat(F.lit("A|synonymous_variant&stop_gained|G3|"), yes(k == 1), F.lit("|")), F.concat(F.lit("A|synonymous_variant|G4|"), yes(k < 2), F.lit("|"))]
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("site_id"), F.concat_ws(",", *each).alias("csq"))


_VEP_FIELDS = ["Allele", "Consequence", "Gene", "CANONICAL", "PICK"]


@query(_VEP + "SELECT site_id, x.g AS \"Gene\", x.c AS \"Consequence\" FROM t WHERE x.can = 'YES'")
def split_vep_primary(spark: SparkSession, d: str) -> DataFrame:
    return O.select_consequences(_consequences(spark, d), "csq", _VEP_FIELDS, ("site_id",), "primary").select("site_id", "Gene", "Consequence")


@query(_VEP + "SELECT site_id, x.g AS \"Gene\" FROM t WHERE x.s >= 21 AND x.can = ''")
def split_vep_threshold(spark: SparkSession, d: str) -> DataFrame:
    return O.select_consequences(_consequences(spark, d), "csq", _VEP_FIELDS, ("site_id",), "CANONICAL=", "synonymous_variant+").select("site_id", "Gene")


@query(_VEP + "SELECT site_id, string_agg(x.g || ':' || x.c, ' ' ORDER BY x.n) AS line FROM t WHERE x.s <= 24 GROUP BY site_id")
def split_vep_template(spark: SparkSession, d: str) -> DataFrame:
    t = O.select_consequences(_consequences(spark, d), "csq", _VEP_FIELDS, ("site_id",), "all", "missense_variant-")
    return O.join_transcripts(t, "%Gene:%Consequence", ("site_id",), " ")


@query(_VEP + "SELECT site_id, x.g AS \"Gene\" FROM t WHERE x.pick = '1'")
def split_vep_pick(spark: SparkSession, d: str) -> DataFrame:
    return O.select_consequences(_consequences(spark, d), "csq", _VEP_FIELDS, ("site_id",), "pick").select("site_id", "Gene")


# sources and sinks


def header_of(spark: SparkSession, d: str) -> Header:
    h = Header(fields={"contig": {f"chr{i}": {} for i in range(1, 6)}, "FILTER": {"LowQual": {"Description": '"x"'}, "q10": {"Description": '"x"'}}}, samples=tuple(f"S{i}" for i in range(1, 8)))
    for kind, tag, number, of in (("INFO", "DP", "1", "Integer"), ("INFO", "END", "1", "Integer"), ("FORMAT", "GT", "1", "String"), ("FORMAT", "DP", "1", "Integer"), ("FORMAT", "GQ", "1", "Integer"), ("FORMAT", "AD", "R", "Integer")):
        h = h.with_field(kind, tag, number, of, "x")
    return h


def full_frame(spark: SparkSession, d: str) -> DataFrame:
    """The frame with all seven samples at each site, absent ones missing, as a file needs it."""
    found = lambda n: F.get(F.filter("samples", lambda s: s["sample"] == n), F.lit(0))
    f = frame(spark, d)
    none = F.struct(F.lit("").alias("sample"), F.lit(".").alias("gt_raw"), F.array(F.lit(None).cast("int")).alias("alleles"), F.lit(False).alias("phased"), F.create_map(F.lit("DP"), F.array(F.lit(".")), F.lit("GQ"), F.array(F.lit(".")), F.lit("AD"), F.array(F.lit("."))).alias("fmt"))
    return f.withColumn("samples", F.array(*(F.coalesce(found(f"S{i}"), none.withField("sample", F.lit(f"S{i}"))) for i in range(1, 8))))


_FILE = """, f AS (SELECT s.chrom, s.pos, s.id, s.ref, array_to_string(s.alts, ',') AS alt, s.qual, array_to_string(s.filters, ';') AS filter, CAST(s.dp AS VARCHAR) AS dp, s."end",
  CAST(sum(g.dp) AS BIGINT) AS sample_dp, CAST(sum(g.ad1) AS BIGINT) AS alt_reads, CAST(sum((a0 IS NOT NULL)::INT + (a1 IS NOT NULL)::INT) AS BIGINT) AS an, count(*) FILTER (phased OR ploidy = 1) AS n_phased
  FROM site s JOIN gt g ON g.site_id = s.site_id GROUP BY s.site_id, s.chrom, s.pos, s.id, s.ref, s.alts, s.qual, s.filters, s.dp, s."end")
SELECT * FROM f"""


def _seen(read: DataFrame) -> DataFrame:
    """What a file that was read back holds, in the columns of the oracle."""
    value = lambda s, k, i: number(F.get(s["fmt"][k], F.lit(i)), "long")
    total = lambda f: F.aggregate(F.transform("samples", f), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long")))
    present = lambda s: value(s, "DP", 0).isNotNull()
    return read.select(
        "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), "qual", F.array_join("filters", ";").alias("filter"), F.col("info")["DP"][0].alias("dp"), "end",
        total(lambda s: value(s, "DP", 0)).alias("sample_dp"), total(lambda s: value(s, "AD", 1)).alias("alt_reads"), total(lambda s: F.size(G.called(s["alleles"])).cast("long")).alias("an"),
        F.size(F.filter("samples", lambda s: present(s) & (s["phased"] | (F.size(s["alleles"]) == 1)))).cast("long").alias("n_phased"),
    )


@query(_FILE)
def vcf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "vcf")
    write_vcf(full_frame(spark, d), header_of(spark, d), path)
    return _seen(read_vcf(spark, path)[1])


@query(_FILE)
def vcf_gz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "vcfgz")
    bgzf.write_vcf_gz(full_frame(spark, d), header_of(spark, d), path)
    return _seen(bgzf.read_vcf_gz(spark, path)[1])


@query(_FILE)
def bcf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "bcf")
    bcf.write_bcf(full_frame(spark, d), header_of(spark, d), path)
    return _seen(bcf.read_bcf(spark, path)[1])


@query("SELECT site_id, pos FROM site WHERE chrom = 'chr2' AND pos BETWEEN 20000 AND 60000")
def store_region(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "store")
    store.write_store(sites(spark, d), path)
    return store.query_region(spark, path, "chr2", 20000, 60000).select("site_id", "pos")


@query("SELECT site_id FROM site WHERE (chrom = 'chr1' AND pos BETWEEN 100 AND 50000) OR (chrom = 'chr3' AND pos = 1112) OR (chrom = 'chr4' AND pos >= 90000) OR chrom = 'chr5'")
def region_texts(spark: SparkSession, d: str) -> DataFrame:
    r = companions.region_list(spark, "{chr1}:100-50,000,chr3:1112,chr4:90000-,chr5".replace("50,000", "50000"))
    return FL.in_regions(sites(spark, d), r.drop("name"), "pos").select("site_id")


@query("SELECT site_id FROM site s WHERE EXISTS (SELECT 1 FROM region r WHERE r.chrom = s.chrom AND s.pos BETWEEN r.start AND r.\"end\")")
def bed_regions(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "regions") + ".bed"
    regions(spark, d).select(F.concat_ws("\t", "chrom", F.col("start") - 1, "end", "name").alias("value")).write.text(path)
    return FL.in_regions(sites(spark, d), companions.read_regions(spark, path).drop("name"), "pos").select("site_id")


@query("SELECT chrom, start, \"end\", 'gene ' || name AS id, 'a;b=' || (name % 7) AS name, CASE WHEN name % 2 = 0 THEN '+' ELSE '-' END AS strand FROM region")
def gff_features(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "gff")
    tags = F.concat(F.lit("ID=gene%20"), F.col("name").cast("string"), F.lit(";Name=a%3Bb%3D"), (F.col("name") % 7).cast("string"))
    strand = F.when(F.col("name") % 2 == 0, "+").otherwise("-")
    regions(spark, d).select(F.concat_ws("\t", "chrom", F.lit("x"), F.lit("gene"), "start", "end", F.lit("."), strand, F.lit("."), tags).alias("value")).write.text(path)
    return companions.read_gff(spark, path).select("chrom", "start", "end", "id", "name", "strand")


@query("SELECT chrom, CAST(1 + 65536 * i AS BIGINT) AS chunk_start, CAST(least(65536, 100000 - 65536 * i) AS INT) AS n, substr('ACGT', CAST(1 + (1 + 65536 * i) % 4 AS INT), 1) AS first FROM (SELECT DISTINCT chrom FROM site) CROSS JOIN (VALUES (0), (1)) v(i)")
def fasta_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    whole = _reference(spark, d).groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", "bases"))), lambda x: x["bases"]), "").alias("seq"))
    lines = C.fasta_lines(whole).groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("value"))
    lines.select("value").write.text(path)
    return companions.read_fasta(spark, path).select("chrom", "chunk_start", F.length("bases").alias("n"), F.substring("bases", 1, 1).alias("first"))


@query("""SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'C,T' WHEN 2 THEN '' ELSE '' END AS alt, CASE o_orderkey % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '1/2' WHEN 2 THEN './.' ELSE '0/0' END AS gt FROM orders""")
def tsv_genotypes(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    aa = F.element_at(F.array(*map(F.lit, ("AC", "CT", "--", "AA"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    o.select(F.concat_ws("\t", F.concat(F.lit("rs"), "o_orderkey"), F.lit("1"), "o_orderkey", aa).alias("value")).write.text(path)
    made = companions.letters_to_genotype(companions.read_tsv(spark, path, "ID,CHROM,POS,AA").withColumn("ref", F.lit("A")))
    return made.select(F.col("pos").cast("long").alias("pos"), F.array_join("alts", ",").alias("alt"), G.render(F.col("alleles"), F.lit(False)).alias("gt"))


@query("""SELECT s.chrom, s.pos, s.ref, s.alts[1] AS alt, g.nth AS sample_id, CASE WHEN a0 IS NULL OR (ploidy = 2 AND a1 IS NULL) THEN '0/0' WHEN (CASE WHEN ploidy = 1 THEN 2 * (a0 > 0)::INT ELSE (a0 > 0)::INT + (a1 > 0)::INT END) = 0 THEN '0/0'
  WHEN (CASE WHEN ploidy = 1 THEN 2 * (a0 > 0)::INT ELSE (a0 > 0)::INT + (a1 > 0)::INT END) = 1 THEN '0/1' ELSE '1/1' END AS gt
FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY site_id) AS k FROM site WHERE len(alts) = 1) s JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY sample_id) AS INT) AS nth FROM gt) g ON g.site_id = s.site_id WHERE k = 1""")
def gen_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "gen")
    companions.gen_rows(genotypes(spark, d), sites(spark, d), O.gt_to_prob3(F.col("alleles"))).select("line").write.text(path)
    return companions.parse_gen(spark.read.text(path).withColumnRenamed("value", "line")).select("chrom", "pos", "ref", "alt", "sample_id", "gt")


@query("""SELECT s.site_id, s.chrom || ':' || s.pos || '_' || s.ref || '_' || s.alts[1] || ' ' || s.pos || ' ' || s.ref || ' ' || s.alts[1] AS legend,
  string_agg(CASE WHEN a0 IS NULL THEN '?' ELSE a0 || CASE WHEN phased OR ploidy = 1 THEN '' ELSE '*' END END || ' ' || CASE WHEN ploidy = 1 THEN '-' WHEN a1 IS NULL THEN '?' ELSE a1 || CASE WHEN phased THEN '' ELSE '*' END END, ' ' ORDER BY sample_id) AS line
FROM site s JOIN gt g ON g.site_id = s.site_id WHERE len(s.alts) = 1 GROUP BY ALL""")
def hap_legend(spark: SparkSession, d: str) -> DataFrame:
    return sinks.hap_rows(genotypes(spark, d), sites(spark, d), legend=True)


@query("""SELECT site_id, sample, CASE WHEN chrom = 'chr5' AND sex = 'M' AND pos BETWEEN 1 AND 60000 THEN 1 WHEN chrom = 'chr5' AND sex = 'F' THEN CASE WHEN pos <= 100000 THEN 0 ELSE 2 END WHEN sex = 'M' THEN 2 ELSE 3 END AS ploidy
FROM (SELECT g.site_id, g.sample, s.chrom, s.pos, CASE WHEN g.sample_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM gt g JOIN site s ON s.site_id = g.site_id)""")
def ploidy_rules(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "ploidy")
    lines = ["# rules", "chr5 1 60000 M 1", "chr5 1 100000 F 0", "* * * M 2", "* * * F 3"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    g = genotypes(spark, d).join(sites(spark, d).select("site_id", "chrom", "pos"), "site_id").withColumn("sex", F.when(F.col("sample_id") % 2 == 0, "F").otherwise("M"))
    return companions.ploidy_at(g, companions.read_ploidy(spark, path)).select("site_id", "sample", F.col("ploidy").cast("int").alias("ploidy"))


@query("SELECT * FROM (VALUES ('f1', 'S1', 'S2', 'S3', 1), ('f1', 'S4', 'S5', 'S6', 2), ('f2', 'S7', NULL, NULL, 1)) v(family, child, father, mother, sex)")
def pedigree(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "ped")
    spark.createDataFrame([(x,) for x in ("#fam", "f1 S1 S2 S3 1", "f1\tS4\tS5\tS6\t2", "f2 S7 0 0 1")], "value string").coalesce(1).write.text(path)
    return companions.read_ped(spark, path).select("family", "child", "father", "mother", "sex")


@query("SELECT sample AS name, count(*) AS n, CAST(sum(dp) AS BIGINT) AS dp FROM gt GROUP BY sample")
def split_files_by_sample(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "split")
    sinks.split_by_sample(genotypes(spark, d), path)
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"), F.sum("dp").alias("dp"))


@query("SELECT section, id, key, CAST(value AS DOUBLE) AS value FROM (SELECT 'C' AS section, chrom AS id, 'n' AS key, count(*) AS value FROM site GROUP BY chrom UNION ALL SELECT 'C', chrom, 'dp', sum(dp) FROM site GROUP BY chrom)")
def tall_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tall("C", sites(spark, d).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("dp").alias("dp")), ["chrom"])


@query("SELECT site_id, sample, CASE WHEN gq + dp = 0 THEN NULL ELSE round((pow(10, -gq / 10.0::DOUBLE) + 2 * pow(10, -dp / 10.0::DOUBLE)) / (1 + pow(10, -gq / 10.0::DOUBLE) + pow(10, -dp / 10.0::DOUBLE)), 6) END AS dosage FROM gt WHERE gq + dp > 0")
def dosage_pl(spark: SparkSession, d: str) -> DataFrame:
    pl = F.array(F.lit(0), F.col("gq"), F.col("dp"))
    return genotypes(spark, d).where("gq + dp > 0").select("site_id", "sample", F.round(TG.dosage_from_likelihoods(pl), 6).alias("dosage"))


@query("SELECT site_id, sample, round(least(-4.34294481903::DOUBLE * ln((gq + 1) / 101.0::DOUBLE), 99.0), 6) AS q FROM gt")
def phred_scale(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("site_id", "sample", F.round(prob.phred((F.col("gq") + 1) / 101), 6).alias("q"))
