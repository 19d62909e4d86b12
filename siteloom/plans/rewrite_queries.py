"""Queries of projections and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import variants as V
from siteloom.functions.template import render_sites
from siteloom.operators import rewrite as O
from siteloom.operators import windows as W
from siteloom.plans.registry import query
from siteloom.plans.relations import genotypes, sites


def call(d: DataFrame) -> DataFrame:
    return d.withColumn("gt", G.render(F.col("alleles"), F.col("phased")))


_SEP = "CASE WHEN phased THEN '|' ELSE '/' END"
_GT = f"CASE WHEN ploidy = 1 THEN coalesce('' || {{0}}, '.') ELSE coalesce('' || {{0}}, '.') || {_SEP} || coalesce('' || {{1}}, '.') END"


@query("SELECT site_id, chrom, pos, ref, array_to_string(alts, ',') AS alt FROM site ORDER BY contig_rank, pos, site_id LIMIT 100")
def head_records(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).orderBy("contig_rank", "pos", "site_id").limit(100)
    return s.select("site_id", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"))


@query("SELECT DISTINCT sample FROM gt")
def list_samples(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("sample").distinct()


@query("""SELECT site_id, sample, CASE WHEN a0 IS NULL THEN '?' ELSE a0 || CASE WHEN phased OR ploidy = 1 THEN '' ELSE '*' END END || ' ' ||
  CASE WHEN ploidy = 1 THEN '-' WHEN a1 IS NULL THEN '?' ELSE a1 || CASE WHEN phased THEN '' ELSE '*' END END AS hap FROM gt""")
def gt_to_hap(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("site_id", "sample", G.hap_pair(F.col("alleles"), F.col("phased")).alias("hap"))


@query("SELECT site_id, chrom, unnest(generate_series(pos, \"end\")) AS pos FROM site WHERE \"end\" IS NOT NULL")
def gvcf_expand(spark: SparkSession, d: str) -> DataFrame:
    return O.expand_blocks(sites(spark, d).where("end is not null")).select("site_id", "chrom", "pos")


@query("SELECT chrom, count(*) AS n FROM site GROUP BY chrom UNION ALL SELECT 'chrEmpty', 0")
def contig_counts(spark: SparkSession, d: str) -> DataFrame:
    contigs = spark.createDataFrame([(f"chr{i}",) for i in range(1, 6)] + [("chrEmpty",)], "chrom string")
    n = sites(spark, d).groupBy("chrom").agg(F.count("*").alias("n"))
    return contigs.join(n, "chrom", "left").select("chrom", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT site_id, (row_number() OVER (ORDER BY contig_rank, pos, site_id) - 1) // 1000 AS chunk FROM site")
def scatter_chunks(spark: SparkSession, d: str) -> DataFrame:
    return W.scatter(sites(spark, d), 1000).select("site_id", F.col("chunk").cast("long").alias("chunk"))


@query("""SELECT site_id, chrom || ':' || pos || ' ' || coalesce(id, '.') || ' ' || ref || '>' || CASE WHEN len(alts) = 0 THEN '.' ELSE array_to_string(alts, ',') END || ' ' || array_to_string(filters, ';') || ' ' || len(alts)
  || ' ' || CASE kind WHEN 'none' THEN 'ref' WHEN 'ins' THEN 'indel' WHEN 'del' THEN 'indel' WHEN 'sym' THEN 'other' ELSE kind END || ' ' || coalesce("end", pos + length(ref) - 1) AS line FROM site""")
def project_core(spark: SparkSession, d: str) -> DataFrame:
    return render_sites(sites(spark, d), r"%CHROM:%POS %ID %REF>%ALT %FILTER %N_ALT %TYPE %END", keep=("site_id",))


@query(f"""SELECT g.site_id, sample, CASE WHEN ploidy = 1 THEN coalesce(b[a0 + 1], '.') ELSE coalesce(b[a0 + 1], '.') || {_SEP} || coalesce(b[a1 + 1], '.') END AS tgt
FROM gt g JOIN (SELECT site_id, [ref] || alts AS b FROM site) s ON g.site_id = s.site_id""")
def translate_gt(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d).join(sites(spark, d).select("site_id", "ref", "alts"), "site_id")
    return g.select("site_id", "sample", G.translate(F.col("alleles"), F.col("phased"), F.col("ref"), F.col("alts")).alias("tgt"))


@query(f"""SELECT s.site_id, chrom || ':' || pos || string_agg(' ' || sample || '=' || {_GT.format('a0', 'a1')} || ':' || g.dp, '' ORDER BY sample_id) AS line
FROM site s JOIN gt g ON s.site_id = g.site_id GROUP BY s.site_id, chrom, pos""")
def sample_loop(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d)
    packed = sites(spark, d).drop("dp").join(g.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "sample", "alleles", "phased", "dp"))).alias("samples")), "site_id")
    return render_sites(packed, r"%CHROM:%POS[ %SAMPLE=%GT:%DP]", keep=("site_id",))


@query("SELECT site_id, CAST(sum(dp) AS BIGINT) AS sum_dp, CAST(sum(dp) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_dp, min(gq) AS min_gq, max(gq) AS max_gq FROM gt GROUP BY site_id")
def fmt_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).groupBy("site_id").agg(F.sum("dp").alias("sum_dp"), (F.sum("dp") / F.count("*")).alias("avg_dp"), F.min("gq").alias("min_gq"), F.max("gq").alias("max_gq"))


@query("SELECT site_id, count(*) FILTER (gq > 50) AS n_pass FROM gt GROUP BY site_id")
def n_pass(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).groupBy("site_id").agg(F.count_if(F.col("gq") > 50).alias("n_pass"))


@query("SELECT site_id, sample, dp FROM gt WHERE sample NOT IN ('S2', 'S5')")
def sample_subset(spark: SparkSession, d: str) -> DataFrame:
    return O.sample_subset(genotypes(spark, d), ["S2", "S5"], exclude=True).select("site_id", "sample", "dp")


@query(""", u AS (SELECT site_id, count(a) AS an, bool_or(a = 1) AS u1, bool_or(a = 2) AS u2, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2 FROM al WHERE a IS NOT NULL GROUP BY site_id)
SELECT s.site_id, array_to_string(list_filter([CASE WHEN u1 THEN alts[1] END, CASE WHEN u2 THEN alts[2] END], lambda x: x IS NOT NULL), ',') AS alt, coalesce(an, 0) AS an,
  array_to_string(list_filter([CASE WHEN u1 THEN '' || n1 END, CASE WHEN u2 THEN '' || n2 END], lambda x: x IS NOT NULL), ',') AS ac FROM site s LEFT JOIN u ON s.site_id = u.site_id""")
def trim_unused_alts(spark: SparkSession, d: str) -> DataFrame:
    s, _ = O.trim_unused_alts(sites(spark, d), genotypes(spark, d))
    return s.select("site_id", F.array_join("alts", ",").alias("alt"), "an", F.array_join(F.col("ac").cast("array<string>"), ",").alias("ac"))


@query("SELECT site_id, CAST(NULL AS VARCHAR) AS id, array_to_string(CASE WHEN len(list_filter(filters, lambda x: x <> 'LowQual')) = 0 THEN ['PASS'] ELSE list_filter(filters, lambda x: x <> 'LowQual') END, ';') AS filter FROM site")
def annotate_remove(spark: SparkSession, d: str) -> DataFrame:
    return O.remove_annotations(sites(spark, d), "ID", "FILTER/LowQual", "INFO/DP").select("site_id", "id", F.array_join("filters", ";").alias("filter"))


@query("SELECT site_id, CASE chrom WHEN 'chr1' THEN '1' WHEN 'chr2' THEN 'two' ELSE chrom END AS chrom FROM site")
def rename_contigs(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("chr1", "1"), ("chr2", "two")], "old string, new string")
    return O.rename_contigs(sites(spark, d), names).select("site_id", "chrom")


@query(f"SELECT site_id, sample, {_GT.format('coalesce(a0, 0)', 'coalesce(a1, 0)')} AS gt FROM gt")
def setgt_missing_to_ref(spark: SparkSession, d: str) -> DataFrame:
    g = genotypes(spark, d)
    made = O.set_genotypes(g, ".", "0")
    half = O.set_genotypes(g, "./x", "0")
    assert made.columns == half.columns
    a = F.transform("alleles", lambda x: F.coalesce(x, F.lit(0)))
    return call(g.withColumn("alleles", a)).select("site_id", "sample", "gt")


_MAJOR = """, m0 AS (SELECT site_id, a, count(*) AS n FROM al WHERE a IS NOT NULL GROUP BY site_id, a),
m AS (SELECT site_id, first(a ORDER BY n DESC, a) AS major FROM m0 GROUP BY site_id)
"""


@query(_MAJOR + f"SELECT g.site_id, sample, CASE WHEN a0 IS NULL OR (ploidy = 2 AND a1 IS NULL) THEN {_GT.format('major', 'major')} ELSE {_GT.format('a0', 'a1')} END AS gt FROM gt g LEFT JOIN m ON g.site_id = m.site_id")
def setgt_major(spark: SparkSession, d: str) -> DataFrame:
    return call(O.set_genotypes(genotypes(spark, d), ".", "M")).select("site_id", "sample", "gt")


@query(_MAJOR + f"SELECT g.site_id, sample, {_GT.format('coalesce(a0, major, 0)', 'coalesce(a1, major, 0)')} AS gt FROM gt g LEFT JOIN m ON g.site_id = m.site_id")
def missing2ref(spark: SparkSession, d: str) -> DataFrame:
    return call(O.missing_to_ref(genotypes(spark, d), major=True)).select("site_id", "sample", "gt")


@query(""", x AS (SELECT *, substr('ACGT', 1 + pos % 4, 1) AS base, translate(ref, 'ACGT', 'TGCA') AS cr, translate(alts[1], 'ACGT', 'TGCA') AS ca FROM site),
f AS (SELECT *, CASE WHEN kind <> 'snp' OR len(alts) <> 1 THEN 'skip' WHEN ref = base THEN 'none' WHEN alts[1] = base THEN 'swap' WHEN cr = base THEN 'flip' WHEN ca = base THEN 'flip,swap' ELSE 'skip' END AS fix FROM x)
SELECT site_id, fix, CASE fix WHEN 'swap' THEN alts[1] WHEN 'flip' THEN cr WHEN 'flip,swap' THEN ca ELSE ref END AS ref,
  CASE fix WHEN 'swap' THEN ref WHEN 'flip' THEN ca WHEN 'flip,swap' THEN cr ELSE array_to_string(alts, ',') END AS alt FROM f""")
def fixref_ref_alt(spark: SparkSession, d: str) -> DataFrame:
    base = F.substring(F.lit("ACGT"), (1 + F.col("pos") % 4).cast("int"), F.lit(1))
    s, _ = O.orient_to_reference(sites(spark, d), genotypes(spark, d), base)
    return s.select("site_id", "fix", "ref", F.array_join("alts", ",").alias("alt"))


@query("""SELECT s.site_id, i AS alt_index, alts[i] AS alt, count(*) FILTER (a0 = i) + count(*) FILTER (a1 = i) AS n_alt FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS i FROM site) s
JOIN gt g ON s.site_id = g.site_id GROUP BY s.site_id, i, alts""")
def split_multiallelic(spark: SparkSession, d: str) -> DataFrame:
    s = O.split_multiallelic(sites(spark, d)).where("alt_index > 0").select("site_id", "alt_index", F.get("alts", F.lit(0)).alias("alt"))
    g = genotypes(spark, d).join(s, "site_id").withColumn("a", F.explode(O.split_genotype(F.col("alleles"), F.col("alt_index"))))
    return g.groupBy("site_id", F.col("alt_index").cast("long").alias("alt_index"), "alt").agg(F.count_if(F.col("a") == 1).alias("n_alt"))


@query("SELECT site_id, sample, CAST(round(gq / 10.0) * 10 AS INT) || ',' || 0 || ',' || CAST(dp * 10 AS INT) AS pl FROM gt")
def gl_to_pl(spark: SparkSession, d: str) -> DataFrame:
    gl = F.array(-F.round(F.col("gq") / 10), F.lit(0.0), -F.col("dp").cast("double"))
    return genotypes(spark, d).select("site_id", "sample", F.array_join(O.gl_to_pl(gl).cast("array<string>"), ",").alias("pl"))


@query("""SELECT site_id, sample, CASE WHEN greatest(gq, dp, 20) < 0.5 * (gq + dp + 20) THEN './.' WHEN gq >= dp AND gq >= 20 THEN '0/0' WHEN dp >= 20 THEN '0/1' ELSE '1/1' END AS gt FROM gt""")
def gp_to_gt(spark: SparkSession, d: str) -> DataFrame:
    gp = F.array(F.col("gq").cast("double"), F.col("dp").cast("double"), F.lit(20.0))
    return genotypes(spark, d).select("site_id", "sample", G.render(O.gp_to_gt(gp, 0.5), F.lit(False)).alias("gt"))


@query("""SELECT site_id, CAST(contig_rank AS BIGINT) * (1::BIGINT << 59) + (pos - 1) * (1::BIGINT << 31) + (1::BIGINT << 27) + (1::BIGINT << 23)
  + ((strpos('ACGT', ref) - 1) * 4 + strpos('ACGT', alts[1]) - 1) * (1::BIGINT << 19) AS key FROM site WHERE kind = 'snp'""")
def variantkey(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).where(V.class_label(V.variant_class(F.col("ref"), F.col("alts"))) == "snp")
    return s.select("site_id", O.variantkey(F.col("contig_rank"), F.col("pos") - 1, F.col("ref"), F.get("alts", F.lit(0))).alias("key"))


_CSQ = "CASE o_orderkey % 3 WHEN 0 THEN 'A|missense_variant|G1,A|intron_variant&stop_gained|G2,A|stop_gained|G3' WHEN 1 THEN 'C|synonymous_variant|G4' ELSE 'T|novel_term|G5,T|intergenic_variant|G6' END"


@query("SELECT o_orderkey AS site_id, CASE o_orderkey % 3 WHEN 0 THEN 'G2' WHEN 1 THEN 'G4' ELSE 'G5' END AS \"Gene\", CASE o_orderkey % 3 WHEN 0 THEN 'intron_variant&stop_gained' WHEN 1 THEN 'synonymous_variant' ELSE 'novel_term' END AS \"Consequence\" FROM orders")
def split_vep_worst(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("site_id"), F.expr(_CSQ).alias("csq"))
    return O.worst_consequence(o, "csq", ["Allele", "Consequence", "Gene"], ("site_id",)).select("site_id", "Gene", "Consequence")


@query("SELECT site_id, sample, CASE WHEN a0 IS NULL OR (ploidy = 2 AND a1 IS NULL) THEN '0.33 0.33 0.33' ELSE CASE (CASE WHEN a0 > 0 THEN 1 ELSE 0 END) + CASE WHEN ploidy = 1 THEN CASE WHEN a0 > 0 THEN 1 ELSE 0 END ELSE CASE WHEN a1 > 0 THEN 1 ELSE 0 END END WHEN 0 THEN '1.0 0.0 0.0' WHEN 1 THEN '0.0 1.0 0.0' ELSE '0.0 0.0 1.0' END END AS probs FROM gt")
def gt_to_prob3(spark: SparkSession, d: str) -> DataFrame:
    return genotypes(spark, d).select("site_id", "sample", F.array_join(O.gt_to_prob3(F.col("alleles")).cast("array<string>"), " ").alias("probs"))


@query("SELECT site_id, CASE kind WHEN 'none' THEN 'ref' WHEN 'ins' THEN 'indel' WHEN 'del' THEN 'indel' WHEN 'sym' THEN 'other' ELSE kind END AS class FROM site")
def variant_class(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("site_id", V.class_label(V.variant_class(F.col("ref"), F.col("alts"))).alias("class"))


@query("SELECT site_id, CAST(CASE kind WHEN 'ins' THEN 2 WHEN 'del' THEN 2 ELSE 0 END AS INT) AS ilen FROM site WHERE kind NOT IN ('none', 'sym')")
def ilen(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("site_id", V.ilen(F.col("ref"), F.col("alts")).alias("ilen")).where("ilen is not null")
