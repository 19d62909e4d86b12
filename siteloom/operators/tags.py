"""Tags computed from genotypes: counts, frequencies, tests, dosages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import prob


def fill_an_ac(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, an, ac): called alleles, and the count of each ALT."""
    n = gt.select("site_id", F.explode("alleles").alias("a")).where("a is not null").groupBy("site_id", "a").agg(F.count("*").alias("n"))
    per = n.groupBy("site_id").agg(F.sum("n").alias("an"), F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("m"))
    out = sites.select("site_id", "alts").join(per, "site_id", "left")
    return out.select("site_id", F.coalesce("an", F.lit(0)).alias("an"), F.transform("alts", lambda _, i: F.coalesce(F.try_element_at("m", i + 1), F.lit(0))).alias("ac"))


def fill_tags(gt: DataFrame, by: tuple[str, ...] = ("site_id",), half_missing_hemi: bool = True) -> DataFrame:
    """For each group: an, ac (non-REF), ac_het, ac_hom, ac_hemi, af, maf, ns, f_missing.

    A homozygous call adds 2 to ac_hom; a heterozygous one 1 to ac_het for each of its ALTs; haploid ones, and half-missing ones unless
    told otherwise, go to ac_hemi. maf is the share of the second most common allele.
    """
    a = F.col("alleles")
    c = G.called(a)
    n_alt = F.size(F.filter(c, lambda x: x > 0))
    dip = F.size(c) == 2
    same = F.get(c, F.lit(0)) == F.get(c, F.lit(1))
    hemi = (F.size(c) == 1) & (F.lit(True) if half_missing_hemi else F.size(a) == 1)
    tall = lambda i: F.sum(F.size(F.filter(c, lambda x: x == i)))
    out = gt.groupBy(*by).agg(
        F.sum(F.size(c)).alias("an"), F.sum(n_alt).alias("ac"),
        F.sum(F.when(dip & ~same, n_alt).otherwise(0)).alias("ac_het"), F.sum(F.when(dip & same, n_alt).otherwise(0)).alias("ac_hom"), F.sum(F.when(hemi, n_alt).otherwise(0)).alias("ac_hemi"),
        *(tall(i).alias(f"_n{i}") for i in range(4)), F.count_if(F.size(c) > 0).alias("ns"), (F.count_if(G.any_missing(a)) / F.count("*")).alias("f_missing"),
    )
    sizes = F.sort_array(F.array(*(F.col(f"_n{i}") for i in range(4))), asc=False)
    share = lambda x: F.when(F.col("an") > 0, x / F.col("an"))
    return out.withColumn("af", share(F.col("ac"))).withColumn("maf", share(F.get(sizes, F.lit(1)))).drop(*(f"_n{i}" for i in range(4)))


def fill_hwe(gt: DataFrame) -> DataFrame:
    """(site_id, hwe, exc_het): exact tests on diploid calls, all ALTs as one."""
    a = F.col("alleles")
    d = gt.where((F.size(a) == 2) & ~G.any_missing(a))
    n = d.groupBy("site_id").agg(F.sum(G.count(a, 0)).alias("r"), F.sum(F.size(F.filter(a, lambda x: x > 0))).alias("v"), F.count_if((F.get(a, F.lit(0)) == 0) != (F.get(a, F.lit(1)) == 0)).alias("h"))
    return n.select("site_id", prob.hwe(F.col("r"), F.col("v"), F.col("h")).alias("hwe"), prob.exc_het(F.col("r"), F.col("v"), F.col("h")).alias("exc_het"))


def fill_vaf(gt: DataFrame) -> DataFrame:
    """Adds ``vaf``: each ALT's share of reads, and ``vaf1``, that of all ALTs; null without reads."""
    total = F.aggregate("ad", F.lit(0), lambda s, x: s + x)
    return gt.withColumn("vaf", F.when(total > 0, F.transform(F.slice("ad", F.lit(2), F.greatest(F.size("ad") - 1, F.lit(0))), lambda x: x / total))).withColumn("vaf1", F.when(total > 0, (total - F.get("ad", F.lit(0))) / total))


def fill_sum(gt: DataFrame, name: str, value: Column) -> DataFrame:
    """(site_id, name): the sum of a sample expression."""
    return gt.groupBy("site_id").agg(F.sum(value).alias(name))


def fill_expressions(sites: DataFrame, tags: dict[str, str]) -> DataFrame:
    """INFO tags of frames read from VCF by expressions over record and samples; a missing value leaves the tag out."""
    from siteloom.functions.expression import compile_value, vcf_scope
    from siteloom.functions.template import number_text

    values = F.array(*(F.struct(F.lit(tag).alias("key"), F.array(number_text(compile_value(text, vcf_scope()).cast("double"))).alias("value")) for tag, text in tags.items()))
    made = F.map_from_entries(F.filter(values, lambda e: F.get(e["value"], F.lit(0)).isNotNull()))
    return sites.withColumn("info", F.map_concat(F.map_filter("info", lambda k, _: ~k.isin(*tags)), made))


def dosage(a: Column) -> Column:
    """Copies of ALT in a call; -1 if an allele is missing."""
    return F.when(G.any_missing(a), F.lit(-1.0)).otherwise(F.size(F.filter(a, lambda x: x > 0)).cast("double"))


def dosage_from_likelihoods(pl: Column) -> Column:
    """Expected copies of ALT from three phred-scaled likelihoods; -1 if any is missing."""
    p = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.exists(pl, lambda x: x.isNull()) | pl.isNull(), F.lit(-1.0)).otherwise((F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2))) / total)
