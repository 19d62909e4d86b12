"""Site and sample statistics: one aggregate for each section, with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import variants as V
from siteloom.operators.intervals import overlaps

# The twelve substitution types in their printed order.
SUBSTITUTIONS = "A>C A>G A>T C>A C>G C>T G>A G>C G>T T>A T>C T>G".split()


def _ref() -> Column:
    return F.col("ref")


def exploded_alts(sites: DataFrame) -> DataFrame:
    """A row for each ALT, with its class and ``nth`` from 0."""
    d = sites.select("*", F.posexplode("alts").alias("nth", "alt"))
    return d.withColumn("class", V.stats_class(_ref(), F.col("alt")))


def summary(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records, those without ALT, with SNPs, MNPs, indels, others, multiallelic sites, multiallelic SNP sites."""
    kinds = F.transform("alts", lambda a: V.stats_class(_ref(), a))
    d = sites.withColumn("_k", kinds)
    has = lambda k: F.count_if(F.array_contains("_k", k))
    return d.groupBy(*(by or [])).agg(
        F.count("*").alias("records"), F.count_if(F.size("alts") == 0).alias("no_alts"), has("snp").alias("snps"), has("mnp").alias("mnps"), has("indel").alias("indels"), has("other").alias("others"),
        F.count_if(F.size("alts") > 1).alias("multiallelic"), F.count_if((F.size("alts") > 1) & F.forall("_k", lambda k: k == "snp")).alias("multiallelic_snps"),
    )


def tstv(sites: DataFrame, *by: str) -> DataFrame:
    """Transitions, transversions and their ratio (0 without transversions), of all ALTs and of first ones."""
    d = exploded_alts(sites).where("class = 'snp'")
    ts, tv, first = V.transition(_ref(), F.col("alt")), V.transversion(_ref(), F.col("alt")), F.col("nth") == 0
    out = d.groupBy(*by).agg(F.count_if(ts).alias("ts"), F.count_if(tv).alias("tv"), F.count_if(ts & first).alias("ts_1st"), F.count_if(tv & first).alias("tv_1st"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("ratio", ratio("ts", "tv")).withColumn("ratio_1st", ratio("ts_1st", "tv_1st"))


def substitutions(sites: DataFrame) -> DataFrame:
    """(type, n) of the twelve substitution types, zeros too."""
    d = exploded_alts(sites).where("class = 'snp'").groupBy(F.concat("ref", F.lit(">"), "alt").alias("type")).agg(F.count("*").alias("n"))
    types = sites.sparkSession.createDataFrame([(t,) for t in SUBSTITUTIONS], "type string")
    return types.join(d, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def by_frequency_bin(sites: DataFrame, af: Column, edges: list[float]) -> DataFrame:
    """ALT classes by the first bin whose edge isn't below AF (missing: 0); above the last edge: the bin after."""
    at = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        at = F.when(F.coalesce(af, F.lit(0.0)) <= edges[i], i).otherwise(at)
    d = exploded_alts(sites.withColumn("bin", at))
    return d.groupBy("bin").agg(F.count_if(F.col("class") == "snp").alias("snps"), F.count_if(F.col("class") == "indel").alias("indels"), F.count_if(~F.col("class").isin("snp", "indel")).alias("others"))


def by_quality(sites: DataFrame) -> DataFrame:
    d = exploded_alts(sites)
    snp = F.col("class") == "snp"
    ts, tv = V.transition(_ref(), F.col("alt")), V.transversion(_ref(), F.col("alt"))
    return d.groupBy("qual").agg(F.count_if(snp).alias("snps"), F.count_if(snp & ts).alias("ts"), F.count_if(snp & tv).alias("tv"), F.count_if(F.col("class") == "indel").alias("indels"))


def indel_lengths(sites: DataFrame, gt: DataFrame) -> DataFrame:
    """Indel length to sites, genotypes that carry the allele, and the mean share of its reads in them."""
    a = exploded_alts(sites).where("class = 'indel'").select("site_id", (F.col("nth") + 1).alias("allele"), (F.length("alt") - F.length("ref")).alias("length"))
    n = a.groupBy("length").agg(F.count("*").alias("sites"))
    g = gt.join(a, "site_id").where(F.exists("alleles", lambda x: x == F.col("allele")))
    vaf = F.when(F.col("dp") > 0, F.get("ad", F.col("allele")) / F.col("dp"))
    per = g.groupBy("length").agg(F.count("*").alias("genotypes"), F.sum(vaf).alias("_s"), F.count(vaf).alias("_n"))
    return n.join(per, "length", "left").select("length", "sites", F.coalesce("genotypes", F.lit(0)).alias("genotypes"), F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("mean_vaf"))


def depth(sites: DataFrame, gt: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """Depth bins (0 below ``low``, then by ``step``, the last above ``high``) to genotypes and sites, with their shares in percent."""
    last = (high - low) // step + 2
    at = lambda c: F.when(c < low, 0).when(c > high, last).otherwise(F.floor((c - low) / step) + 1).cast("int")
    g = gt.groupBy(at(F.col("dp")).alias("bin")).agg(F.count("*").alias("genotypes"))
    s = sites.groupBy(at(F.col("dp")).alias("bin")).agg(F.count("*").alias("sites"))
    d = g.join(s, "bin", "full").select("bin", F.coalesce("genotypes", F.lit(0)).alias("genotypes"), F.coalesce("sites", F.lit(0)).alias("sites"))
    w = Window.partitionBy()
    share = lambda c: 100.0 * F.col(c) / F.sum(c).over(w)
    return d.select("bin", "genotypes", share("genotypes").alias("genotypes_pct"), "sites", share("sites").alias("sites_pct"))


def frameshifts(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """Indels with the first exon (least name) that they touch: bases changed within it, and whether out of frame.

    Indels of one span count once. An exon that begins where another of a lesser name does, and ends no later, is never the first.
    """
    d = exploded_alts(sites).where("class = 'indel'").select("site_id", "chrom", "pos", "ref", "alt", "nth").withColumn("_stop", F.col("pos") + F.length("ref") - 1)
    further = Window.partitionBy("chrom", "start").orderBy(F.desc("end")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = exons.select("chrom", F.coalesce("start", F.lit(1)).cast("long").alias("start"), F.coalesce("end", F.lit(1 << 32)).cast("long").alias("end"), "name")
    e = e.withColumn("_least", F.min("name").over(further)).where("name = _least").select("chrom", "start", "end", "name").distinct()
    hit = overlaps(d.select("chrom", "pos", "_stop").distinct(), e, F.col("pos"), F.col("_stop"))
    inside = F.least("_stop", "end") - F.greatest(F.col("pos") + 1, F.col("start")) + 1
    first = hit.withColumn("len", F.greatest(inside, F.lit(0)).cast("int")).groupBy("chrom", "pos", "_stop").agg(F.min(F.struct("name", "len")).alias("_f"))
    out = d.join(first, ["chrom", "pos", "_stop"], "left")
    changed = F.when(F.length("alt") > F.length("ref"), F.length("alt") - F.length("ref")).otherwise(F.col("_f")["len"])
    return out.select("site_id", "nth", F.col("_f")["name"].alias("exon"), F.when(F.col("_f").isNull(), "na").when(changed % 3 != 0, "out").otherwise("in").alias("frame"))


def singletons(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """ALTs seen once: SNPs, transitions, transversions, indels."""
    d = exploded_alts(sites).join(counts, "site_id").where(F.coalesce(F.try_element_at("ac", F.col("nth") + 1), F.lit(0)) == 1)
    ts, tv = V.transition(_ref(), F.col("alt")), V.transversion(_ref(), F.col("alt"))
    snp = F.col("class") == "snp"
    return d.agg(F.count_if(snp).alias("snps"), F.count_if(snp & ts).alias("ts"), F.count_if(snp & tv).alias("tv"), F.count_if(F.col("class") == "indel").alias("indels"))


def per_sample(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """For each sample: homozygous REF and non-REF, heterozygous, ts, tv, indels, mean depth, haploid REF and ALT, missing."""
    first_alt = F.get("alts", F.lit(0))
    s = sites.select("site_id", V.stats_class(_ref(), first_alt).alias("class"), V.transition(_ref(), first_alt).alias("ts"), V.transversion(_ref(), first_alt).alias("tv"))
    a = F.col("alleles")
    d = gt.join(s, "site_id")
    dip, carries = (F.size(a) == 2) & ~G.any_missing(a), G.is_class(a, "alt")
    same = F.get(a, F.lit(0)) == F.get(a, F.lit(1))
    return d.groupBy("sample").agg(
        F.count_if(G.is_class(a, "RR")).alias("ref_hom"), F.count_if(dip & same & carries).alias("nonref_hom"), F.count_if(dip & ~same).alias("het"),
        F.count_if(carries & F.col("ts")).alias("ts"), F.count_if(carries & F.col("tv")).alias("tv"), F.count_if(carries & (F.col("class") == "indel")).alias("indels"),
        (F.sum("dp") / F.count("*")).alias("avg_depth"), F.count_if(G.is_class(a, "R")).alias("hap_ref"), F.count_if(G.is_class(a, "A")).alias("hap_alt"), F.count_if(G.any_missing(a)).alias("missing"),
    )


def read_share(gt: DataFrame) -> DataFrame:
    """Sample by 21 bins of the ALT reads' share, of genotypes that carry ALT."""
    d = gt.where(G.is_class(F.col("alleles"), "alt") & (F.col("dp") > 0))
    return d.groupBy("sample", F.round(F.get("ad", F.lit(1)) / F.col("dp") / 0.05).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def tstv_by_tag(sites: DataFrame, tag: Column, low: float, high: float, n: int) -> DataFrame:
    """ts and tv of first ALTs by ``n`` equal bins of a value between ``low`` and ``high``; outside goes to the ends."""
    at = F.least(F.greatest(F.floor((tag - low) * n / (high - low)), F.lit(0)), F.lit(n - 1)).cast("int")
    d = exploded_alts(sites.withColumn("bin", at)).where("class = 'snp' and nth = 0 and bin is not null")
    return d.groupBy("bin").agg(F.count_if(V.transition(_ref(), F.col("alt"))).alias("ts"), F.count_if(V.transversion(_ref(), F.col("alt"))).alias("tv"))


def counts(sites: DataFrame, gt: DataFrame) -> DataFrame:
    """Number of samples, SNP, indel, MNP, other and all sites."""
    s = summary(sites).select(F.col("snps"), "indels", "mnps", "others", F.col("records").alias("sites"))
    return s.crossJoin(gt.agg(F.countDistinct("sample").alias("samples")))  # one row each


def allele_lengths(sites: DataFrame) -> DataFrame:
    """(length, n_ref, n_alt, n_sum): sites by length of REF, of first ALT, and of both."""
    both = sites.where("size(alts) > 0").select(F.length("ref").alias("r"), F.length(F.get("alts", F.lit(0))).alias("a"))
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("length")) for k, v in (("r", F.col("r")), ("a", F.col("a")), ("s", F.col("r") + F.col("a")))))).alias("x")).select("x.*")
    return rows.groupBy("length").agg(F.count_if(F.col("k") == "r").alias("n_ref"), F.count_if(F.col("k") == "a").alias("n_alt"), F.count_if(F.col("k") == "s").alias("n_sum"))


def sample_rollup(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """By sample, and for all (null sample): passing, non-REF, RR, AA, het, haploid ALT, SNV, indel, missing genotypes."""
    s = sites.select("site_id", V.stats_class(_ref(), F.get("alts", F.lit(0))).alias("class"))
    a = F.col("alleles")
    alt = G.is_class(a, "alt")
    d = gt.join(s, "site_id").select("sample", "class", G.any_missing(a).alias("mis"), alt.alias("alt"), G.is_class(a, "RR").alias("rr"), G.is_class(a, "AA").alias("aa"), (G.is_class(a, "RA") | G.is_class(a, "aA")).alias("het"), G.is_class(a, "A").alias("hemi"))
    return d.rollup("sample").agg(
        F.count_if(~F.col("mis")).alias("n_pass"), F.count_if("alt").alias("nonref"), F.count_if("rr").alias("rr"), F.count_if("aa").alias("aa"), F.count_if("het").alias("het"), F.count_if("hemi").alias("hemi"),
        F.count_if(F.col("alt") & (F.col("class") == "snp")).alias("snv"), F.count_if(F.col("alt") & (F.col("class") == "indel")).alias("indel"), F.count_if("mis").alias("missing"),
    )


def indel_stats(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """By sample: insertions, deletions, out-of-frame and in-frame among the indels carried (first ALT)."""
    s = exploded_alts(sites).where("class = 'indel' and nth = 0").select("site_id", (F.length("alt") - F.length("ref")).alias("len"))
    d = gt.join(s, "site_id").where(F.exists("alleles", lambda x: x == 1))
    return d.groupBy("sample").agg(F.count_if(F.col("len") > 0).alias("ins"), F.count_if(F.col("len") < 0).alias("del"), F.count_if(F.col("len") % 3 != 0).alias("out_frame"), F.count_if(F.col("len") % 3 == 0).alias("in_frame"))


def frequency_distribution(gt: DataFrame, af: DataFrame, bins: int) -> DataFrame:
    """Histogram of the probability of each diploid genotype (RR, RA, AA) at its site's ``af`` under random mating, in single precision."""
    a = F.col("alleles")
    f = F.col("af").cast("float")
    p = F.when(G.is_class(a, "RR"), (1 - f) * (1 - f)).when(G.is_class(a, "RA"), 2 * f * (1 - f)).when(G.is_class(a, "AA"), f * f).cast("float")
    d = gt.join(af, "site_id").withColumn("p", p).where("p is not null")
    return d.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def shared_genotypes(gt: DataFrame) -> DataFrame:
    """(mask, n): how many genotypes are shared by exactly the samples in the bit mask; at most 62 samples."""
    g = gt.where(~G.any_missing(F.col("alleles"))).withColumn("_g", F.array_sort("alleles"))
    per = g.groupBy("site_id", "_g").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("sample_id") - 1)).alias("mask"))
    return per.groupBy("mask").agg(F.count("*").alias("n"))


def contrast(gt: DataFrame, cases: list[str], controls: list[str]) -> DataFrame:
    """By site: REF and non-REF alleles of cases and controls, and whether cases have an allele that controls lack."""
    d = gt.select("site_id", F.col("sample").isin(*cases).alias("case"), F.col("sample").isin(*controls).alias("control"), F.explode("alleles").alias("a")).where("a is not null and (case or control)")
    n = lambda who, ref: F.count_if(F.col(who) & ((F.col("a") == 0) if ref else (F.col("a") > 0)))
    out = d.groupBy("site_id").agg(
        n("case", True).alias("case_ref"), n("case", False).alias("case_alt"), n("control", True).alias("control_ref"), n("control", False).alias("control_alt"),
        F.collect_set(F.when(F.col("case"), F.col("a"))).alias("_x"), F.collect_set(F.when(F.col("control"), F.col("a"))).alias("_y"),
    )
    return out.withColumn("novel", F.size(F.array_except("_x", "_y")) > 0).drop("_x", "_y")


def impute_info(gt: DataFrame, gp: Column) -> DataFrame:
    """By site: the information measure of genotype probabilities (three for each sample); 1 where the allele frequency is 0 or 1."""
    e = F.get(gp, F.lit(1)) + 2 * F.get(gp, F.lit(2))
    f = F.get(gp, F.lit(1)) + 4 * F.get(gp, F.lit(2))
    s = gt.groupBy("site_id").agg(F.sum(e).alias("e"), F.sum(f - e * e).alias("v"), F.count("*").alias("n"))
    t = F.col("e") / (2 * F.col("n"))
    return s.select("site_id", F.when((t > 0) & (t < 1), 1 - F.col("v") / (2 * F.col("n") * t * (1 - t))).otherwise(1.0).alias("info"))


def sparse(gt: DataFrame, sites: DataFrame, least: int) -> DataFrame:
    """(sample, chrom, n) of those with fewer than ``least`` called genotypes, none counted too."""
    called = gt.where(~G.all_missing(F.col("alleles"))).join(sites.select("site_id", "chrom"), "site_id").groupBy("sample", "chrom").agg(F.count("*").alias("n"))
    grid = gt.select("sample").distinct().crossJoin(sites.select("chrom").distinct())  # samples by contigs: the result's own size
    return grid.join(called, ["sample", "chrom"], "left").select("sample", "chrom", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def nearest_rank(values: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """``n`` and for each quantile the value at the rounded rank (n - 1) x q, by distinct values counted first."""
    d = values.groupBy(by, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(by).orderBy(value)
    d = d.withColumn("_upto", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(by)))
    at = lambda q: F.min(F.when(F.col("_upto") > F.round((F.col("_n") - 1) * q), F.col(value)))
    return d.groupBy(by).agg(F.max("_n").alias("n"), *(at(q).alias(k) for k, q in quantiles.items()))


def hardy_weinberg(tests: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Quartiles of the exact test's P (site_id, hwe) by bins of a hundredth of the minor allele's frequency (site_id, af)."""
    minor = F.least("af", 1 - F.col("af"))
    d = tests.join(frequencies.where("af is not null"), "site_id").withColumn("bin", F.least(F.floor(100 * minor), F.lit(49)).cast("int"))
    return nearest_rank(d, "bin", "hwe", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def sample_indels(gt: DataFrame, frames: DataFrame, sites: DataFrame) -> DataFrame:
    """By sample: carried first-ALT indels in and out of frame and outside exons; insertions and deletions, heterozygous and homozygous."""
    s = exploded_alts(sites).where("class = 'indel' and nth = 0").select("site_id", (F.length("alt") > F.length("ref")).alias("ins"))
    d = gt.join(s, "site_id").join(frames.where("nth = 0").select("site_id", "frame"), "site_id").where(F.exists("alleles", lambda a: a == 1))
    het = (F.size("alleles") == 2) & ~F.forall("alleles", lambda a: a.eqNullSafe(F.lit(1)))
    ins = F.col("ins")
    return d.groupBy("sample").agg(
        F.count_if(F.col("frame") == "in").alias("in_frame"), F.count_if(F.col("frame") == "out").alias("out_frame"), F.count_if(F.col("frame") == "na").alias("not_applicable"),
        F.count_if(ins & het).alias("ins_het"), F.count_if(ins & ~het).alias("ins_hom"), F.count_if(~ins & het).alias("del_het"), F.count_if(~ins & ~het).alias("del_hom"),
    )


def frequency_deviation(observed: DataFrame, af: DataFrame, bins: int) -> DataFrame:
    """Histogram of the difference between each site's ``af`` and the observed one, in single precision."""
    d = observed.where("an > 0").select("site_id", (F.col("ac") / F.col("an")).cast("float").alias("o")).join(af, "site_id")
    gap = F.abs(F.col("o") - F.col("af").cast("float")).cast("double")
    return d.groupBy(F.least(F.floor(gap * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def length_histogram(sites: DataFrame) -> DataFrame:
    """Indel lengths (deletions negative) of all ALTs."""
    d = exploded_alts(sites).where("class = 'indel'")
    return d.groupBy((F.length("alt") - F.length("ref")).alias("length")).agg(F.count("*").alias("n"))


def repeat_unit(context: str, at: int, unit: int) -> int:
    """How many times the ``unit`` bases after index ``at`` repeat there without a break."""
    word, n = context[at : at + unit], 0
    while word and context[at + n * unit : at + (n + 1) * unit] == word:
        n += 1
    return n


def indel_context(ref: str, alt: str, context: str, at: int) -> tuple[int, int, bool]:
    """(unit, times, consistent) of the longest tandem repeat of 1 to 10 bases right of an indel whose first base is at index ``at``; consistent if the indel is whole units of it."""
    best = (0, 0)
    for unit in range(1, 11):
        n = repeat_unit(context, at + 1, unit)
        if n > 1 and n * unit > best[0] * best[1]:
            best = (unit, n)
    changed = alt[1:] if len(alt) > len(ref) else ref[1:]
    unit = context[at + 1 : at + 1 + best[0]]
    whole = best[0] > 0 and len(changed) % best[0] == 0 and changed == unit * (len(changed) // best[0])
    return best[0], best[1], whole


def indel_contexts(sites: DataFrame) -> DataFrame:
    """(times, ins, ok, n): indels by repeats of their context; ``sites`` carry ``base``, the reference from their position on."""
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [indel_context(r, a, c or "", 0) for r, a, c in zip(p["ref"], p["alt"], p["base"], strict=True)]
            yield pd.DataFrame({"times": [min(10, m[1]) for m in made], "ok": [m[2] for m in made], "ins": [len(a) > len(r) for r, a in zip(p["ref"], p["alt"], strict=True)]})

    d = exploded_alts(sites).where("class = 'indel'").select("ref", "alt", "base")
    return d.mapInPandas(run, "times int, ok boolean, ins boolean").where("times >= 2").groupBy("times", "ins", "ok").agg(F.count("*").alias("n"))
