"""Record filters: regions, types, counts, FILTER, phase, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import variants as V
from siteloom.operators.intervals import overlaps
from siteloom.operators.windows import islands, running


def site_span(mode: str) -> tuple[Column, Column]:
    """Start and end by overlap mode: ``pos``; ``record`` (END or REF length); ``variant`` (without the shared first base of indels)."""
    pos, ref = F.col("pos"), F.col("ref")
    if mode == "pos":
        return pos, pos
    stop = V.end(pos, ref, F.col("end"))
    if mode == "record":
        return pos, stop
    shared = F.exists("alts", lambda a: F.length(a) != F.length(ref)) & F.forall("alts", lambda a: ~a.startswith("<") & (F.substring(a, 1, 1) == F.substring(ref, 1, 1)))
    return F.when(shared, pos + 1).otherwise(pos), F.when(shared & (F.length(ref) == 1), pos + 1).otherwise(stop)


def in_regions(sites: DataFrame, regions: DataFrame, mode: str = "record", exclude: bool = False) -> DataFrame:
    start, end = site_span(mode)
    return overlaps(sites, regions, start, end, how="left_anti" if exclude else "left_semi")


def mask_regions(sites: DataFrame, regions: DataFrame, name: str, mode: str = "record", complement: bool = False) -> DataFrame:
    """Adds ``name`` to FILTER of sites that overlap (or don't overlap) a region; PASS goes."""
    start, end = site_span(mode)
    out = overlaps(sites, regions, start, end, how="left")
    fail = F.col("_hit").isNull() if complement else F.col("_hit").isNotNull()
    return soft_filter(out, ~fail, name, "+").drop("_hit")


def soft_filter(sites: DataFrame, passes: Column, name: str, mode: str = "") -> DataFrame:
    """Failing sites get FILTER ``name``: instead of the old value, or with ``+`` beside it; with ``x`` passing ones become PASS."""
    keep = F.array_except("filters", F.array(F.lit("PASS"), F.lit(".")))
    fail = F.array_union(keep, F.array(F.lit(name))) if "+" in mode else F.array(F.lit(name))
    ok = F.array(F.lit("PASS")) if "x" in mode else F.col("filters")
    return sites.withColumn("filters", F.when(F.coalesce(passes, F.lit(False)), ok).otherwise(fail))


def has_filter(sites: DataFrame, *names: str) -> DataFrame:
    return sites.where(F.arrays_overlap("filters", F.array(*map(F.lit, names))))


def of_types(sites: DataFrame, *labels: str, exclude: bool = False) -> DataFrame:
    bits = {n: b for b, n in V.LABELS}
    wanted = sum(bits[x] for x in labels if x != "ref")
    hit = V.variant_class(F.col("ref"), F.col("alts")).bitwiseAND(wanted) != 0
    if "ref" in labels:
        hit = hit | (V.variant_class(F.col("ref"), F.col("alts")) == V.REF)
    return sites.where(~hit if exclude else hit)


def allele_counts(gt: DataFrame, *keep: str) -> DataFrame:
    """(site_id, an, ac: count by allele index from 0)."""
    a = gt.select("site_id", *keep, F.explode("alleles").alias("a"))
    per = a.groupBy("site_id", *keep, "a").agg(F.count("*").alias("n"))
    return per.groupBy("site_id", *keep).agg(
        F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("an"),
        F.map_from_entries(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "n")))).alias("ac"),
    )


def count_metric(counts: DataFrame, n_alleles: Column, which: str) -> DataFrame:
    """``value`` by metric: nref (all but REF), alt1, minor (least of all alleles), major (most), nonmajor (all but the most)."""
    ac = F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda i: F.coalesce(F.try_element_at("ac", i.cast("int")), F.lit(0)))
    total, top = F.col("an"), F.array_max(ac)
    value = {"nref": total - F.get(ac, F.lit(0)), "alt1": F.coalesce(F.get(ac, F.lit(1)), F.lit(0)), "minor": F.array_min(ac), "major": top, "nonmajor": total - top}[which]
    return counts.withColumn("value", value)


def by_count(sites: DataFrame, gt: DataFrame, which: str, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """Sites whose allele count ``which`` lies within bounds."""
    c = count_metric(sites.join(allele_counts(gt), "site_id"), 1 + F.size("alts"), which)
    ok = F.lit(True)
    ok = ok if lowest is None else ok & (F.col("value") >= lowest)
    ok = ok if highest is None else ok & (F.col("value") <= highest)
    return c.where(ok).drop("ac", "value")


def by_frequency(sites: DataFrame, gt: DataFrame, which: str, lowest: float | None = None, highest: float | None = None) -> DataFrame:
    """Sites whose allele frequency ``which`` lies within bounds; none without called alleles."""
    c = count_metric(sites.join(allele_counts(gt), "site_id"), 1 + F.size("alts"), which).where("an > 0")
    f = F.col("value") / F.col("an")
    ok = F.lit(True)
    ok = ok if lowest is None else ok & (f >= lowest)
    ok = ok if highest is None else ok & (f <= highest)
    return c.where(ok).drop("ac", "value")


def n_alleles_between(sites: DataFrame, lowest: int, highest: int) -> DataFrame:
    return sites.where((1 + F.size("alts")).between(lowest, highest))


def known(sites: DataFrame, yes: bool = True) -> DataFrame:
    return sites.where(F.col("id").isNotNull() if yes else F.col("id").isNull())


def phased_sites(sites: DataFrame, gt: DataFrame, yes: bool = True) -> DataFrame:
    per = gt.groupBy("site_id").agg(F.bool_and(F.col("phased") | (F.size("alleles") == 1)).alias("_ok"))
    return sites.join(per.where("_ok" if yes else "not _ok"), "site_id", "left_semi")


def uncalled_sites(sites: DataFrame, gt: DataFrame, yes: bool = True) -> DataFrame:
    per = gt.groupBy("site_id").agg(F.bool_and(G.all_missing(F.col("alleles"))).alias("_none"))
    return sites.join(per.where("_none" if yes else "not _none"), "site_id", "left_semi")


def with_genotype(sites: DataFrame, gt: DataFrame, name: str, exclude: bool = False) -> DataFrame:
    """Sites with some (or no) sample of class hom, het or miss; missing alleles of half-missing calls are left out."""
    per = gt.groupBy("site_id").agg(F.bool_or(G.view_class(F.col("alleles")) == name).alias("_some"))
    return sites.join(per.where("not _some" if exclude else "_some"), "site_id", "left_semi")


def id_in(sites: DataFrame, ids: DataFrame, exclude: bool = False) -> DataFrame:
    """Membership of ID in a list."""
    return sites.join(ids.select("id").distinct(), "id", "left_anti" if exclude else "left_semi")


def _gap_class(ref: Column, alts: Column) -> Column:
    """snp, indel or other for gap filters: other if the ALTs' kinds differ."""
    kind = lambda a: F.when(a.isin("<DEL>", "<INS>", "<DUP>", "<CNV>"), "indel").when(a.startswith("<"), "other").when(F.length(a) != F.length(ref), "indel").when(F.length(a) == 1, "snp").otherwise("mnp")
    kinds = F.array_distinct(F.transform(alts, kind))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("other")


def snp_gap(sites: DataFrame, gap: int, types: tuple[str, ...] = ("indel",), name: str = "SnpGap") -> DataFrame:
    """Adds ``name`` to SNPs within ``gap`` bases of a site of ``types``, by the nearest ends on both sides."""
    s = sites.withColumn("_k", _gap_class(F.col("ref"), F.col("alts"))).withColumn("_end", F.col("pos") + F.length("ref") - 1)
    here = F.col("_k").isin(*types)
    s = running(s, "_before", F.when(here, F.col("_end")), "max")
    # the nearest one from here on: the same from the other end
    s = s.withColumn("_back", -F.col("pos")).withColumn("_last", -F.col("site_id"))
    s = running(s, "_after", F.when(here, F.col("_back")), "max", order=("_back", "_last"))
    near = (F.col("pos") - F.col("_before") <= gap) | (-F.col("_after") - F.col("_end") <= gap)
    return soft_filter(s, ~((F.col("_k") == "snp") & F.coalesce(near, F.lit(False))), name, "+").drop("_k", "_end", "_before", "_after", "_back", "_last")


def indel_gap(sites: DataFrame, gap: int, name: str = "IndelGap") -> DataFrame:
    """Of indels chained by gaps of at most ``gap`` bases the best stays: highest QUAL above 0, else the first; others get ``name``."""
    s = sites.withColumn("_indel", _gap_class(F.col("ref"), F.col("alts")) == "indel")
    d = islands(s.where("_indel").withColumn("_end", F.col("pos") + F.length("ref") - 1), "_chain", F.col("_end"), gap)
    best = Window.partitionBy("chrom", "_chain").orderBy(F.greatest(F.coalesce("qual", F.lit(0.0)), F.lit(0.0)).desc(), "pos", "site_id")
    d = soft_filter(d.withColumn("_nth", F.row_number().over(best)), F.col("_nth") == 1, name, "+")
    return d.select(*sites.columns).union(s.where("not _indel").select(*sites.columns))


def gt_subset(sites: DataFrame, gt: DataFrame, samples: list[str]) -> DataFrame:
    """Sites at which the chosen samples share one genotype that no other sample has; missing genotypes are left out."""
    text = F.when(~G.all_missing(F.col("alleles")), F.array_join(F.array_sort(G.called(F.col("alleles"))), "/"))
    own = F.col("sample").isin(*samples)
    per = gt.withColumn("_g", text).groupBy("site_id").agg(
        F.min(F.when(own, F.col("_g"))).alias("lo"), F.max(F.when(own, F.col("_g"))).alias("hi"), F.collect_set(F.when(~own, F.col("_g"))).alias("others")
    )
    return sites.join(per.where("lo = hi and not array_contains(others, lo)"), "site_id", "left_semi")
