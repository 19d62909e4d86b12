"""Position-ordered operators by contig segments.

A contig is cut into segments of fixed length, so that work is spread however few the contigs are. Running sums and maxima take
what came before a segment from an aggregate by segment; sliding windows take rows of the neighbouring segments
that lie within their reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases in a segment.
SEGMENT = 1 << 20


def _segment(pos: Column) -> Column:
    return F.floor(pos / SEGMENT)


def running(df: DataFrame, name: str, value: Column, how: str = "sum", by: tuple[str, ...] = ("chrom",), order: tuple[str, ...] = ("pos", "site_id"), inclusive: bool = True) -> DataFrame:
    """Adds ``name``: the running sum, max or last non-null value of ``value`` in order of position within ``by``."""
    f = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    at = df.withColumn("_sl_seg", _segment(F.col(order[0]))).withColumn("_sl_v", value)
    inside = Window.partitionBy(*by, "_sl_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if how == "last":
        total = at.groupBy(*by, "_sl_seg").agg(F.max(F.when(F.col("_sl_v").isNotNull(), F.struct(*order, "_sl_v")))["_sl_v"].alias("_sl_t"))
    else:
        total = at.groupBy(*by, "_sl_seg").agg(f("_sl_v").alias("_sl_t"))
    earlier = Window.partitionBy(*by).orderBy("_sl_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*by, "_sl_seg", f("_sl_t").over(earlier).alias("_sl_c"))
    out = at.withColumn("_sl_r", f("_sl_v").over(inside)).join(carry, [*by, "_sl_seg"])
    both = {"sum": F.coalesce("_sl_r", F.lit(0)) + F.coalesce("_sl_c", F.lit(0)), "max": F.greatest("_sl_r", "_sl_c"), "last": F.coalesce("_sl_r", "_sl_c")}[how]
    return out.withColumn(name, both).drop("_sl_seg", "_sl_v", "_sl_r", "_sl_c")


def following(df: DataFrame, name: str, by: tuple[str, ...] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Adds ``name``: the next row's position within ``by``; null after the last. Segments exchange their first positions."""
    at = df.withColumn("_sl_seg", _segment(F.col(pos)))
    later = at.groupBy(*by, "_sl_seg").agg(F.min(pos).alias("_sl_lo"))
    later = later.select(*by, "_sl_seg", F.lead("_sl_lo").over(Window.partitionBy(*by).orderBy("_sl_seg")).alias("_sl_after"))
    inside = F.lead(pos).over(Window.partitionBy(*by, "_sl_seg").orderBy(pos))
    return at.withColumn("_sl_in", inside).join(later, [*by, "_sl_seg"]).withColumn(name, F.coalesce("_sl_in", "_sl_after")).drop("_sl_seg", "_sl_in", "_sl_after")


def islands(df: DataFrame, name: str, end: Column, gap: int = 0, by: tuple[str, ...] = ("chrom",), order: tuple[str, ...] = ("pos", "site_id")) -> DataFrame:
    """Numbers chains of spans: a row begins a new one if it starts more than ``gap`` past the furthest end so far."""
    d = running(df, "_sl_reach", end, "max", by, order, inclusive=False)
    d = d.withColumn("_sl_new", F.when(F.col(order[0]) - F.col("_sl_reach") <= gap, 0).otherwise(1))
    return running(d, name, F.col("_sl_new"), "sum", by, order).drop("_sl_reach", "_sl_new")


def with_neighbours(df: DataFrame, reach: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with ``_sl_part``, the segment they are handed to: their own (``_sl_own``), and neighbours within ``reach`` of their span."""
    start, end = F.col("pos") if start is None else start, F.col("pos") if end is None else end
    d = df.withColumn("_sl_home", _segment(F.col("pos")))
    d = d.withColumn("_sl_part", F.explode(F.sequence(_segment(F.greatest(start - reach, F.lit(0))), _segment(end + reach))))
    return d.withColumn("_sl_own", F.col("_sl_part") == F.col("_sl_home"))


def cluster_size(sites: DataFrame, width: int, counted: Column | None = None) -> DataFrame:
    """Adds ``n_cluster``: the most counted sites in any window of ``width`` bases with the site in it."""
    d = with_neighbours(sites, 2 * width).withColumn("_sl_x", F.lit(1) if counted is None else counted.cast("int"))
    w = Window.partitionBy("chrom", "_sl_part").orderBy("pos")
    d = d.withColumn("_sl_n", F.sum("_sl_x").over(w.rangeBetween(0, width - 1)))
    d = d.withColumn("n_cluster", F.max("_sl_n").over(w.rangeBetween(-(width - 1), 0)))
    return d.where("_sl_own").drop("_sl_home", "_sl_part", "_sl_own", "_sl_x", "_sl_n")


def variant_distance(sites: DataFrame) -> DataFrame:
    """Adds ``dist_back`` and ``dist_fwd``, distances to the nearest other position of the contig on each side (null at its ends), and ``dist_near``.

    Positions are reduced to distinct ones; each segment's first and last are exchanged between segments.
    """
    p = sites.select("chrom", "pos").distinct().withColumn("_sl_seg", _segment(F.col("pos")))
    edge = p.groupBy("chrom", "_sl_seg").agg(F.min("pos").alias("_sl_lo"), F.max("pos").alias("_sl_hi"))
    w = Window.partitionBy("chrom").orderBy("_sl_seg")
    edge = edge.select("chrom", "_sl_seg", F.lag("_sl_hi").over(w).alias("_sl_before"), F.lead("_sl_lo").over(w).alias("_sl_after"))
    inside = Window.partitionBy("chrom", "_sl_seg").orderBy("pos")
    p = p.join(edge, ["chrom", "_sl_seg"])
    p = p.select(
        "chrom", "pos",
        (F.col("pos") - F.coalesce(F.lag("pos").over(inside), F.col("_sl_before"))).alias("dist_back"),
        (F.coalesce(F.lead("pos").over(inside), F.col("_sl_after")) - F.col("pos")).alias("dist_fwd"),
    )
    return sites.join(p.withColumn("dist_near", F.least("dist_back", "dist_fwd")), ["chrom", "pos"])


def overlapping(sites: DataFrame, end: Column) -> DataFrame:
    """Adds ``overlaps``: whether the site's span meets that of another of the contig."""
    d = islands(sites.withColumn("_sl_end", end), "_sl_island", F.col("_sl_end"))
    n = d.groupBy("chrom", "_sl_island").agg(F.count("*").alias("_sl_n"))
    return d.join(n, ["chrom", "_sl_island"]).withColumn("overlaps", F.col("_sl_n") > 1).drop("_sl_island", "_sl_n", "_sl_end")


def duplicated(sites: DataFrame) -> DataFrame:
    """Adds ``dup``: whether another site has the same position."""
    return sites.withColumn("dup", F.count("*").over(Window.partitionBy("chrom", "pos")) > 1)


def scatter(sites: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: sites in order (contig, position), ``size`` to each."""
    d = sites.withColumn("_sl_seg", _segment(F.col("pos")))
    n = d.groupBy("contig_rank", "_sl_seg").agg(F.count("*").alias("_sl_n"))
    before = F.coalesce(F.sum("_sl_n").over(Window.orderBy("contig_rank", "_sl_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(n.select("contig_rank", "_sl_seg", before.alias("_sl_b")), ["contig_rank", "_sl_seg"])
    nth = F.row_number().over(Window.partitionBy("contig_rank", "_sl_seg").orderBy("pos", "site_id")) - 1 + F.col("_sl_b")
    return d.withColumn("chunk", F.floor(nth / size)).drop("_sl_seg", "_sl_b")


def ploidy_runs(gt: DataFrame, with_missing: bool = False) -> DataFrame:
    """(sample, chrom, start, end, ploidy, n): runs of sites of equal ploidy by sample; missing genotypes are left out unless asked for."""
    d = gt if with_missing else gt.where(F.exists("alleles", lambda a: a.isNotNull()))
    d = d.select("sample", "chrom", "pos", "site_id", F.size("alleles").alias("ploidy"))
    d = running(d, "_sl_was", F.col("ploidy"), "last", ("sample", "chrom"), inclusive=False)
    d = running(d.withColumn("_sl_new", F.when(F.col("_sl_was") == F.col("ploidy"), 0).otherwise(1)), "run", F.col("_sl_new"), "sum", ("sample", "chrom"))
    return d.groupBy("sample", "chrom", "run", "ploidy").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n")).drop("run")


def gvcf_blocks(rows: DataFrame, group: Column) -> DataFrame:
    """Reference rows (chrom, pos, end, dp, gq, ref) of consecutive equal ``group`` as blocks: start, end, least dp and gq, n."""
    d = rows.withColumn("_sl_g", group)
    d = running(d, "_sl_was", F.col("_sl_g"), "last", inclusive=False)
    d = running(d.withColumn("_sl_new", F.when(F.col("_sl_was").eqNullSafe(F.col("_sl_g")), 0).otherwise(1)), "block", F.col("_sl_new"))
    return d.groupBy("chrom", "block", F.col("_sl_g").alias("grp")).agg(
        F.min("pos").alias("start"), F.max("end").alias("end"), F.min("dp").alias("min_dp"), F.min("gq").alias("min_gq"), F.count("*").alias("n")
    )
