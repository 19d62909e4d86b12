"""Interval joins: a range condition as an equi-join on bins, or as a running maximum, so that neither side is compared with all of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators.windows import running

#: log2 of the bases in a bin, by level. An interval lies in bins of the first level on which it has few; the last level holds contigs whole.
LEVELS = (6, 10, 14, 18, 22, 26, 62)
#: Bins that an interval has at most on its level, but for one more at its edge.
FEW = 16


def _level(start: Column, end: Column) -> Column:
    out = F.lit(len(LEVELS) - 1)
    for i, bits in reversed(list(enumerate(LEVELS[:-1]))):
        out = F.when(end - start < FEW << bits, i).otherwise(out)
    return out


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, F.element_at(F.array(*map(F.lit, LEVELS)), level + 1))


def _spans(d: DataFrame, start: Column, end: Column) -> DataFrame:
    return d.withColumn("_s", start.cast("long")).withColumn("_e", end.cast("long"))


def _intervals(right: DataFrame, r_start: str, r_end: str, *keep: str) -> DataFrame:
    return right.select(
        F.col("chrom").alias("_rc"),
        F.coalesce(F.col(r_start), F.lit(1)).cast("long").alias("_rs"),
        F.coalesce(F.col(r_end), F.lit(1 << 32)).cast("long").alias("_re"),
        *keep,
    )


def _in_bins(d: DataFrame, other: DataFrame, start: str, end: str, level: str, at: str, wider: int) -> DataFrame:
    """Rows of ``d`` by bins: on its own level for what is narrower, and on the levels of ``other`` for what is wider; ``wider`` says on which side equal ones are.

    The side is a part of ``at``, so that narrow intervals don't meet narrow ones in wide bins.
    """
    d = d.withColumn(level, _level(F.col(start), F.greatest(start, end)))
    # a row of seven levels at most
    found = other.agg(F.collect_set("_lv").alias("_found"))
    d = d.crossJoin(F.broadcast(found))
    own = F.col(level)
    wide = F.filter("_found", lambda m: m > own if wider else m >= own)
    narrow = F.when(F.exists("_found", lambda m: m <= own if wider else m < own), F.array(own)).otherwise(F.array().cast("array<int>"))
    slot = lambda m, side: F.struct(m.alias("l"), F.lit(side).alias("side"))
    d = d.withColumn("_at", F.explode(F.concat(F.transform(wide, lambda m: slot(m, wider)), F.transform(narrow, lambda m: slot(m, 1 - wider))))).drop("_found")
    bins = F.sequence(_bin(F.col(start), F.col("_at")["l"]), _bin(F.greatest(start, end), F.col("_at")["l"]))
    return d.withColumn("_b", F.explode(bins)).withColumn(at, F.struct(F.col("_at")["l"].alias("l"), F.col("_at")["side"].alias("side"), F.col("_b").alias("b"))).drop("_at", "_b", level)


def touching(left: DataFrame, right: DataFrame, start: Column, end: Column, r_start: str = "start", r_end: str = "end") -> DataFrame:
    """(chrom, _s, _e): different spans of ``left`` that some interval of ``right`` overlaps.

    Some does if the furthest end of those that start at or before the span's end reaches the span's start. So no pairs are made, and
    spans and starts count once however many rows have them.
    """
    ask = _spans(left, start, end).select("chrom", "_s", "_e").distinct()
    have = _intervals(right, r_start, r_end).groupBy("_rc", "_rs").agg(F.max("_re").alias("_re"))
    rows = have.select(F.col("_rc").alias("chrom"), F.col("_rs").alias("_at"), F.lit(0).alias("_turn"), "_re", F.lit(None).cast("long").alias("_s"))
    rows = rows.union(ask.select("chrom", F.col("_e").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_re"), "_s"))
    met = running(rows, "_reach", F.col("_re"), "max", order=("_at", "_turn"))
    return met.where("_turn = 1 and _reach >= _s").select("chrom", "_s", F.col("_at").alias("_e"))


def overlaps(left: DataFrame, right: DataFrame, start: Column, end: Column, r_start: str = "start", r_end: str = "end", how: str = "inner") -> DataFrame:
    """Joins ``left`` (chrom, spans ``start`` to ``end``, both inclusive) to ``right`` (chrom, r_start, r_end; null = unbounded).

    ``how``: ``inner`` (a row for each overlap), ``left_semi``, ``left_anti`` or ``left`` (all rows, with ``_hit``). A pair meets on the level of the wider of the two, and
    if it has several bins there, it is made in the first that both have. So neither wide intervals nor what they meet are spread over many bins.
    """
    span = _spans(left, start, end)
    if how != "inner":
        hit = touching(left, right, start, end, r_start, r_end)
        hit = hit.withColumn("_hit", F.lit(True)) if how == "left" else hit
        return span.join(hit, ["chrom", "_s", "_e"], how).select(*left.columns, *(["_hit"] if how == "left" else []))
    r = _intervals(right, r_start, r_end, *(c for c in right.columns if c not in ("chrom", r_start, r_end)))
    levels = lambda d, a, b: d.select(_level(F.col(a), F.greatest(a, b)).alias("_lv"))
    ask = _in_bins(span, levels(r, "_rs", "_re"), "_s", "_e", "_l", "_la", 0)
    have = _in_bins(r, levels(span, "_s", "_e"), "_rs", "_re", "_rl", "_ra", 1)
    met = (F.col("chrom") == F.col("_rc")) & (F.col("_la") == F.col("_ra"))
    near = ask.join(have, met & (F.col("_s") <= F.col("_re")) & (F.col("_rs") <= F.col("_e")))
    level = F.col("_la")["l"]
    near = near.where(F.col("_la")["b"] == F.greatest(_bin(F.col("_s"), level), _bin(F.col("_rs"), level))).drop("_la", "_ra")
    return near.drop("_s", "_e", "_rc").withColumnRenamed("_rs", r_start).withColumnRenamed("_re", r_end)
