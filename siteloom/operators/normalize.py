"""Normalisation against a reference: left alignment, atoms of complex alleles, duplicates, bases filled in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.consensus import CHUNK, bases_at
from siteloom.operators.models import allele_atoms

#: Bases that are fetched to the left of an indel; alignment stops there.
FLANK = 200


def left_align(pos: int, ref: str, alt: str, before: str) -> tuple[int, str, str]:
    """An indel moved as far left as its bases repeat, with one shared first base. ``before`` ends just before ``pos``."""
    if alt.startswith("<") or "*" in alt or len(ref) == len(alt):
        return pos, ref, alt
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
        if (not ref or not alt) and before:
            ref, alt, before, pos = before[-1] + ref, before[-1] + alt, before[:-1], pos - 1
        elif not ref or not alt:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


def left_align_sites(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """Biallelic sites left-aligned; their left flank is fetched by an equi-join on reference chunks."""
    start = F.greatest(F.col("pos") - FLANK, F.lit(1))
    parts = sites.withColumn("_from", start).withColumn("chunk_start", F.explode(F.array_distinct(F.array(*((F.floor((p - 1) / CHUNK) * CHUNK + 1).cast("long") for p in (start, F.greatest(F.col("pos") - 1, F.lit(1))))))))
    got = parts.join(reference, ["chrom", "chunk_start"], "left").withColumn("_b", F.expr("substring(bases, cast(greatest(_from - chunk_start, 0) + 1 as int), cast(greatest(pos - greatest(_from, chunk_start), 0) as int))"))
    flank = got.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", "_b"))), lambda x: F.coalesce(x["_b"], F.lit(""))), "").alias("_flank"))
    d = sites.join(flank, "site_id")
    other = [f for f in sites.schema.fields if f.name not in ("pos", "ref", "alts")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            moved = [left_align(a, b, c[0], f.upper()) if len(c) == 1 else (a, b, None) for a, b, c, f in zip(p["pos"], p["ref"], p["alts"], p["_flank"], strict=True)]
            yield p[["site_id"]].assign(pos=[m[0] for m in moved], ref=[m[1] for m in moved], alt=[m[2] for m in moved])

    new = d.select("site_id", "pos", "ref", "alts", "_flank").mapInPandas(run, "site_id long, pos long, ref string, alt string")
    joined = sites.select("site_id", "alts", *(f.name for f in other if f.name != "site_id")).join(new, "site_id")
    return joined.withColumn("alts", F.when(F.col("alt").isNotNull(), F.array("alt")).otherwise(F.col("alts"))).select(*sites.columns)


def atomize(sites: DataFrame) -> DataFrame:
    """(site_id, chrom, pos, ref, alt, allele): complex alleles as substitutions and one indel each; simple ones as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [
                (s, c, q + o, r, a, i + 1)
                for s, c, q, ref, alts in zip(p["site_id"], p["chrom"], p["pos"], p["ref"], p["alts"], strict=True)
                for i, alt in enumerate(alts)
                for o, r, a in ([(0, ref, alt)] if alt.startswith("<") or alt == "*" else allele_atoms(ref, alt))
            ]
            yield pd.DataFrame(rows, columns=["site_id", "chrom", "pos", "ref", "alt", "allele"])

    return sites.select("site_id", "chrom", "pos", "ref", "alts").mapInPandas(run, "site_id long, chrom string, pos long, ref string, alt string, allele int")


def rmdup_any_key(sites: DataFrame) -> DataFrame:
    """Duplicates by any of a record's keys: its SNP part and its indel part each count, other alleles as they are; the first of a position stays.

    The rule depends on what was kept before at the position, so positions are groups of their own.
    """
    n = F.count("*").over(Window.partitionBy("chrom", "pos"))
    d = sites.withColumn("_n", n)

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        seen: set[tuple] = set()
        kept = []
        for s, ref, alts in p.sort_values("site_id")[["site_id", "ref", "alts"]].itertuples(index=False):
            keys = {("snp",) if len(a) == len(ref) == 1 else (ref, a) if a.startswith("<") or len(a) == len(ref) else ("indel",) for a in alts} or {(ref,)}
            if not keys & seen:
                kept.append(s)
            seen |= keys
        return pd.DataFrame({"site_id": kept})

    many = d.where("_n > 1").groupBy("chrom", "pos").applyInPandas(walk, "site_id long")
    return sites.join(d.where("_n = 1").select("site_id").union(many), "site_id", "left_semi")


def fill_from_reference(sites: DataFrame, reference: DataFrame, column: str = "ref", replace_odd: bool = False) -> DataFrame:
    """REF, or another column, from the reference's bases; with ``replace_odd`` bases other than ACGTN are N."""
    got = bases_at(sites, reference, 1)
    base = F.when(F.length("ref") == 1, F.col("base")).otherwise(F.col("ref")) if column == "ref" else F.col("base")
    base = F.regexp_replace(base, "[^ACGTN]", "N") if replace_odd else base
    return got.withColumn(column, base).drop("base")


def localized_to_full(values: Column, laa: Column, n_alleles: Column, number: str = "R") -> Column:
    """A vector over a sample's local alleles (REF and ``laa``) spread over all alleles (R) or genotypes (G); others missing."""
    local = F.concat(F.array(F.lit(0)), laa)
    at = lambda i: F.array_position(local, i).cast("int") - 1
    if number == "R":
        return F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda i: F.when(at(i) >= 0, F.get(values, at(i))))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda b: F.transform(F.sequence(F.lit(0), b), lambda a: F.struct(a.alias("a"), b.alias("b")))))

    def slot(p: Column) -> Column:
        x, y = at(p["a"]), at(p["b"])
        hi, lo = F.greatest(x, y), F.least(x, y)
        return F.when((x >= 0) & (y >= 0), F.get(values, (hi * (hi + 1) / 2).cast("int") + lo))

    return F.transform(pairs, slot)
