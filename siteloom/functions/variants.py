"""Classifiers and arithmetic of REF and ALT as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.lets import let

# Bits of the variant classes.
REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP, INS, DEL = 0, 1, 2, 4, 8, 16, 32, 64, 128
LABELS = ((SNP, "snp"), (MNP, "mnp"), (INDEL, "indel"), (OTHER, "other"), (BND, "bnd"), (OVERLAP, "overlap"))


def allele_class(ref: Column, alt: Column) -> Column:
    """Bits of one ALT: symbolic and breakend alleles by their form, the rest by length after shared ends."""
    same = F.length(ref) == F.length(alt)
    differ = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(ref), F.lit(1))), lambda i: F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1))))
    return (
        F.when(alt.isin(".", "<*>", "<NON_REF>") | (alt == ref), REF)
        .when(alt == "*", OVERLAP)
        .when(alt.rlike(r"[\[\]]"), BND)
        .when(alt.startswith("<"), OTHER)
        .when(same & (F.length(ref) == 1), SNP)
        .when(same, F.when(differ == 1, SNP).otherwise(MNP))
        .otherwise(F.when(F.length(alt) > F.length(ref), INDEL | INS).otherwise(INDEL | DEL))
    )


def variant_class(ref: Column, alts: Column) -> Column:
    """Bits of a site: those of all its ALTs."""
    return let(ref, lambda r: F.aggregate(alts, F.lit(REF), lambda out, a: out.bitwiseOR(allele_class(r, a))))


def class_label(bits: Column) -> Column:
    """Comma-separated names; ``ref`` if none."""
    named = lambda x: F.array_join(F.array_compact(F.array(*(F.when(x.bitwiseAND(b) != 0, n) for b, n in LABELS))), ",")
    return let(bits, lambda x: F.when(x == REF, "ref").otherwise(named(x)))


def stats_class(ref: Column, alt: Column) -> Column:
    """The statistics' own classes: equal lengths above one are MNPs, symbolic alleles others."""
    odd = alt.startswith("<") | alt.rlike(r"[\[\]]") | (alt == "*")
    return F.when(odd, "other").when(F.length(ref) != F.length(alt), "indel").when(F.length(ref) == 1, F.when(ref == alt, "ref").otherwise("snp")).otherwise("mnp")


def key_class(ref: Column, alts: Column) -> Column:
    """For collapse keys: ``snp`` or ``indel`` if all ALTs are, else ``other``."""
    snp = F.forall(alts, lambda a: (F.length(a) == 1) & (F.length(ref) == 1) & a.rlike("^[ACGTN]$"))
    indel = F.forall(alts, lambda a: (F.length(a) != F.length(ref)) & a.rlike("^[ACGTN]+$"))
    return F.when(F.size(alts) == 0, "other").when(snp, "snp").when(indel, "indel").otherwise("other")


def transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def transversion(ref: Column, alt: Column) -> Column:
    return ref.isin("A", "C", "G", "T") & alt.isin("A", "C", "G", "T") & (ref != alt) & ~transition(ref, alt)


def ilen(ref: Column, alts: Column) -> Column:
    """The longest length difference of its ALTs; null without ALT or for symbolic ones."""
    return F.array_max(F.transform(F.filter(alts, lambda a: ~a.startswith("<")), lambda a: F.abs(F.length(a) - F.length(ref))))


def end(pos: Column, ref: Column, info_end: Column) -> Column:
    return F.coalesce(info_end, pos + F.length(ref) - 1)


def genotype_index(a: Column, b: Column) -> Column:
    """Slot of the unordered diploid genotype in a vector of genotypes."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (hi * (hi + 1) / 2).cast("int") + lo


def genotype_count(n_alleles: Column) -> Column:
    return (n_alleles * (n_alleles + 1) / 2).cast("int")


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGT", "TGCA")
