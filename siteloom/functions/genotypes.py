"""Predicates and rewrites of called alleles (an array of indices, null = missing) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.lets import number


def called(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def any_missing(a: Column) -> Column:
    return F.exists(a, lambda x: x.isNull())


def all_missing(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNotNull())


def _diploid(a: Column) -> Column:
    return F.size(a) == 2


def _at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def is_class(a: Column, name: str) -> Column:
    """The genotype classes of the expression language; never null."""
    x, y, two, one = _at(a, 0), _at(a, 1), _diploid(a), F.size(a) == 1
    no = F.lit(False)
    out = {
        "alt": F.exists(a, lambda v: v.isNotNull() & (v > 0)),
        "ref": F.forall(a, lambda v: v.isNotNull() & (v == 0)),
        "mis": any_missing(a),
        "R": one & (x == 0), "A": one & (x > 0),
        "RR": two & (x == 0) & (y == 0),
        "RA": two & (((x == 0) & (y > 0)) | ((x > 0) & (y == 0))),
        "AA": two & (x > 0) & (x == y),
        "aA": two & (x > 0) & (y > 0) & (x != y),
        "het": two & x.isNotNull() & ~x.eqNullSafe(y),
        "hom": two & x.isNotNull() & x.eqNullSafe(y),
        "HAP": one & x.isNotNull(),
    }
    name = {"AR": "RA", "Aa": "aA", "HET": "het", "HOM": "hom", "hap": "HAP"}.get(name, name)
    return F.coalesce(out[name], no)


def view_class(a: Column) -> Column:
    """The genotype filter's classes: missing alleles are left out, so a half-missing call is hom."""
    c = called(a)
    return F.when(F.size(c) == 0, "miss").when(F.size(F.array_distinct(c)) > 1, "het").otherwise("hom")


def parse(text: Column) -> Column:
    """``0/1``, ``0|1``, ``.`` to an array of indices; ``.`` is null."""
    return F.transform(F.split(F.replace(text, F.lit("|"), F.lit("/")), "/"), lambda x: number(x, "int"))


def is_phased(text: Column) -> Column:
    return text.contains("|") | ~text.contains("/")


def _joined(parts: Column, phased: Column) -> Column:
    return F.when(phased, F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))


def render(a: Column, phased: Column) -> Column:
    return _joined(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("."))), phased)


def translate(a: Column, phased: Column, ref: Column, alts: Column) -> Column:
    """The genotype in bases."""
    bases = F.concat(F.array(ref), alts)
    return _joined(F.transform(a, lambda x: F.coalesce(F.get(bases, x), F.lit("."))), phased)


def count(a: Column, allele: Column | int) -> Column:
    return F.size(F.filter(a, lambda x: x.isNotNull() & (x == allele)))


def hap_pair(a: Column, phased: Column) -> Column:
    """Two haplotype fields: ``*`` marks unphased alleles, ``-`` the absent second of a haploid call, ``?`` a missing one."""
    mark = F.when(phased | (F.size(a) < 2), "").otherwise("*")
    one = lambda i: F.when(_at(a, i).isNull(), "?").otherwise(F.concat(_at(a, i).cast("string"), mark))
    return F.concat_ws(" ", one(0), F.when(F.size(a) < 2, "-").otherwise(one(1)))
