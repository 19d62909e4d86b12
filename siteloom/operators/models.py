"""Probability models over genotypes: likelihoods, de-novo posteriors, ploidy, parental origin; and sequential pruning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.operators.windows import islands

#: Read error, mutation rate, and the population's frequency of an ALT allele.
ERROR, MUTATION, ALT_PRIOR = 0.01, 1e-8, 1e-3


def log_likelihoods(ad: Column) -> Column:
    """Natural log likelihoods of 0, 1, 2 ALT copies from REF and ALT reads, without the binomial's constant."""
    r, a = F.get(ad, F.lit(0)), F.get(ad, F.lit(1))
    one = lambda p: r * float(np.log(1 - p)) + a * float(np.log(p))
    return F.array(one(ERROR), one(0.5), one(1 - ERROR))


def with_likelihoods(gt: DataFrame) -> DataFrame:
    """Adds ``pl``: phred-scaled likelihoods, the best 0."""
    ll = log_likelihoods(F.col("ad"))
    return gt.withColumn("pl", F.transform(ll, lambda x: F.round(-4.34294481903 * (x - F.array_max(ll))).cast("int")))


def _transmission(mutation: float) -> tuple[np.ndarray, np.ndarray]:
    """P(child | father, mother) over ALT copies without and with mutations."""
    gamete = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    flip = np.array([[1 - mutation, mutation], [mutation, 1 - mutation]])
    out = []
    for g in (gamete, gamete @ flip):
        t = np.zeros((3, 3, 3))
        for f in range(3):
            for m in range(3):
                for x in range(2):
                    for y in range(2):
                        t[x + y, f, m] += g[f, x] * g[m, y]
        out.append(t)
    return out[0], out[1]


ROLES = ("child", "father", "mother")


def by_role(gt: DataFrame, trios: list[tuple[str, str, str]], value: str) -> DataFrame:
    """(site_id, trio, child, father, mother): ``value`` of the three, where all have a row. A sample may be in many trios."""
    who = gt.sparkSession.createDataFrame([(s, i, r) for i, t in enumerate(trios) for s, r in zip(t, ROLES, strict=True)], "sample string, trio int, role string")
    d = gt.select("site_id", "sample", value).join(F.broadcast(who), "sample")  # as large as the pedigree given
    pick = [F.first(F.when(F.col("role") == r, F.col(value)), ignorenulls=True).alias(r) for r in ROLES]
    return d.groupBy("site_id", "trio").agg(*pick).dropna(subset=list(ROLES))


def de_novo_probability(pl: np.ndarray, mutation: float = MUTATION, alt: float = ALT_PRIOR) -> np.ndarray:
    """P of a new mutation in each row of (child, father, mother) x three phred-scaled likelihoods."""
    mendel, total = _transmission(mutation)
    parent = np.array([(1 - alt) ** 2, 2 * alt * (1 - alt), alt**2])
    prior = total * parent[None, :, None] * parent[None, None, :]
    like = 10 ** (-pl / 10.0)
    joint = np.einsum("nc,nf,nm,cfm->ncfm", like[:, 0], like[:, 1], like[:, 2], prior)
    new = joint[:, mendel == 0].sum(axis=1)
    return new / joint.reshape(len(pl), -1).sum(axis=1)


def de_novo_posterior(gt: DataFrame, trios: list[tuple[str, str, str]], mutation: float = MUTATION, alt: float = ALT_PRIOR) -> DataFrame:
    """(site_id, trio, p): the posterior of a new mutation in each of ``trios`` (child, father, mother), from the likelihoods ``pl`` of ``gt``.

    A sum over the 27 combinations of copies, as one expression; sites where one of the three has no row are left out.
    """
    mendel, total = _transmission(mutation)
    parent = [(1 - alt) ** 2, 2 * alt * (1 - alt), alt**2]
    d = by_role(gt, trios, "pl")
    like = {r: [F.pow(F.lit(10.0), -F.get(r, F.lit(i)) / 10) for i in range(3)] for r in ROLES}
    new, every = [], []
    for c in range(3):
        for f in range(3):
            for m in range(3):
                x = like["child"][c] * like["father"][f] * like["mother"][m] * float(total[c, f, m] * parent[f] * parent[m])
                every.append(x)
                if mendel[c, f, m] == 0:
                    new.append(x)
    return d.select("site_id", "trio", (reduce(Column.__add__, new) / reduce(Column.__add__, every)).alias("p"))


def guess_ploidy(gt: DataFrame) -> DataFrame:
    """(sample, n, haploid, diploid, sex): mean log probability of each sample's genotypes under one and two copies at the sites' allele frequencies."""
    a = F.col("alleles")
    f = gt.select("site_id", F.explode("alleles").alias("x")).where("x is not null").groupBy("site_id").agg((F.count_if(F.col("x") > 0) / F.count("*")).alias("f"))
    d = gt.where(~G.any_missing(a)).join(f.where("f > 0 and f < 1"), "site_id")
    q = F.col("f")
    n = F.size(F.filter(a, lambda x: x > 0))
    het = (F.size(a) == 2) & (n == 1)
    hap = F.when(het, ERROR).when(n > 0, q * (1 - ERROR)).otherwise((1 - q) * (1 - ERROR))
    dip = F.when(het, 2 * q * (1 - q)).when(n > 0, q * q).otherwise((1 - q) * (1 - q))
    out = d.groupBy("sample").agg(F.count("*").alias("n"), F.avg(F.ln(hap)).alias("haploid"), F.avg(F.ln(dip)).alias("diploid"))
    return out.withColumn("sex", F.when(F.col("haploid") > F.col("diploid"), "M").when(F.col("haploid") < F.col("diploid"), "F").otherwise("U"))


def parental_origin(gt: DataFrame, trios: list[tuple[str, str, str]]) -> DataFrame:
    """(trio, n, paternal, maternal) for each of ``trios`` (child, father, mother): log likelihoods of a duplication's origin from its child's ALT reads
    where parents are opposite homozygotes."""
    hom = lambda c, x: F.forall(F.col(c)["alleles"], lambda a: a.eqNullSafe(F.lit(x)))
    d = by_role(gt.withColumn("_sl_call", F.struct("alleles", "ad")), trios, "_sl_call").where((hom("father", 1) & hom("mother", 0)) | (hom("father", 0) & hom("mother", 1)))
    alt_is_father = hom("father", 1)
    r, v = (F.get(F.col("child")["ad"], F.lit(i)) for i in (0, 1))
    ll = lambda p: v * F.ln(p) + r * F.ln(1 - p)
    two, one = F.lit(2 / 3), F.lit(1 / 3)
    return d.groupBy("trio").agg(F.count("*").alias("n"), F.sum(ll(F.when(alt_is_father, two).otherwise(one))).alias("paternal"), F.sum(ll(F.when(alt_is_father, one).otherwise(two))).alias("maternal"))


def prune(sites: DataFrame, window: int, most: int, keep: str = "first") -> DataFrame:
    """At most ``most`` sites in any ``window`` bases: in order of position, a site that would be one too many goes (or with ``maxqual``, the lowest QUAL).

    What stays depends on what went before within reach only, so islands of sites closer than the window are worked through apart. Of a position's sites only the first
    (or best) ``most`` can stay, so no others are walked; Python takes an island batch by batch and holds what is within the window.
    """
    d = sites.select("chrom", "site_id", "pos", F.coalesce("qual", F.lit(0.0)).alias("q"))
    first = ["site_id"] if keep == "first" else [F.desc("q"), F.desc("site_id")]
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(*first))).where(F.col("_nth") <= most).drop("_nth")
    d = islands(d, "_island", F.col("pos"), window).select("chrom", "_island", "site_id", "pos", "q")
    n = d.groupBy("chrom", "_island").agg(F.count("*").alias("_n"))
    d = d.join(n, ["chrom", "_island"])

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, float, int]] = []
        island = None
        for p in parts:
            kept = []
            for chrom, nth, name, pos, q in p[["chrom", "_island", "site_id", "pos", "q"]].itertuples(index=False):
                near = [h for h in held if (chrom, nth) == island and pos - h[0] < window]
                kept += [h[2] for h in held if h not in near]
                held, island = [*near, (pos, q, name)], (chrom, nth)
                if len(held) > most:
                    held.remove(held[-1] if keep == "first" else min(held, key=lambda h: (h[1], -h[0])))
            yield pd.DataFrame({"site_id": kept}, dtype="int64")
        yield pd.DataFrame({"site_id": [h[2] for h in held]}, dtype="int64")

    few = d.where(F.col("_n") <= most).select("site_id")
    many = d.where(F.col("_n") > most).repartition("chrom", "_island").sortWithinPartitions("chrom", "_island", "pos", "site_id").mapInPandas(walk, "site_id long")
    return sites.join(few.union(many), "site_id", "left_semi")


def allele_atoms(ref: str, alt: str) -> list[tuple[int, str, str]]:
    """(offset, ref, alt) atoms of a complex allele: substitutions base by base, and one indel at the end of the shared length."""
    n = min(len(ref), len(alt))
    out = [(i, ref[i], alt[i]) for i in range(n) if ref[i] != alt[i]]
    if len(ref) != len(alt):
        i = n - 1
        if out and out[-1][0] == i:
            out.pop()
        out.append((i, ref[i:], alt[i:]))
    return out


