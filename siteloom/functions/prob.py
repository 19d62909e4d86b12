"""Exact tests and probability helpers, as column expressions; the plain functions beside them say what they compute."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions.lets import let

_lgamma = np.vectorize(math.lgamma, otypes=[float])
PHRED = 4.34294481903


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)


def binom_two_sided_value(a: float, b: float) -> float:
    """P of a split at least as uneven as ``a`` to ``b`` by a fair coin; -1 for no reads, 1 for even ones."""
    a, b = int(a), int(b)
    if a + b == 0:
        return -1.0
    if a == b:
        return 1.0
    n, k = a + b, np.arange(min(a, b) + 1)
    return float(min(1.0, 2 * np.exp(_log_choose(np.full(len(k), n), k) - n * math.log(2)).sum()))


def fisher_value(a: int, b: int, c: int, d: int) -> float:
    """Two-tailed P of a 2x2 table: the tables with its margins that are not more likely."""
    a, b, c, d = int(a), int(b), int(c), int(d)
    r, s, n = a + b, a + c, a + b + c + d
    if n == 0:
        return 1.0
    x = np.arange(max(0, r + s - n), min(r, s) + 1)
    logs = _log_choose(np.full(len(x), r), x) + _log_choose(np.full(len(x), n - r), s - x) - _log_choose(np.array([n]), np.array([s]))
    p = np.exp(logs)
    return float(min(1.0, p[p <= p[a - x[0]] * (1 + 1e-7)].sum()))


def hwe_value(n_ref: int, n_alt: int, n_het: int) -> tuple[float, float]:
    """Exact test of Hardy-Weinberg proportions from allele counts and heterozygotes: (P, P of so many heterozygotes or more)."""
    n_ref, n_alt, n_het = int(n_ref), int(n_alt), int(n_het)
    rare, n = min(n_ref, n_alt), (n_ref + n_alt) // 2
    if n_ref + n_alt == 0 or n_het > rare or (rare - n_het) % 2 or rare == 0:
        return 1.0, 1.0
    hets = np.arange(rare % 2, rare + 1, 2)
    hom_rare, hom_common = (rare - hets) // 2, n - hets - (rare - hets) // 2
    logs = hets * math.log(2) - _lgamma(hets + 1) - _lgamma(hom_rare + 1) - _lgamma(hom_common + 1)
    p = np.exp(logs - logs.max())
    p /= p.sum()
    at = int(np.flatnonzero(hets == n_het)[0])
    return float(min(1.0, p[p <= p[at] * (1 + 1e-12)].sum())), float(p[at:].sum())


def _steps(n: Column) -> Column:
    """1 to n, empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def _weights(n: Column, ratio, slack: float) -> Column:  # noqa: ANN001
    """Walking ``n`` steps from a case of weight 1, each ``ratio`` of the last: the sum of all weights, and of those not above 1."""
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("every"), F.lit(0.0).alias("few"))

    def step(acc: Column, i: Column) -> Column:
        w = acc["w"] * ratio(i).cast("double")
        return F.struct(w.alias("w"), (acc["every"] + w).alias("every"), (acc["few"] + F.when(w <= 1 + slack, w).otherwise(0.0)).alias("few"))

    return F.aggregate(_steps(n), zero, step)


def binom_two_sided(a: Column, b: Column) -> Column:
    """As ``binom_two_sided_value``, in built-in expressions."""
    def tail(few: Column, many: Column) -> Column:
        """One walk from the case seen to that of no reads: the product of weights on the way is the case's own against that of none."""
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("every"), F.lit(0.0).alias("log"))

        def step(acc: Column, i: Column) -> Column:
            w = acc["w"] * ((few - i + 1) / (many + i))
            # weights may vanish where counts are large; then logs are added before they do
            log = F.when(w < 1e-250, acc["log"] + F.ln(w)).otherwise(acc["log"])
            return F.struct(F.when(w < 1e-250, 1.0).otherwise(w).alias("w"), (acc["every"] + F.when(acc["log"] < 0, 0.0).otherwise(w)).alias("every"), log.alias("log"))

        end = lambda acc: F.exp(-F.ln(acc["w"]) - acc["log"] - (few + many) * math.log(2)) * acc["every"]
        return F.least(F.lit(1.0), 2 * F.aggregate(_steps(few), zero, step, end))

    def of(v: Column) -> Column:
        p = tail(F.least(v["a"], v["b"]), F.greatest(v["a"], v["b"]))
        return F.when(v["a"].isNull() | v["b"].isNull(), None).when(v["a"] + v["b"] == 0, -1.0).when(v["a"] == v["b"], 1.0).otherwise(p)

    return let(F.struct(a.cast("double").cast("int").cast("double").alias("a"), b.cast("double").cast("int").cast("double").alias("b")), of)


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """As ``fisher_value``: tables are weighed against the one seen, step by step in both directions."""
    return let(F.struct(*(x.cast("double").alias(n) for x, n in zip((a, b, c, d), "abcd", strict=True))), lambda v: _fisher(v["a"], v["b"], v["c"], v["d"]))


def _fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    up = _weights(F.least(b, c), lambda i: (b - i + 1) * (c - i + 1) / ((a + i) * (d + i)), 1e-7)
    down = _weights(F.least(a, d), lambda i: (a - i + 1) * (d - i + 1) / ((b + i) * (c + i)), 1e-7)
    p = let(F.struct(up.alias("up"), down.alias("down")), lambda w: (1 + w["up"]["few"] + w["down"]["few"]) / (1 + w["up"]["every"] + w["down"]["every"]))
    return F.when(a + b + c + d > 0, p).when(a + b + c + d == 0, 1.0)


def _hardy_weinberg(n_ref: Column, n_alt: Column, n_het: Column) -> tuple[Column, Column, Column, Column]:
    rare, h = F.least(n_ref, n_alt).cast("double"), n_het.cast("double")
    both = F.floor((n_ref + n_alt) / 2).cast("double")
    r = (rare - h) / 2
    c = both - h - r
    up = _weights(r, lambda i: 4 * (r - i + 1) * (c - i + 1) / ((h + 2 * i) * (h + 2 * i - 1)), 1e-12)
    down = _weights(F.floor(h / 2), lambda i: (h - 2 * i + 2) * (h - 2 * i + 1) / (4 * (r + i) * (c + i)), 1e-12)
    odd = (rare == 0) | (h > rare) | ((rare - h) % 2 != 0)
    return up, down, odd, 1 + up["every"] + down["every"]


def hwe(n_ref: Column, n_alt: Column, n_het: Column) -> Column:
    """P of the exact test, as ``hwe_value``."""
    up, down, odd, total = _hardy_weinberg(n_ref, n_alt, n_het)
    return F.when(odd, 1.0).otherwise((1 + up["few"] + down["few"]) / total)


def exc_het(n_ref: Column, n_alt: Column, n_het: Column) -> Column:
    """P of so many heterozygotes or more."""
    up, _, odd, total = _hardy_weinberg(n_ref, n_alt, n_het)
    return F.when(odd, 1.0).otherwise((1 + up["every"]) / total)


def phred(p: Column) -> Column:
    return F.least(-PHRED * F.ln(p), F.lit(99.0))
