"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

* Equal vectors are one class. A rotation for balanced binary codes is learned on a bounded sample (Gong and Lazebnik
  2011); where the tables need more bits than a rotation gives, several are learned.
* Codes are cut into substrings of about log2 of the number of classes, one table each. Two vectors meet in a table
  if their substrings differ in at most one bit: each is entered under its substring with any one bit left out.
  The number of tables is what the wanted chance to meet at the threshold takes.
* Vectors within half the threshold angle of a leader form a cell; any two of a cell are linked, so that pairs within a cell
  are counted and never made. A very large group of near copies is one cell, or few.
* Pairs of different cells that meet and whose codes are near are compared with their original vectors, in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, batches_of, components, small_batches
from siteloom.llm.textvec import mix

#: Vectors link from this cosine.
COSINE = 0.95
#: Bounds of the sample for the rotations: rows, and numbers in all.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 1 << 22
#: Rounds of the quantisation.
ROUNDS = 30
#: Wanted chance that a pair at the threshold meets in no table.
MISS = 0.02
#: Deviations above the expected number of differing bits at the threshold at which codes count as far.
FAR = 4.5
#: Most lengths of vectors that rotations are learned for; others get seeded random ones.
LENGTHS = 16


class Coder:
    """Binary codes of unit vectors of any length, as ``tables`` substrings of ``width`` bits."""

    def __init__(self, n: int, cosine: float = COSINE) -> None:
        flip = math.acos(cosine) / math.pi
        self.width = min(30, max(8, math.ceil(math.log2(max(2, n)))))
        near = (1 - flip) ** self.width + self.width * flip * (1 - flip) ** (self.width - 1)
        self.tables = max(2, math.ceil(math.log(MISS) / math.log(1 - near)))
        bits = self.bits = self.tables * self.width
        self.far = flip * bits + FAR * math.sqrt(bits * flip * (1 - flip))
        self.known: dict[int, np.ndarray] = {}

    def learn(self, x: np.ndarray, seed: int = 1) -> None:
        """Rotations for the length of ``x``'s rows. They aren't centred: links are angles at the origin, and a large group of
        near copies would be torn apart by codes around its own mean."""
        dim = x.shape[1]
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1]
        rng, made, have = np.random.default_rng(seed), [], 0
        while have < self.bits:
            v = x @ axes
            r, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
                r = u @ w
            made.append(axes @ r)
            have += dim
        self.known[dim] = np.concatenate(made, axis=1)[:, : self.bits]

    def _projection(self, dim: int) -> np.ndarray:
        if dim not in self.known:
            rng = np.random.default_rng(dim)
            q = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-self.bits // dim))]
            self.known[dim] = np.concatenate(q, axis=1)[:, : self.bits]
        return self.known[dim]

    def code(self, x: np.ndarray) -> np.ndarray:
        """A row of substrings for each row of ``x``."""
        bit = (x @ self._projection(x.shape[1]) >= 0).reshape(len(x), self.tables, self.width)
        return (bit.astype(np.int64) << np.arange(self.width)).sum(axis=2)

    def keys(self, code: np.ndarray, dim: np.ndarray) -> np.ndarray:
        """Table entries of each code: for each table and bit, the substring without that bit."""
        masks = ~(np.int64(1) << np.arange(self.width, dtype=np.int64))
        left = (code[:, :, None] & masks).astype(np.uint64)
        where = np.arange(self.tables * self.width, dtype=np.uint64).reshape(1, self.tables, self.width)
        return mix(mix(left + (where << np.uint64(32))) ^ mix(dim.astype(np.uint64))[:, None, None]).reshape(len(code), -1).view(np.int64)

    def first_met(self, a: np.ndarray, b: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether ``entry`` is the first in which codes ``a`` and ``b`` meet, and they are near."""
        x = a ^ b
        meet = (x & (x - 1)) == 0
        table = meet.argmax(axis=1)
        low = x[np.arange(len(x)), table]
        bit = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(np.int64), 0)
        return (np.bitwise_count(x).sum(axis=1) <= self.far) & (entry == table * self.width + bit)


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for a vector that links with nothing."""
    out: list[np.ndarray | None] = []
    values = column.flatten().to_numpy(zero_copy_only=False)
    at = 0
    for size, ok in zip(pa.compute.list_value_length(column).to_pylist(), column.is_valid().to_pylist(), strict=True):
        if not ok or size is None:
            out.append(None)
            continue
        x = values[at : at + size].astype(np.float64)
        at += size
        with np.errstate(all="ignore"):
            top = np.abs(x).max(initial=0.0)
            norm = top * math.sqrt(((x / top) ** 2).sum()) if top > 0 and math.isfinite(top) else 0.0
        out.append(x / norm if norm > 0 and math.isfinite(norm) else None)
    return out


def _cosines(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return np.array([float(x @ y) if x is not None and y is not None and len(x) == len(y) else -1.0 for x, y in zip(a, b, strict=True)])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units = _units(b.column(1))
        name = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
        dim = [None if u is None else len(u) for u in units]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.binary()), pa.array(dim, pa.int64()), b.column(1)], ["vec_id", "class", "dim", "embedding"])


def _pairs(coder: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, entry, vec_id, cell, code) by key to pairs (a, b) of different cells, each from the first entry in which they meet."""
    held: list[np.ndarray] | None = None
    close = 16

    def work(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, entry, name, cell, code = c
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))

        def emit(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok = (cell[i] != cell[j]) & (entry[i] == entry[j])
            i, j = i[ok], j[ok]
            ok = coder.first_met(code[i], code[j], entry[i])
            i, j = name[i[ok]], name[j[ok]]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

        # short runs all at once, by distance within the run
        short = np.repeat(size <= close, size)
        ends = np.repeat(starts + size, size)
        for d in range(1, close):
            i = np.flatnonzero(short & (np.arange(len(key)) + d < ends))
            if not len(i):
                break
            yield from emit(i, i + d)
        # long runs cell by cell, so that nothing is made of pairs within a cell
        for s, n in zip(starts[size > close], size[size > close], strict=True):
            by = s + np.argsort(cell[s : s + n], kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], cell[by][1:] != cell[by][:-1]]))
            for at, stop in zip(begin, [*begin[1:], n], strict=True):
                rest = by[stop:]
                for lo in range(at, stop, 512):
                    own = by[lo : min(stop, lo + 512)]
                    for r in range(0, len(rest), 512):
                        part = rest[r : r + 512]
                        yield from emit(np.repeat(own, len(part)), np.tile(part, len(own)))

    for b in batches:
        c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        c.append(b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1))
        c = c if held is None else [np.concatenate(x) for x in zip(held, c, strict=True)]
        cut = int(np.searchsorted(c[0], c[0][-1], "left")) if len(c[0]) else 0
        held = [x[cut:] for x in c]
        if cut:
            yield from work([x[:cut] for x in c])
    if held is not None and len(held[0]):
        yield from work(held)


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vectors`` (vec_id, embedding) as (vec_id, n_links, component_id, kept), a row for each.

    Vectors link if their cosine in double precision is ``cosine`` or more; every link counted was compared, or follows from two
    angles to a leader. Null and zero vectors, and those with null or non-finite components, link with nothing, nor do vectors
    of different lengths. Equal vectors are linked. Repeated rows (same id and vector) count as one vector, each with its row. Null
    vec_id: links with nothing, is kept. Empty table: no rows. Other columns go. Rotations are learned for the ``LENGTHS`` commonest lengths of vectors;
    those of rarer lengths are random (seeded), which costs candidates, not recall: tables are as many for any rotation.
    """
    small_batches(spark)
    inner = math.cos(math.acos(cosine) / 2) + 1e-9
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    kind = dict(vectors.dtypes)["embedding"]
    with Scratch(spark, "vectors") as scratch:
        rows = scratch.cut(vectors.mapInArrow(_classes, f"vec_id long, class binary, dim long, embedding {kind}"), "rows")
        good = rows.where("class is not null and vec_id is not null")
        classes = scratch.cut(good.select("class", "vec_id").distinct().groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
        reps = good.join(classes.withColumnRenamed("rep", "vec_id"), ["class", "vec_id"]).dropDuplicates(["class", "vec_id"])
        reps = scratch.cut(reps.select("vec_id", "many", "dim", "embedding"), "reps")
        coder = Coder(reps.count(), cosine)
        lengths = [r["dim"] for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
        for dim in lengths:
            size = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
            sample = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("embedding").toArrow()
            units = [u for c in sample.column(0).chunks for u in _units(c)]
            coder.learn(np.array(units))
        sent = spark.sparkContext.broadcast(coder)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                units, dim = _units(b.column(3)), b.column(2).to_numpy()
                codes = np.zeros((len(units), sent.value.tables), np.int64)
                for d in np.unique(dim):
                    at = np.flatnonzero(dim == d)
                    codes[at] = sent.value.code(np.array([units[i] for i in at]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(codes), pa.list_(pa.int64()))], [*b.schema.names, "code"])

        coded = scratch.cut(reps.mapInArrow(code, f"vec_id long, many long, dim long, embedding {kind}, code array<long>"), "coded")

        def within(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = _cosines(_units(b.column(2)), _units(b.column(3))) >= least
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

        def compared(pairs: DataFrame, least: float) -> DataFrame:
            v = coded.select("vec_id", "embedding")
            both = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
            return both.mapInArrow(lambda it: within(it, least), "a long, b long")

        cells, free = None, coded
        for t in range(min(2, coder.tables // 2)):
            key = [F.col("dim"), F.get("code", F.lit(2 * t)), F.get("code", F.lit(2 * t + 1))]
            keyed = free.select("vec_id", F.xxhash64(*key).alias("k"))
            first = keyed.groupBy("k").agg(F.min("vec_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
            asked = keyed.join(first, "k").where("vec_id <> leader").select(F.col("vec_id").alias("a"), F.col("leader").alias("b"))
            got = scratch.cut(compared(asked, inner), "cells")
            cells = got if cells is None else cells.union(got)
            taken = got.select(F.col("a").alias("vec_id")).union(got.select("b")).distinct()
            free = free.join(taken, "vec_id", "left_anti")
        celled = coded.drop("embedding")
        celled = celled.join(cells.toDF("vec_id", "leader"), "vec_id", "left").withColumn("cell", F.coalesce("leader", "vec_id")).drop("leader") if cells is not None else celled.withColumn("cell", F.col("vec_id"))
        celled = scratch.cut(celled, "celled")

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = b.column(3).flatten().to_numpy().reshape(len(b), -1)
                keys = sent.value.keys(codes, b.column(1).to_numpy())
                n = keys.shape[1]
                for lo in range(0, len(b), 128):
                    at = np.repeat(np.arange(lo, min(len(b), lo + 128)), n)
                    entry = np.tile(np.arange(n, dtype=np.int64), len(at) // n)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at, entry]), pa.array(entry), b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at))], ["key", "entry", "vec_id", "cell", "code"])

        entered = celled.select("vec_id", "dim", "cell", "code").mapInArrow(enter, "key long, entry long, vec_id long, cell long, code array<long>")
        entered = entered.repartition("key").sortWithinPartitions("key")
        with batches_of(spark, 8192):  # numbers, not texts
            pairs = scratch.cut(entered.mapInArrow(lambda it: _pairs(sent.value, it), "a long, b long"), "pairs")
            links = scratch.cut(compared(pairs, cosine), "links")
        edges = links.union(celled.where("cell <> vec_id").select("cell", "vec_id"))
        found = components(scratch, edges)
        sizes = celled.groupBy("cell").agg(F.sum("many").alias("cell_many"))
        both = links.union(links.select("b", "a")).join(celled.select(F.col("vec_id").alias("b"), F.col("many").alias("n")), "b")
        across = both.groupBy("a").agg(F.sum("n").alias("across"))
        per = celled.join(sizes, "cell").join(across.withColumnRenamed("a", "vec_id"), "vec_id", "left").join(found.toDF("vec_id", "component"), "vec_id", "left")
        per = per.select(F.col("vec_id").alias("rep"), (F.col("cell_many") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        member = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class")).alias("class")).join(classes.select("class", "rep"), "class", "left")
        out = member.join(per, "rep", "left").select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        return scratch.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
