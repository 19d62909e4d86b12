"""Document fingerprints by MinHash, and near duplicates by their bands.

A fingerprint holds the minima of ``PERMUTATIONS`` universal hash permutations of 32-bit numbers over a text's
five-word shingles, 16 bits of each. All texts of a batch are hashed at once in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import textvec
from siteloom.llm.common import ARROW_ROWS, Scratch, batches_of, components, release, small_batches
from siteloom.llm.jaccard_join import only, open_groups, token_sets

#: Words in a shingle.
SHINGLE = 5
PERMUTATIONS = 128
#: Bands, and minima in each: of pairs with a similarity of 0.8 all but one in 2,800 share a band, with 0.85 all but one in 60,000.
BANDS, ROWS = 20, 5
#: Ranges of doc_id for each shuffle partition; places that a group's rows are dealt to.
RANGES, PLACES = 2, 8

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signatures(texts: pa.Array) -> np.ndarray:
    """A row of ``PERMUTATIONS`` 16-bit numbers for each text; 65535 throughout for a text without words."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    for at, raw, offsets in textvec.chunks(texts):
        h, bounds = textvec.shingles(*textvec.words(raw, offsets), SHINGLE)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        x, starts = (h >> np.uint64(32)).astype(np.uint32), bounds[some]
        for k in range(PERMUTATIONS):
            low = np.minimum.reduceat(x * _A[k] + _B[k], starts)
            low *= np.uint32(0x9E3779B1)  # spreads what the minima share in their high bits
            out[at + some, k] = low >> np.uint32(16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal numbers: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1, dtype=np.float64)


def hexed(sigs: np.ndarray) -> list[str]:
    width, text = 4 * PERMUTATIONS, sigs.astype(">u2").tobytes().hex()
    return [text[i : i + width] for i in range(0, len(text), width)]


def _rank(bounds: list[int], doc_id: Column) -> Column:
    """How many of the descending ``bounds`` lie above doc_id, by binary search; all of them for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds) if len(bounds) > 1 else F.array(F.lit(bounds[0]))
    above = lambda at: F.coalesce(F.get(table, at) > doc_id, F.get(table, at).isNotNull() & doc_id.isNull(), F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(above(at + s - 1), at + s).otherwise(at))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, group_id long, group_size long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, doc_id, text, group_id, group_size) in order; each row of a part needs the one after it, the last the row that is ``ahead``.

    A row with a group says what group the following rows of its doc_id are in.
    """
    now, names, texts = -1, [], []
    group: tuple = (None, None, None)
    for b in batches:
        for part, late, name, text, group_id, group_size in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if part != now:
                now, names, texts = part, [], []
            if group_size is not None:
                group = name, group_id, group_size
                continue
            if late and len(names) == len(texts) - 1:
                continue  # another row of the same doc_id; the first has been used
            texts.append(text or "")
            if not late:
                names.append((name, *(group[1:] if name is not None and name == group[0] else (name, 1))))
                if sum(map(len, texts[-64:])) < 1 << 19 and len(texts) < 1024:
                    continue
                if len(texts) > 1:
                    yield _fingerprints(names[:-1], texts)
                    names, texts = names[-1:], texts[-1:]
            elif names:
                yield _fingerprints(names, texts)
                names, texts = [], texts[-1:]


def _fingerprints(names: list[tuple], texts: list[str]) -> pa.RecordBatch:
    """Of all ``texts`` but the last, which only follows them; ``names`` are (doc_id, group_id, group_size)."""
    n = [len(t) for t in texts[:-1]]
    edited = [t[: k - k // 2] + after[: k // 2] for t, after, k in zip(texts, texts[1:], n, strict=False)]
    own, new = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(edited, pa.large_string()))
    ids, groups, sizes = zip(*names, strict=True)
    columns = [
        pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(hexed(own[:-1])), pa.array(hexed(new)), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        pa.array(groups, pa.int64()), pa.array(sizes, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _OUT.split(", ")])


def fingerprint_edits(spark: SparkSession, docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of their edited texts, which end with the next document's start, and the ``groups`` (doc_id, group_id, group_size) that they are in.

    The next document is the one before it by doc_id; the first follows the last. Texts are shuffled once, by ranges of doc_id; the first row of each range is sent to the range before it as well.
    Null text: empty. Null doc_id: after all others. Rows of one doc_id follow each other by a hash of their text.
    A single row follows itself. A text without words is like others without words only. Without a row in ``groups`` a document is a group of its own. Other columns go.
    """
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES * shuffles
    found = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found}, reverse=True)
    part = _rank(bounds, F.col("doc_id"))
    # as many rows as ranges: the largest doc_id of each that has rows
    heads = {r["part"]: r["head"] for r in docs.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect()}
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    size = max(filled, default=0) + 1
    head = F.array(*(F.lit(heads.get(p)).cast("long") for p in range(size)))
    prior = F.array(*(F.lit(before.get(p, 0)) for p in range(size)))
    first = F.get(head, F.col("part")).eqNullSafe(F.col("doc_id"))
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))
    there = F.struct(F.get(prior, F.col("part")).alias("part"), F.lit(1).alias("ahead"))
    rows = docs.withColumn("part", part).withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    none = F.lit(None).cast("long")
    rows = rows.select("to.part", "to.ahead", "doc_id", "text", none.alias("group_id"), none.alias("group_size"))
    if groups is not None:  # small rows that go where their documents go
        rows = rows.union(groups.select(part.alias("part"), F.lit(0), "doc_id", F.lit(None).cast("string"), "group_id", "group_size"))
    rows = rows.repartition(shuffles, "part")
    rows = rows.sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), F.col("group_size").isNull(), F.xxhash64("text"))
    return rows.mapInArrow(_runs, _OUT)


_SKETCH = "doc_id long, class binary, n long, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        sigs, sets = signatures(texts), token_sets(texts, SHINGLE)
        rows = sigs[:, : BANDS * ROWS].reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) << np.uint64(20), rows.shape[:2])
        for i in range(ROWS):
            key = textvec.mix(key ^ rows[:, :, i])
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))],
            ["doc_id", "class", "n", "bands"],
        )


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, group_id): groups of texts linked by a Jaccard similarity of num / den or more of their shingle sets.

    Texts whose signatures agree in one of the bands are candidates, and every link is verified over whole texts. Equal sets are one class.
    First each class is compared with the smallest of every band that it is in, so that large groups of near copies come together by
    comparisons that grow with the documents. Then in each band that still holds several groups all its classes are compared with each other,
    dealt out in parts, so that no pair that shares a band is left out. Bands of the same classes are opened once.
    group_id is the smallest doc_id of a group. Texts without words are alone. Null doc_id: kept out. Repeated rows: one. Rows of one doc_id and different texts: each the group of its text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    with Scratch(spark, "minhash") as scratch:
        with batches_of(spark, ARROW_ROWS):
            made = scratch.cut(docs.mapInArrow(_sketch, _SKETCH), "sketch")
        classes = scratch.cut(made.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
        reps = made.select("doc_id", "class", "bands").join(classes.toDF("class", "doc_id"), ["class", "doc_id"], "left_semi").dropDuplicates(["class", "doc_id"])
        keyed = reps.select("doc_id", F.explode("bands").alias("band"))
        shared = keyed.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("many"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members")).where("many > 1")
        shared = scratch.cut(shared, "shared")
        met = only(scratch, keyed, "band", shared.select("band")).join(shared, "band")
        met = scratch.cut(met.select("doc_id", "band", "first", "many", "members"), "met")
        led = met.where("doc_id <> first").select(F.col("doc_id").alias("query"), F.col("first").alias("grp")).distinct()
        alone = met.select(F.col("first").alias("doc_id")).distinct().select("doc_id", F.col("doc_id").alias("grp"), F.lit(1).alias("size"))
        links = open_groups(scratch, docs, led, alone, None, SHINGLE, num, den)
        linked = scratch.cut(components(scratch, links), "linked")
        of = met.join(linked.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        # of bands with the same members one is enough
        several = of.groupBy("band", "many", "members").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        several = several.groupBy("many", "members").agg(F.min("band").alias("band"))
        members = met.select("doc_id", "band").join(several.select("band", F.col("many").alias("size")), "band")
        members = scratch.cut(members.select("doc_id", F.col("band").alias("grp"), "size"), "open")
        more = open_groups(scratch, docs, members.select(F.col("doc_id").alias("query"), "grp"), members, linked, SHINGLE, num, den)
        groups = components(scratch, links.union(more))
        member = made.select("doc_id", "class").join(classes, "class", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct()
        out = member.join(groups.toDF("rep", "group"), "rep", "left").select("doc_id", F.coalesce("group", "rep").alias("group_id"))
        return scratch.keep(out)


def group_sizes(found: DataFrame) -> DataFrame:
    """(doc_id, group_id, group_size) of those that aren't alone, of ``found`` (doc_id, group_id); the smallest group of a doc_id in several."""
    found = found.groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    sizes = found.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    # a large group's rows are dealt to several places, its size copied to each
    places = found.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int"))
    return places.join(sizes.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))), ["group_id", "place"]).select("doc_id", "group_id", "group_size")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = Scratch(spark, "minhash").keep(group_sizes(near_duplicates(spark, docs)), "groups")
    release(spark)
    return fingerprint_edits(spark, docs, groups)
