"""Exact Jaccard join of documents on word n-grams, by a token-group matrix.

Documents are partitioned into groups of similar ones; the matrix holds, for each token, the groups whose union has it.
A document's overlap with a group is bounded by how many of its tokens the union has, and only groups that reach
the bound are opened, that is compared in full. The result is the components of the links.

* Documents with equal sets are one class, of which the smallest doc_id stands for all.
* Classes that agree in some minima of hash permutations with a leader, the smallest, are a group of similar documents, linked or not.
  Each is compared with its leader in full, and what is linked so far is kept in one group.
* The matrix needs the prefix of each set only, in one order of all tokens, the rare first: two sets with the wanted
  similarity share ``EVIDENCE`` tokens at least of their prefixes, so a query must share so many with a group's union.
  The order is by a fixed-size sketch of counts, over all documents; any order gives the same links.
* Tokens found in one group only are dropped, and queries are made from the smaller group to the larger. Within a group those
  ask that aren't yet linked with most of it. So a group of very many near copies costs comparisons that grow with the
  copies, not with their pairs, and no pair of its documents is ever made as a row.
* To open a group, its members are dealt out in parts; each query meets each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm import textvec
from siteloom.llm.common import ARROW_ROWS, Scratch, batches_of, components, small_batches

#: Shared tokens of two prefixes that are asked for; prefixes are as much longer.
EVIDENCE = 3
#: Hash permutations whose minima find leaders, and how many must agree.
MINIMA, AGREE = 4, 2
#: log2 of the counters of the sketch, 4 bytes each.
SKETCH_BITS = 20
#: Members of a group that are compared at a time, and queries dealt to one copy of them.
MEMBERS, QUERIES = 512, 1000
#: log2 of the bits of the filter of wanted ids, at most: 32 MB.
FILTER_BITS = 28
#: Rows in an Arrow batch of numbers.
NUMBER_ROWS = 50_000
#: A token comes very often if its counter is above this number and so many times the mean; places that its rows are dealt to.
OFTEN, OFTEN_TIMES, COPIES = 50_000, 20, 64
_SLICE = 1 << 16

_MULTIPLIERS = np.random.default_rng(99).integers(1, 1 << 62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def token_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams."""
    out: list[np.ndarray] = []
    for _, raw, offsets in textvec.chunks(texts):
        h, bounds = textvec.shingles(*textvec.words(raw, offsets), words)
        out += [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _merged(parts: DataFrame, dtype: str, join: str) -> np.ndarray:
    """(slice, data) summed or or-ed by slice: one array of a fixed size, whatever the number of rows."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(1):
                a = np.frombuffer(x.as_py(), dtype=dtype)
                total = a.copy() if total is None else getattr(np, join)(total, a, out=total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "data"])

    rows = parts.groupBy("slice").applyInArrow(run, "slice int, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], dtype=dtype) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(0, dtype)


def _slices(a: np.ndarray) -> Iterator[pa.RecordBatch]:
    data = a.tobytes()
    for i in range(0, len(data), _SLICE):
        yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE], pa.int32()), pa.array([data[i : i + _SLICE]], pa.binary())], ["slice", "data"])


def token_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often tokens come that begin with the same ``SKETCH_BITS`` bits, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            for _, raw, offsets in textvec.chunks(b.column(0), 2 * textvec.CHUNK_BYTES):
                h, _ = textvec.shingles(*textvec.words(raw, offsets), words)
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield from _slices(np.minimum(total, (1 << 31) - 1).astype("<u4"))

    return _merged(docs.select("text").mapInArrow(run, "slice int, data binary"), "<u4", "add")


_SETS = "doc_id long, n long, class binary, minima array<long>, prefix array<long>"


def _describe(docs: DataFrame, words: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """For each document its set's size, 128-bit hash, minima and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            n, name, minima, prefix = [], [], [], []
            for s in token_sets(b.column(1), words):
                n.append(len(s))
                if not len(s):
                    name.append(None)
                    minima.append(None)
                    prefix.append(None)
                    continue
                least = -(-num * len(s) // den)  # of its tokens that a linked set shares
                size = len(s) - least + min(EVIDENCE, least)
                order = np.argsort(table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:size]
                name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                minima.append(np.array([(s * m).min() for m in _MULTIPLIERS]).view(np.int64))
                prefix.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(minima, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "n", "class", "minima", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _SETS)


def only(scratch: Scratch, rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``name`` is in ``ids`` (one column of longs), and few others: by a filter of a fixed size, so that other rows aren't shuffled.

    Beyond some 16 million ids the filter lets more through, which costs shuffling, not results.
    """
    bits = 16
    count = ids.count()
    while (1 << bits) < 16 * count and bits < FILTER_BITS:
        bits += 1

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = textvec.mix(x.astype(np.int64).view(np.uint64))
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            for p in places(b.column(0).to_numpy(zero_copy_only=False)):
                seen[p] = True
        yield from _slices(np.packbits(seen, bitorder="little"))

    wanted = _merged(ids.mapInArrow(run, "slice int, data binary"), "u1", "bitwise_or")
    if not len(wanted):
        return rows.limit(0)
    sent = scratch.spark.sparkContext.broadcast(wanted)

    @F.pandas_udf("boolean")
    def may(x):  # noqa: ANN001, ANN202
        import pandas as pd

        table = sent.value
        found = [(table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in places(x.to_numpy())]
        return pd.Series((found[0] & found[1]).astype(bool))

    return rows.where(may(name))


def open_groups(scratch: Scratch, docs: DataFrame, asked: DataFrame, members: DataFrame, linked: DataFrame | None, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of queries to members of the groups asked for: for each query and part of a group, one to each component that it wasn't in.

    ``asked`` (query, grp), ``members`` (doc_id, grp, size), ``linked`` (node, component) so far. A part is ``MEMBERS`` members; where more than ``QUERIES`` queries ask
    for a group, its parts are copied and the queries shared out.
    """
    stats = asked.groupBy("grp").agg(F.count("*").alias("asks"))
    opened = members.join(stats, "grp").withColumn("parts", F.expr(f"cast(ceil(size / {MEMBERS}) as int)")).withColumn("copies", F.expr(f"cast(ceil(asks / {QUERIES}) as int)"))
    opened = scratch.cut(opened.select("doc_id", "grp", "parts", "copies"), "opened")
    shape = opened.groupBy("grp").agg(F.first("parts").alias("parts"), F.first("copies").alias("copies"))
    own = opened.select("doc_id", "grp", F.lit(0).alias("role"), F.expr("pmod(xxhash64(doc_id), parts)").cast("int").alias("part"), F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
    queries = asked.join(shape, "grp").select(F.col("query").alias("doc_id"), "grp", F.lit(1).alias("role"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("pmod(xxhash64(query), copies)").cast("int").alias("copy"))
    rows = scratch.cut(own.union(queries), "dealt")
    texts = only(scratch, docs, "doc_id", rows.select("doc_id").distinct()).select("doc_id", "text")
    dealt = rows.join(texts, "doc_id").withColumn("component", F.col("doc_id"))
    if linked is not None:
        dealt = dealt.drop("component").join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    dealt = dealt.select("grp", "part", "copy", "role", "doc_id", "component", "text")
    dealt = dealt.repartition("grp", "part", "copy").sortWithinPartitions("grp", "part", "copy", "role", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, own, sets, flat = None, [], [], [], None
        owner = sizes = names = comps = None
        for b in batches:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for key, role, name, comp, s in zip(keys, *(b.column(i).to_pylist() for i in (3, 4, 5)), token_sets(b.column(6), words), strict=True):
                if key != now:
                    now, ids, own, sets, flat = key, [], [], [], None
                if not role:
                    ids.append(name)
                    own.append(comp)
                    sets.append(s)
                    continue
                if not ids or not len(s):
                    continue
                if flat is None:
                    sizes, names, comps = np.array([len(x) for x in sets]), np.array(ids), np.array(own)
                    flat = np.concatenate(sets)
                    order = np.argsort(flat, kind="stable")
                    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                ok = np.flatnonzero((den * shared >= num * (len(s) + sizes - shared)) & (comps != comp))
                found += [(name, int(names[ok[i]])) for i in np.unique(comps[ok], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    small_batches(scratch.spark)
    return scratch.cut(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def _leaders(scratch: Scratch, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(query, grp) of classes and the leader, the smallest class, of those that agree in a minimum and in about their size."""
    band = F.floor(F.log(F.col("n").cast("double")) / (2 * float(np.log(den / num)))) if den > num else F.col("n")
    keys = reps.select("doc_id", band.alias("band"), F.posexplode("minima").alias("i", "low"))
    first = keys.groupBy("i", "low", "band").agg(F.min("doc_id").alias("grp"), F.count("*").alias("many")).where("many > 1").drop("many")
    met = keys.join(first, ["i", "low", "band"]).where("doc_id <> grp")
    return scratch.cut(met.groupBy(F.col("doc_id").alias("query"), "grp").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE).select("query", "grp"), "leaders")


def _groups(scratch: Scratch, reps: DataFrame, led: DataFrame, found: DataFrame) -> DataFrame:
    """``reps`` with their group, its size and rank, and whether they ask in it: the leader's leader, or the least one among what is linked."""
    first = led.groupBy(F.col("query").alias("doc_id")).agg(F.min("grp").alias("l1"))
    second = first.select(F.col("doc_id").alias("l1"), F.col("l1").alias("l2"))
    near = first.join(second, "l1", "left").select("doc_id", F.coalesce("l2", "l1").alias("lead"))
    known = near.select("doc_id").union(led.select("grp")).union(found.select("node")).distinct()
    known = known.join(near, "doc_id", "left").join(found.toDF("doc_id", "component"), "doc_id", "left")
    known = scratch.cut(known.select("doc_id", F.coalesce("lead", "doc_id").alias("lead"), F.coalesce("component", "doc_id").alias("component")), "known")
    one = known.groupBy("component").agg(F.min("lead").alias("grp"), F.count("*").alias("many"))
    shape = one.groupBy("grp").agg(F.sum("many").alias("size"), F.max(F.struct("many", "component"))["component"].alias("most"))
    known = known.join(one.select("component", "grp"), "component").join(shape, "grp")
    known = scratch.cut(known.select("doc_id", "grp", "size", (F.col("component") != F.col("most")).alias("asks")), "groups")
    out = reps.select("doc_id", "n", "prefix").join(known, "doc_id", "left")
    out = out.select("doc_id", "n", "prefix", F.coalesce("grp", "doc_id").alias("grp"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("asks", F.lit(False)).alias("asks"))
    return out.withColumn("rank", F.floor(F.log2(F.col("size").cast("double"))).cast("long"))


def _matrix(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, grp, doc_id, n, rank) by token to (query, grp, evidence): who shares the token with which larger group, if sizes allow a link."""
    held: list[np.ndarray] | None = None

    def work(c: list[np.ndarray]) -> pa.RecordBatch:
        token, grp, doc, n, rank = c
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(token)))
        many = (np.add.reduceat((grp != np.repeat(grp[starts], size)).astype(np.int64), starts) > 0) if len(starts) else np.zeros(0, bool)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        two = starts[many & (size == 2)]
        if len(two):
            up = (rank[two] < rank[two + 1]) | ((rank[two] == rank[two + 1]) & (grp[two] > grp[two + 1]))  # the first asks the second
            q, g = np.where(up, two, two + 1), np.where(up, two + 1, two)
            ok = (num * np.maximum(n[q], n[g]) <= den * np.minimum(n[q], n[g]))
            out.append((q[ok], grp[g[ok]]))
        for s, k in zip(starts[many & (size > 2)], size[many & (size > 2)], strict=True):
            here = slice(s, s + k)
            gs, first, inverse = np.unique(grp[here], return_index=True, return_inverse=True)
            lo, hi = np.full(len(gs), np.iinfo(np.int64).max), np.zeros(len(gs), np.int64)
            np.minimum.at(lo, inverse, n[here])
            np.maximum.at(hi, inverse, n[here])
            r = rank[here][first]
            for at in range(0, k, 1024):
                i = slice(s + at, s + min(k, at + 1024))
                asks = (rank[i, None] < r) | ((rank[i, None] == r) & (grp[i, None] > gs))
                asks &= (num * n[i, None] <= den * hi) & (num * lo <= den * n[i, None])
                q, g = np.nonzero(asks)
                out.append((q + i.start, gs[g]))
        q = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        g = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        evidence = np.minimum(EVIDENCE, -(-num * n[q] // den))
        return pa.RecordBatch.from_arrays([pa.array(doc[q]), pa.array(g), pa.array(evidence)], ["query", "grp", "evidence"])

    for b in batches:
        c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        c = c if held is None else [np.concatenate(x) for x in zip(held, c, strict=True)]
        cut = int(np.searchsorted(c[0], c[0][-1], "left")) if len(c[0]) else 0
        held = [x[cut:] for x in c]
        if cut:
            yield work([x[:cut] for x in c])
    if held is not None:
        yield work(held)


def _frequent(spark: SparkSession, counts: np.ndarray) -> DataFrame | None:
    """(slot) of the counters so high that their tokens' rows are dealt out apart. By their definition at most one in ``OFTEN_TIMES`` counters is."""
    slots = np.flatnonzero(counts > max(OFTEN, OFTEN_TIMES * float(counts.mean()))) if len(counts) else counts
    return spark.createDataFrame([(int(x),) for x in slots], "slot long") if len(slots) else None


def _asked(scratch: Scratch, grouped: DataFrame, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """(query, grp) of the groups whose union shares enough of a query's prefix.

    Rows of one token lie in one task. Those of tokens that come very often are taken apart: each group gives one row, with the range of its sizes, copied to
    ``COPIES`` places among which the queries are dealt.
    """
    rows = grouped.select(F.explode("prefix").alias("token"), "grp", "doc_id", "n", "rank")
    shared = None
    frequent = _frequent(scratch.spark, counts)
    if frequent is not None:
        marked = rows.withColumn("slot", F.shiftrightunsigned("token", 64 - SKETCH_BITS)).join(F.broadcast(frequent.withColumn("often", F.lit(True))), "slot", "left").drop("slot")  # at most 2^20 / 20 rows
        often, rows = scratch.cut(marked.where("often").drop("often"), "often"), marked.where("often is null").drop("often")
        asks = often.select("token", F.col("grp").alias("own"), F.col("doc_id").alias("query"), "n", F.col("rank").alias("own_rank"), F.expr(f"pmod(xxhash64(doc_id), {COPIES})").cast("int").alias("copy"))
        has = often.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("rank").alias("rank"))
        has = has.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        up = "own <> grp and (own_rank < rank or (own_rank = rank and own > grp))"
        met = asks.hint("merge").join(has, ["token", "copy"]).where(f"{up} and {num} * n <= {den} * hi and {num} * lo <= {den} * n")
        shared = met.select("query", "grp", F.expr(f"least({EVIDENCE}, cast(ceil({num} * n / {den}) as long))").alias("evidence"))
    rows = rows.repartition("token").sortWithinPartitions("token")
    with batches_of(scratch.spark, NUMBER_ROWS):
        plain = rows.mapInArrow(lambda it: _matrix(it, num, den), "query long, grp long, evidence long")
        shared = plain if shared is None else plain.union(shared)
        return scratch.cut(shared.groupBy("query", "grp").agg(F.count("*").alias("hits"), F.first("evidence").alias("evidence")).where("hits >= evidence").select("query", "grp"), "asked")


def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_shingles, component_id), a row for each.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set is its distinct ``words``-word shingles, its whole sequence
    if it has fewer. Documents link where ``den`` x intersection >= ``num`` x union; component_id is the smallest doc_id reachable by links.
    Null or empty text, or no words: 0 shingles, linked with nothing. Null doc_id: counted, linked with nothing, null
    component_id. Repeated rows: each its row, in one component. Rows of one doc_id and different texts: each the component of its text. Other columns go.
    """
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with Scratch(spark, "jaccard") as scratch:
        counts = token_counts(docs, words)
        if not len(counts):
            counts = np.zeros(1 << SKETCH_BITS, "<u4")
        sets = scratch.cut(_describe(docs, words, num, den, counts), "sets")
        classes = scratch.cut(sets.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
        named = docs.where("doc_id is not null")
        reps = sets.join(classes.toDF("class", "doc_id"), ["class", "doc_id"], "left_semi").dropDuplicates(["class", "doc_id"])
        reps = scratch.cut(reps.select("doc_id", "n", "minima", "prefix"), "reps")
        alone = reps.select("doc_id", F.col("doc_id").alias("grp"), F.lit(1).alias("size"))
        led = _leaders(scratch, reps, num, den)
        links = open_groups(scratch, named, led, alone, None, words, num, den)
        linked = scratch.cut(components(scratch, links), "linked")
        grouped = _groups(scratch, reps, led, linked)
        asked = _asked(scratch, grouped, counts, num, den).union(grouped.where("asks").select(F.col("doc_id").alias("query"), "grp"))
        more = open_groups(scratch, named, asked, grouped.select("doc_id", "grp", "size"), linked, words, num, den)
        found = components(scratch, links.union(more))
        member = sets.select("doc_id", "n", "class").join(classes, "class", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
        out = member.join(found.toDF("rep", "component"), "rep", "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
        return scratch.keep(out)


def one_of_each(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one document of each group of linked ones, the smallest doc_id, once.

    Documents without words and rows of null doc_id stay, once for each text. Of repeated rows of one doc_id and text the one whose columns as text sort first stays.
    """
    found = jaccard_components(spark, docs, words, num, den)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_sl_kept")).distinct()
    # by shuffle at every size: what is kept grows with the input
    out = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["_sl_kept"]), "left_semi")
    names = docs.columns
    inner = out.toDF(*(f"_sl_{i}" for i in range(len(names))))  # whatever the columns' names
    at = {c: f"_sl_{i}" for i, c in enumerate(names)}
    once = inner.withColumn("_sl_text", F.xxhash64(at["text"])).withColumn("_sl_row", F.to_json(F.struct(*(c for c in inner.columns if c != at["text"]))))
    nth = F.row_number().over(Window.partitionBy(at["doc_id"], "_sl_text").orderBy("_sl_row"))
    return once.withColumn("_sl_nth", nth).where("_sl_nth = 1").drop("_sl_text", "_sl_row", "_sl_nth").toDF(*names)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)
