"""Packing of tokenised documents into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most that many
numbers, whatever the corpus. It is reduced and packed on the driver as patterns with
multiplicities; pieces then find their place from their rank among pieces of their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, small_batches

#: Tokens in a sequence.
CAPACITY = 2048
#: Id put after each document.
END_ID = 0
#: Pieces of one length that are ranked in one group.
RANK_ROWS = 20_000

_WORKER: dict[str, tuple] = {}
_WORD_END = "</w>"

# How a vocabulary whose words can be learned one by one normalises texts and cuts them into words.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: Bytes of text whose different words are found together, and words that the model encodes in one call.
CHUNK, TOGETHER = 1 << 23, 1 << 14
_SPACE = re.compile(rb"[ \t-\r]")
#: ASCII punctuation without the apostrophe, which begins contractions.
_POINTS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and i != 39)
#: Byte-level letters: printable bytes stand for themselves, the others for the characters from 256 on, in order. Spaces stay.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256) if b != 32}


def _plain(texts: pa.Array) -> pa.Array:
    """The texts with fewer different words and the same ids: ASCII letters lower.

    Left as it is where a control string might be matched before lowering, or a combining mark composed.
    """
    raw = texts.cast(pa.large_binary())
    keep = pc.or_(pc.match_substring(raw, b"<|"), pc.or_(pc.match_substring(raw, b"\xcc"), pc.match_substring(raw, b"\xcd")))
    return pc.if_else(keep, texts, pc.ascii_lower(texts))


def _from_zero(texts: pa.Array) -> pa.Array:
    """As large_string whose bytes begin at 0: kernels of this library go wrong on parts of a longer array."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] if texts.buffers()[2] is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), data.slice(int(ends[0]), int(ends[-1] - ends[0])))


def _segments(text: bytes) -> list[bytes]:
    """A long text cut after white space into parts of about ``CHUNK`` bytes; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        m = _SPACE.search(text, at + CHUNK)
        if not m:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def _letters(word: bytes) -> bytes | None:
    """The word as the normaliser leaves it, if it is then one run of letters; else None."""
    if word.isalpha():  # ASCII letters only
        return word.lower()
    if word.isascii():
        return None
    text = word.decode("utf-8")
    if not text.isalpha() or not unicodedata.is_normalized("NFC", text):
        return None
    low = text.lower()
    if low == text:
        return word
    low = "".join(map(str.lower, text))  # character by character, without the rule for a last sigma
    return low.encode() if low.isalpha() else None


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``data`` from ``start``, ``size`` long each, one after another."""
    upto = np.cumsum(size) - size
    return data[np.repeat(start - upto, size) + np.arange(size.sum())]


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string or large_binary array."""
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class _Pool:
    """Ids of runs one after another, and where each run's begin and how many they are. Run 0 is empty."""

    def __init__(self) -> None:
        self.ids, self.sizes = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        self.count = 1

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Takes in runs; the number of the first of them."""
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.count += len(sizes)
        return self.count - len(sizes)

    def words(self, runs: np.ndarray) -> pa.Array:
        """Ids of words of two runs each, as bytes."""
        ids, size = np.concatenate(self.ids), np.concatenate(self.sizes)
        start, size = (np.cumsum(size) - size)[runs], size[runs]
        return _binary(_gathered(ids, start.ravel(), size.ravel()).view(np.uint8), 4 * np.concatenate([[0], np.cumsum(size.sum(axis=1))]))


class WordIds:
    """Ids of texts as little-endian uint32 bytes.

    For a vocabulary that cuts words as above each different word of some megabytes of text is encoded once: neither its normaliser nor its
    pre-tokeniser joins characters across ASCII white space, so a text's ids are those of its words one after another.
    Any other tokenizer file encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        if path not in _WORKER:
            tokenizer = Tokenizer.from_file(path)
            made = json.loads(tokenizer.to_str())
            model = made["model"]
            by_words = (made["normalizer"], made["pre_tokenizer"], made["truncation"], made["padding"]) == (_NORMALIZER, _PRE_TOKENIZER, None, None)
            by_words &= model["type"] == "BPE" and model["end_of_word_suffix"] == _WORD_END and not (model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"])
            by_words &= all(t["special"] and not t["normalized"] and not t["single_word"] and t["content"].startswith("<|") for t in made["added_tokens"])
            by_words &= all(chr(c) + end in model["vocab"] for c in [32, *_BYTE_LETTERS.values()] if c != 32 for end in ("", _WORD_END))
            last = np.zeros(tokenizer.get_vocab_size() + 1, dtype=bool)
            last[[i for t, i in model["vocab"].items() if t.endswith(_WORD_END)]] = True
            # the model alone: its words come normalised, in byte letters, between spaces
            bare = Tokenizer(tokenizer.model)
            if by_words:
                from tokenizers.pre_tokenizers import WhitespaceSplit

                bare.pre_tokenizer = WhitespaceSplit()
            _WORKER[path] = (tokenizer, bare, last, by_words)
        self.tokenizer, self.bare, self.last, self.by_words = _WORKER[path]

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in made]

    def _runs(self, pool: _Pool, runs: pa.Array) -> None:
        """Takes runs of letters or of points, each of them one word of the model, into the pool."""
        plain = pc.string_is_ascii(runs.cast(pa.large_string()))
        for some in (True, False):
            part = runs.filter(plain if some else pc.invert(plain))
            for i in range(0, len(part), TOGETHER):
                words = part.slice(i, TOGETHER).to_pylist()
                text = b" ".join(words)
                text = text.decode("ascii") if some else text.decode("latin-1").translate(_BYTE_LETTERS)
                ids = np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
                ends = np.flatnonzero(self.last[ids]) + 1  # a word's last id, and no other, ends a word
                if len(ends) != len(words):
                    raise ValueError("the vocabulary's words don't end as expected")
                pool.add(ids, np.diff(ends, prepend=0))

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of different words. Points at a word's end, after a letter or a digit, are a word of their own."""
        n, pool = len(words), _Pool()
        stems = pc.ascii_rtrim(words, _POINTS.decode())
        easy = pc.ascii_is_alpha(stems).to_numpy(zero_copy_only=False)
        data, ends = _parts(words)
        size, stem_size = np.diff(ends), np.diff(_parts(stems)[1])
        tail_from, tail_size = ends[:-1] + stem_size, np.where(easy, size - stem_size, 0)
        runs: list[bytes | None] = []  # of the words that aren't easy
        extra: list[bytes] = []  # parts that the whole tokenizer encodes
        hard = np.flatnonzero(~easy & (size > 0))
        raw = words.take(pa.array(hard)).cast(pa.large_binary()).to_pylist()
        for k, w in zip(hard.tolist(), raw, strict=True):
            stem = w.rstrip(_POINTS) if b"<|" not in w else w  # where a control string may be
            run = _letters(stem) if stem else w
            if run is None and len(stem) < len(w) and not stem[-1:].isalnum():
                stem = w
            if stem and len(stem) < len(w):
                tail_from[k], tail_size[k] = ends[k] + len(stem), len(w) - len(stem)
            runs.append(run)
            if run is None:
                extra.append(stem)
        tailed = np.flatnonzero(tail_size)
        tails = _binary(_gathered(data, tail_from[tailed], tail_size[tailed]), np.concatenate([[0], np.cumsum(tail_size[tailed])]))
        known = pa.array([r for r in runs if r is not None], pa.large_binary())
        first = pc.ascii_lower(stems.filter(pa.array(easy))).cast(pa.large_binary())
        coded = pa.concat_arrays([first, known, tails]).dictionary_encode()
        # the pool takes ASCII runs first
        plain = pc.string_is_ascii(coded.dictionary.cast(pa.large_string())).to_numpy(zero_copy_only=False)
        number = np.zeros(len(plain), np.int64)
        number[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(1, len(plain) + 1)
        self._runs(pool, coded.dictionary)
        found = number[coded.indices.to_numpy()]
        both = np.zeros((n, 2), np.int64)
        both[easy, 0] = found[: len(first)]
        is_run = np.array([r is not None for r in runs], dtype=bool)
        both[hard[is_run], 0] = found[len(first) : len(first) + len(known)]
        both[tailed, 1] = found[len(first) + len(known) :]
        if extra:
            made = [np.frombuffer(x, "<u4") for x in self._whole(extra)]
            both[hard[~is_run], 0] = pool.add(np.concatenate(made), np.array([len(x) for x in made])) + np.arange(len(made))
        return pool.words(both)

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(_plain(texts))
        coded = words.flatten().dictionary_encode()
        ids = self._words(coded.dictionary).take(coded.indices)
        raw, ends = _parts(ids)
        starts = words.offsets.to_numpy()
        at, raw = ends[starts - starts[0]].tolist(), memoryview(raw)
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of ``texts`` (string or large_string); null counts as empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        if not self.by_words:
            return self._whole(texts.cast(pa.large_binary()).to_pylist())
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + size[j] <= CHUNK):
                held += size[j]
                j += 1
            if held <= CHUNK:
                out += self._chunk(_from_zero(texts.slice(i, j - i)))
            else:
                out.append(b"".join(self._chunk(pa.array([x], pa.large_binary()).cast(pa.large_string()))[0] for x in _segments(texts[i].as_py().encode())))
            i = j
        return out


def _cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    step = 4 * capacity
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text): ids and END_ID, cut only beyond ``capacity``."""

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds(tokenizer), np.asarray([END_ID], dtype="<u4").tobytes()
        for lot in lots(batches):
            out: list[tuple] = []
            texts = lot.column(1).cast(pa.large_string()).combine_chunks()
            for name, ids in zip(lot.column(0).to_pylist(), coder.encode(texts), strict=True):
                out += [(name, *p) for p in _cut_pieces(ids + end, capacity)]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce_instance(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Martello and Toth's reduction. Takes the items it fixes out of ``count`` (by length) and returns them as patterns.

    For each length j from the longest, a set of at most three items with j is fixed if it dominates every
    other feasible set with j: j alone if nothing fits beside it; j and i, the longest that fits, if i fills the rest exactly,
    if no two others fit, or if no three fit and i is as long as the best pair; j and the best pair (a, b) if no three
    fit, a is that longest and at most one item lies strictly between b and a.
    """
    fixed: list[Pattern] = []
    for j in range(capacity, 0, -1):
        while count[j]:
            rest = capacity - j
            count[j] -= 1
            sizes = np.flatnonzero(count[: rest + 1])
            if not len(sizes):
                count[j] += 1
                fixed.append((((j, 1),), int(count[j])))
                count[j] = 0
                break
            i = int(sizes[-1])
            least: list[int] = []  # the three shortest that fit
            for s in sizes[:3]:
                least += [int(s)] * min(3, int(count[s]))
            two = len(least) > 1 and least[0] + least[1] <= rest
            three = len(least) > 2 and sum(least[:3]) <= rest
            best: tuple[int, ...] | None = None
            if i == rest or not two:
                best = (i,)
            elif not three:
                a, b = _best_pair(sizes, count, rest)
                if i >= a + b:
                    best = (i,)
                elif i == a and count[b + 1 : a].sum() <= 1:
                    best = (a, b)
            count[j] += 1
            if best is None:
                break
            items: dict[int, int] = {j: 1}
            for x in best:
                items[x] = items.get(x, 0) + 1
            times = min(int(count[x]) // n for x, n in items.items())
            for x, n in items.items():
                count[x] -= times * n
            fixed.append((tuple(sorted(items.items(), reverse=True)), times))
    return fixed


def _best_pair(sizes: np.ndarray, count: np.ndarray, rest: int) -> tuple[int, int]:
    best, pair = -1, (0, 0)
    lo, hi = 0, len(sizes) - 1
    while lo <= hi:
        a, b = int(sizes[hi]), int(sizes[lo])
        if a + b > rest:
            hi -= 1
        elif lo == hi and count[a] < 2:
            break
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
            lo += 1
    return pair


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of the items in ``count`` from the longest: each goes to the fullest sequence that it fits."""
    room: dict[int, list[list]] = {}  # free tokens -> [pattern, times]
    open_at = np.zeros(capacity + 1, dtype=bool)

    def put(free: int, items: tuple, times: int) -> None:
        if times:
            room.setdefault(free, []).append([items, times])
            open_at[free] = True

    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            fits = np.flatnonzero(open_at[size:])
            free = size + int(fits[0]) if len(fits) else capacity
            items, times = room[free].pop() if len(fits) else ((), left)
            if len(fits) and not room[free]:
                open_at[free] = False
            each = free // size
            full = min(times, left // each)
            put(free - each * size, (*items, (size, each)), full)
            left -= full * each
            if full < times and left:
                put(free - left * size, (*items, (size, left)), 1)
                full, left = full + 1, 0
            if items:
                put(free, items, times - full)
    return [(tuple(items), times) for rows in room.values() for items, times in rows]


class Places:
    """Where the pieces of each length go: by (length, rank) to (sequence, offset)."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows = []
        self.sequences = 0
        for items, times in patterns:
            offset = 0
            for size, each in items:
                rows.append((size, self.sequences, each, offset, times * each))
                offset += size * each
            self.sequences += times
        rows.sort()
        t = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.size, self.base, self.each, self.offset, n = t.T
        upto = np.cumsum(n) - n
        new = np.concatenate([[True], self.size[1:] != self.size[:-1]]) if len(t) else np.zeros(0, bool)
        self.first = upto - np.maximum.accumulate(np.where(new, upto, 0)) if len(t) else upto

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = np.int64(1) << 50
        at = np.searchsorted(self.size * span + self.first, length * span + rank, "right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    count = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        count[size] = n
    return [*reduce_instance(count, capacity), *best_fit(count, capacity)]


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` (doc_id, text) packed: a row for each piece, with its sequence_id and its offset there.

    Null text counts as empty: one piece, END_ID alone. Null doc_id: kept as null. Repeated rows are packed each.
    Pieces of one length are interchangeable, so ties don't matter. Other columns go. No rows: no rows.
    """
    rows = pieces(docs, tokenizer or default_tokenizer(), capacity)
    rows = Scratch(spark, "pack").keep(rows.withColumn("_sl_nth", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = Places(plan(histogram, capacity))
    groups = [(k, -(-n // RANK_ROWS)) for k, n in histogram.items()]
    groups = F.broadcast(spark.createDataFrame(groups, "length long, _sl_groups long"))
    rows = rows.join(groups, "length").withColumn("_sl_group", F.expr("pmod(_sl_nth, _sl_groups)")).drop("_sl_groups")
    before = rows.groupBy("length", "_sl_group").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("_sl_group").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_sl_group", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_sl_before"))
    inside = Window.partitionBy("length", "_sl_group").orderBy("_sl_nth")
    rows = rows.join(before, ["length", "_sl_group"]).withColumn("_sl_rank", F.row_number().over(inside) - 1 + F.col("_sl_before"))
    sent = spark.sparkContext.broadcast(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for b in batches:
            sequence, offset = places.find(b.column("length").to_numpy(), b.column("_sl_rank").to_numpy())
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_sl_rank").cast("long")).mapInArrow(run, f"{_PIECES}, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
