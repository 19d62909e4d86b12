"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the byte n-grams of the lower-cased text, with digits and ASCII punctuation as
spaces. For prediction embeddings and output weights are multiplied out into one table of
logits by bucket, so that a text's logits are a mean over its subwords; whole texts are read. With more languages than
dimensions the two are kept apart, so that the table does not grow with the languages. Training texts and their features lie
in files of the driver, so that its memory does not grow with the sample.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm import textvec
from siteloom.llm.common import Scratch, small_batches

#: Bounds of the training sample: rows of each language, characters of a training text; of a longer one a window at a place chosen by a hash.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000
BUCKETS, DIMENSION, ORDERS = 1 << 16, 16, (2, 3, 4)
EPOCHS, RATE = 6, 0.5
#: Rows of the sample that only fit the temperature: one in so many.
CALIBRATION = 4
#: A text is rejected if its calibrated score is lower: it is more likely wrong than right.
REJECT = 0.5
#: The language of a text without letters.
NONE = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray
    """By bucket and language, divided by the temperature; by bucket and dimension if there is ``out``."""
    bias: np.ndarray
    out: np.ndarray | None = None
    """By dimension and language."""

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its calibrated probability."""
        n, width = len(texts), self.logits.shape[1]
        scores, lettered = np.zeros((n, max(1, len(self.langs)))), np.zeros(n, dtype=bool)
        for at, raw, offsets in textvec.chunks(pc.utf8_lower(texts), max(1 << 14, (1 << 20) // width)):
            ids, bounds = subwords(raw, offsets)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            if len(some) and self.langs:
                mean = np.add.reduceat(self.logits[ids], bounds[some], axis=0) / size[some, None]
                scores[at + some] = mean if self.out is None else mean @ self.out
            ascii_letter, other = ((raw >= 97) & (raw <= 122)), raw >= 128
            for mark, sure in ((ascii_letter, True), (other, False)):
                upto = np.concatenate([[0], np.cumsum(mark)])
                for i in np.flatnonzero((upto[offsets[1:]] > upto[offsets[:-1]]) & ~lettered[at : at + len(size)]):
                    lettered[at + i] = sure or _LETTER.search(bytes(raw[offsets[i] : offsets[i + 1]]).decode()) is not None
        if not self.langs:
            return [NONE] * n, np.zeros(n)
        p = softmax(scores + self.bias)
        best = p.argmax(axis=1)
        return [self.langs[b] if ok else NONE for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, text by text, and where each text's begin. A space is put around each text."""
    n = np.diff(offsets)
    padded = offsets[:-1] + 2 * np.arange(len(n))
    text = np.full(len(raw) + 2 * len(n), 32, dtype=np.uint8)
    text[np.arange(len(raw)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = _PLAIN[raw]
    gram, parts, counts = text.astype(np.uint32), [], []
    have = n + 2
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint32(257) + text[order - 1 :]  # exact up to four bytes, but for the top ones' carry
        if order not in ORDERS:
            continue
        size = np.maximum(have - order + 1, 0)
        owner = np.repeat(np.arange(len(n)), size)
        where = np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + padded[owner]
        h = (gram[where] + np.uint32(order * 0x51ED27)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        parts.append(h >> np.uint32(16))
        counts.append(size)
    total = np.sum(counts, axis=0)
    bounds = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(bounds[-1], dtype=np.uint32)
    done = np.zeros(len(n), dtype=np.int64)
    for part, size in zip(parts, counts, strict=True):
        owner = np.repeat(np.arange(len(n)), size)
        out[np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + (bounds[:-1] + done)[owner]] = part
        done += size
    return out, bounds


class _Spool:
    """Byte strings in a temporary file, appended and read by number; only their places are in memory."""

    def __init__(self) -> None:
        self._file, self._ends = tempfile.TemporaryFile(), [0]

    def append(self, item: bytes) -> None:
        self._file.seek(self._ends[-1])
        self._file.write(item)
        self._ends.append(self._ends[-1] + len(item))

    def __len__(self) -> int:
        return len(self._ends) - 1

    def __getitem__(self, i: int) -> bytes:
        self._file.seek(self._ends[i])
        return self._file.read(self._ends[i + 1] - self._ends[i])


class _Texts(_Spool):
    def append(self, text: str) -> None:
        super().append(text.encode())

    def __getitem__(self, i: int) -> str:
        if i >= len(self):
            raise IndexError(i)
        return super().__getitem__(i).decode()


class _Features(_Spool):
    """Buckets of texts with their weights."""

    def extend(self, texts: Iterable[str]) -> None:
        held: list[str] = []
        for t in texts:
            held.append(t)
            if len(held) == 64:
                self._add(held)
                held = []
        self._add(held)

    def _add(self, texts: list[str]) -> None:
        for _, raw, offsets in textvec.chunks(pc.utf8_lower(pa.array(texts, pa.large_string()))):
            ids, bounds = subwords(raw, offsets)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                found, n = np.unique(ids[a:b], return_counts=True)
                self.append(found.tobytes() + (n / max(1, b - a)).astype(np.float32).tobytes())

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        raw = super().__getitem__(i)
        return np.frombuffer(raw, np.uint32, len(raw) // 8), np.frombuffer(raw, np.float32, offset=len(raw) // 2)


def fit(texts: Sequence[str], labels: list[str], seed: int = 7) -> Model:
    """Fits embeddings and softmax to whole texts and to short parts of them, then the temperature to rows left out."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(langs)}
    y = np.array([number[x] for x in labels])
    kept = np.arange(len(y)) % CALIBRATION != 0 if len(y) >= 20 * CALIBRATION else np.ones(len(y), bool)
    data, parts, part_y = _Features(), _Texts(), []
    data.extend(t for t, k in zip(texts, kept, strict=True) if k)
    for t, label in zip(texts, y, strict=True):
        w = t.split()
        if len(w) > 4:
            size = int(rng.integers(2, 12))
            at = int(rng.integers(0, max(1, len(w) - size)))
            parts.append(" ".join(w[at : at + size]))
            part_y.append(label)
    part_kept = rng.random(len(parts)) < 1 - 1 / CALIBRATION
    data.extend(t for t, k in zip(parts, part_kept, strict=True) if k)
    data_y = np.concatenate([y[kept], np.array(part_y, dtype=y.dtype)[part_kept]])
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    out, bias = np.zeros((DIMENSION, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, step = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            (ids, weight), label = data[i], data_y[i]
            rate, step = RATE * (1 - step / steps), step + 1
            x = weight @ table[ids]
            wrong = softmax(x @ out + bias)
            wrong[label] -= 1
            back = out @ wrong
            out -= rate * np.outer(x, wrong)
            bias -= rate * wrong
            # a bucket's step is its weight times the gradient, scaled up as weights are small in long texts
            table[ids] -= (4 * rate * weight / max(float(weight @ weight), 1e-3))[:, None] * back * np.float32(0.25)
    held, truth = _Features(), y[~kept]
    held.extend(t for t, k in zip(texts, kept, strict=True) if not k)
    if not len(held):
        held, truth = data, data_y
    z = np.array([(weight @ table[ids]) @ out + bias for ids, weight in map(held.__getitem__, range(len(held)))])
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.25, 20, 60):
        loss = -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    if len(langs) > DIMENSION:
        return Model(langs, table, bias / temperature, (out / temperature).astype(np.float32))
    return Model(langs, (table @ out / temperature).astype(np.float32), bias / temperature)


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of doc_id as text leaves 0 by 5; a null doc_id isn't held out, nor is it learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learns from (doc_id, text, lang) a sample in a fixed random order, equal in its languages, of which each has all its rows if they are few.

    The sample is sorted by Spark and comes to the driver a partition at a time.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).where(F.rlike("text", F.lit(r"\p{L}")))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return fit([], [])
    shares = docs.sparkSession.createDataFrame([(r["lang"], SAMPLE_ROWS / r["count"]) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    start = 1 + F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    window = F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS))
    picked = known.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", window.alias("text"), draw.alias("draw"), "doc_id")
    texts, labels, n = _Texts(), [], dict.fromkeys((r["lang"] for r in counts), 0)
    with Scratch(docs.sparkSession, "langid") as scratch:
        for r in scratch.cut(picked, "sample").orderBy("draw", "doc_id", "lang", "text").toLocalIterator():
            n[r["lang"]] += 1
            if n[r["lang"]] <= 2 * SAMPLE_ROWS:  # more only if rows share a doc_id
                texts.append(r["text"])
                labels.append(r["lang"])
    return fit(texts, labels)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with lang_pred, score and rejected, which replace columns of those names.

    Null text, or one without letters: ``und``, score 0, rejected. Null lang: predicted, not learned from. Empty tables: no
    rows. No labelled rows: all ``und``. Repeated rows are predicted alike. Other columns pass through.
    """
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or train(docs))
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.predict(b.column(at))
            no = np.array([x == NONE for x in lang], dtype=bool) | (score < REJECT)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(no)], [*b.schema.names, "lang_pred", "score", "rejected"])

    added = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def accepted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without those that identification rejects, in their own columns."""
    names = [f"_sl_{i}" for i in range(len(docs.columns))]
    fixed = {"doc_id": "doc_id", "text": "text", "lang": "lang"}
    inner = docs.toDF(*(fixed.get(c, n) for c, n in zip(docs.columns, names, strict=True)))
    return identify(spark, inner).where("not rejected").drop("lang_pred", "score", "rejected").toDF(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(spark, docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
