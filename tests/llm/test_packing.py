import collections
import random
import zlib

import numpy as np
import pyarrow as pa

from siteloom.llm import packing


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def check(rows, docs, capacity=2048):
    want = {}
    for (name, text), ids in zip(docs, brute_ids([t for _, t in docs]), strict=True):
        ids = [*ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.setdefault((name, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == {k: len(v) for k, v in want.items()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(by), -(-total // capacity)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(spark, docs).collect()
    used, least = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= least + 1


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y"), (4, "word " * 9000), (5, "é̈ ﬁ <|endoftext|>don't\x85İΣΣ  　x 12 <|startoftext|>\x1c#!"), (8, "J\u030c E\u0301 End. a,b, x.. don't. Don'S, 3.5. É. é, \u01f0 ΑΣ. <|ENDOFTEXT|>"), (9, "End. a,b, x.. don't. Don'S, 3.5. É. é, \u01f0 ΑΣ ǅ. ªº, Ⅷ ⅷ n°. " * 3), (6, "Z" * 70 + " " + "Z" * 70), (7, "İ. VELİ, x VELİ. क़. क़, a|> <|endoftext|>. <|endoftext|>, ＡＢ. 𝔸! K, Å. ǅ. ١٢. '.. a'. 3's! don't, a.'s")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, piece string")
    used, least = check(packing.pack(spark, frame).collect(), docs)
    assert used == least
    assert packing.pack(spark, frame.limit(0)).count() == 0


def test_every_code_point_before_points():
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(form.replace("_", chr(i)) for i in points[at : at + 400]) for at in range(0, len(points), 400) for form in ("_.", "b_!! x_")]
    # texts with combining marks aren't lowered as a whole; these code points go by themselves too
    texts += [f"{c}. A{c}, VELİ.{c}" for c in map(chr, [*range(0x300, 0x370), 0x130, 0x1E9E, 0x212A, 0x958])]
    coder = packing.WordIds(packing.default_tokenizer())
    assert coder.encode(pa.array(texts)) == [np.array(i, "<u4").tobytes() for i in brute_ids(texts)]


def test_mixed_texts():
    rng = random.Random(5)
    letters = "abcXYZ İıßσΣςéÉ\u0301\u030c'’.,!?-–—0123 \t\n\r\x0b\x0c\x85\u2028\u3000ªºⅧⅷǅКйЙк가각한क़ڤأﬁ🙂<|>_/\\\"()ſKÅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += [x + t for x in ("<|startoftext|>", "<|ENDOFTEXT|>", "'s 't don'T", "VELİ.", "x'd,", "a.'s") for t in texts[:200]]
    coder = packing.WordIds(packing.default_tokenizer())
    assert coder.by_words
    got = [i for at in range(0, len(texts), 500) for i in coder.encode(pa.array(texts[at : at + 500]))]
    assert got == [np.array(i, "<u4").tobytes() for i in brute_ids(texts)]


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    texts = ["word, " * 100, "x" * 200 + " y\n" + "z" * 70, "", "a  b\t\r\nc. " * 30, "short"]
    got = packing.WordIds(packing.default_tokenizer()).encode(pa.array([*texts, None], pa.large_string()))
    assert got == [np.array(i, "<u4").tobytes() for i in brute_ids([*texts, ""])]


def test_another_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    coder, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["Hello  World, don't!\n\n x\t", "", "VELİ. 3.5"]
    assert not coder.by_words
    assert coder.encode(pa.array(texts)) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plan_places_every_item():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([5, 12, 40])
        items = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 60)))
        patterns = packing.plan(items, capacity)
        got = collections.Counter()
        for parts, times in patterns:
            assert sum(a * n for a, n in parts) <= capacity
            for a, n in parts:
                got[a] += n * times
        assert got == items


def least_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        count = np.bincount(items, minlength=21)
        fixed = packing.reduce_instance(count, 20)
        rest = [i for i in range(20, 0, -1) for _ in range(count[i])]
        assert sum(n for _, n in fixed) + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)
