import hashlib

import numpy as np
import pyarrow as pa

from siteloom.llm import minhash


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for (name, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 2
        yield name, text, text[: len(text) - k] + after[:k], after


def test_edited_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in minhash.fingerprint_edits(spark, docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(rows)
    errors = []
    for name, text, edited, after in expected(rows):
        r = got[name]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(sets(text), sets(edited)), r["near_next"] - jaccard(sets(text), sets(after))]
    assert np.abs(errors).mean() < 0.04 and np.abs(errors).max() < 0.25
    prints = {}
    for name, text in rows:
        assert prints.setdefault(text, got[name]["fingerprint"]) == got[name]["fingerprint"]


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, "one"), (3, "one"), (None, "last of all"), (2, "é" * 7), (1, "a b c d e f g " * 50)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    got = minhash.fingerprint_edits(spark, frame).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert by[2, 7]["edited_sha256"] == sha("é" * 4 + "a b")
    assert by[1, 700]["edited_sha256"] == sha("a b c d e f g " * 25 + "last of all")
    assert by[None, 11]["edited_sha256"] == sha("last o")
    one = minhash.fingerprint_edits(spark, frame.where("doc_id = 2")).collect()
    assert [r["edited_sha256"] for r in one] == [sha("é" * 7)]
    assert minhash.fingerprint_edits(spark, frame.limit(0)).count() == 0


def test_signature_is_near_jaccard():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(100, 500))
    s = minhash.signatures(pa.array([a, b, "", None, "A B", "a b"]))
    assert abs(minhash.likeness(s[:1], s[1:2])[0] - 296 / 496) < 0.15
    assert (s[2] == s[3]).all() and (s[4] == s[5]).all() and not (s[2] == s[4]).all()


def test_near_duplicates(spark):
    base = [" ".join(f"w{d}x{i}" for i in range(120)) for d in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, t + " tail") for i, t in enumerate(base[:3])] + [(20, base[0]), (21, ""), (22, None), (23, "")]
    rows += [(30, " ".join(base[4].split()[:90] + ["new"] * 30))]
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: i for i, _ in rows} | {10: 0, 11: 1, 12: 2, 20: 0}
    assert got == want


def test_groups_with_their_fingerprints(spark):
    base = [" ".join(f"w{d}x{i}" for i in range(120)) for d in range(4)]
    rows = [(1, base[0]), (2, base[1]), (3, base[0] + " tail"), (9, base[0]), (9, base[0]), (5, None), (6, ""), (None, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = minhash.group_sizes(minhash.near_duplicates(spark, docs))
    got = minhash.fingerprint_edits(spark, docs, groups).collect()
    assert sorted((r["doc_id"] or -1, r["group_id"], r["group_size"]) for r in got) == [(-1, None, 1), (1, 1, 3), (2, 2, 1), (3, 1, 3), (5, 5, 1), (6, 6, 1), (9, 1, 3), (9, 1, 3)]
    assert [r[:7] for r in got] == [r[:7] for r in minhash.fingerprint_edits(spark, docs).collect()]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], sets(r["text"] or "")) for r in docs.collect()]
    parent = {d: d for d, _ in rows}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and jaccard(x, y) >= 0.8:
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark, docs).collect()}
    assert got == {d: top(d) for d, _ in rows}
    seen = minhash.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["group_id"] for r in seen} == got
    assert any(r["group_size"] > 1 for r in seen)


def test_crowd_of_unlinked_texts(spark):
    """A crowd alike but mostly not linked, in which some pairs are: nearly all of them come together."""
    rng = np.random.default_rng(3)
    shared = [f"w{i}" for i in range(300)]
    texts = {}
    for d in range(600):
        own = [f"own{d}x{i}" for i in range(60)]
        texts[d] = shared + own
    for d in range(0, 600, 12):  # a linked partner
        texts[1000 + d] = texts[d][:-8] + [f"new{d}x{i}" for i in range(8)]
    rows = [(d, " ".join(t)) for d, t in texts.items()]
    rng.shuffle(rows)
    rows = [(int(d), str(t)) for d, t in rows]
    whole = {d: sets(t) for d, t in rows}
    pairs = [(d, 1000 + d) for d in range(0, 600, 12)]
    assert all(jaccard(whole[a], whole[b]) >= 0.8 for a, b in pairs) and jaccard(whole[1], whole[2]) < 0.8
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert sum(got[d] == d for d in range(600) if d % 12) >= 0.98 * 550


def test_linked_pair_among_unlinked_classes_of_its_bands(spark):
    shared = [f"w{i}" for i in range(340)]
    own = lambda d, n: [f"own{d}x{i}" for i in range(n)]
    rows = [(d, " ".join(shared + own(d, 80))) for d in range(70) if d not in (34, 35)]
    rows += [(d, " ".join(shared + own(d, 10))) for d in (34, 35)]
    whole = {d: sets(t) for d, t in rows}
    assert [(a, b) for a in whole for b in whole if a < b and jaccard(whole[a], whole[b]) >= 0.8] == [(34, 35)]
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 34 if d == 35 else d for d in whole}
