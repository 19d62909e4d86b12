import random

import pytest

from siteloom.llm import jaccard_join


def sets(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    s = [sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in range(len(rows)) if rows[i][0] is not None and s[i]]
    post = {}
    for i in ids:
        for t in s[i]:
            post.setdefault(t, []).append(i)
    for i in ids:
        shared = {}
        for t in s[i]:
            for j in post[t]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if den * n >= num * (len(s[i]) + len(s[j]) - n):
                up[top(i)] = top(j)
    low = {}
    for i in ids:
        low[top(i)] = min(low.get(top(i), rows[i][0]), rows[i][0])
    return sorted((-1 if d is None else d, len(s[i]), -1 if d is None else low[top(i)] if s[i] else d) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(jaccard_join.op7_jaccard_join(spark, "/root/testdata/sf0.01")) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("k,num,seed,often", [(3, 90, 1, 50_000), (5, 80, 2, 2), (2, 70, 3, 2)])
def test_chains_and_hot_groups(spark, k, num, seed, often, monkeypatch):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 5)
    monkeypatch.setattr(jaccard_join, "QUERIES", 4)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(8):
        words = [r.choice(vocabulary) for _ in range(r.choice([4, 30, 60, 120]))]
        for _ in range(r.choice([3, 12, 25])):
            if r.random() < 0.7:
                words = list(words)
                words[r.randrange(len(words))] = r.choice(vocabulary)  # a walk: links chain, and end
            rows.append((len(rows), " ".join(words)))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(1000 + i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 20)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One\ttwo"), (2005, "one"), (None, "one two"), rows[3], rows[3], (2006, "é É two")]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, grp string, n int")
    assert got(jaccard_join.jaccard_components(spark, frame, k, num, 100)) == brute(rows, k, num, 100)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(spark, frame).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 2, "x"), (1, "a b c d e f g", 1, "y"), (2, "a b c d e f g", 0, "z"), (None, "q", 1, "n"), (None, "q", 1, "m"), (None, None, 1, "n"), (3, "", 5, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, _sl_0 string")
    for _ in range(2):
        kept = jaccard_join.one_of_each(spark, docs.repartition(3))
        assert kept.columns == docs.columns
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[1], rows[4], rows[5], rows[6]]))
