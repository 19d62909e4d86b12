import collections

import corpus_pipeline
from siteloom.llm import langid
from tests.llm import test_jaccard_join, test_native, test_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns

    before, after = out["language_id"]
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    lang, score = model.predict(pa.array([r["text"] for r in before]))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, x, s in zip(before, lang, score, strict=True) if x != "und" and s >= langid.REJECT)
    assert len(after) >= 0.97 * len(before)

    before, after = out["line_dedup"]
    want = test_native.brute_lines([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for (d, _), t in want.items()}
    was = {r["doc_id"]: r for r in before}
    assert all(r["n_chars"] == (was[r["doc_id"]]["n_chars"] if r["text"] == was[r["doc_id"]]["text"] else len(r["text"])) for r in after)

    before, after = out["jaccard_dedup"]
    groups = test_jaccard_join.brute([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, c in groups if d == c)

    before, after = out["mixing"]
    words = lambda rows: collections.Counter({s: sum(len(r["text"].split()) for r in rows if r["source"] == s) for s in {r["source"] for r in before}})
    size, taken = words(before), words(after)
    sources = sorted(size)
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    capped: set[str] = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        level = left / sum(weight[s] for s in sources if s not in capped)
        new = {s for s in sources if s not in capped and level * weight[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    for s in sources:
        assert abs(taken[s] - (3 * size[s] if s in capped else level * weight[s])) <= 1, s

    before, after = out["packing"]
    used, least = test_packing.check(after, [(r["doc_id"], r["text"]) for r in before])
    assert used <= least + 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100
