import zlib

import pyarrow as pa
import pytest

from siteloom.llm import langid


@pytest.fixture(scope="module")
def out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return langid.op9_language_id(spark, d).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()


def test_held_out_accuracy(out):
    assert len(out) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    right = sum(r["lang"] == r["lang_pred"] for r in held)
    wrong = [(r["doc_id"], r["lang"], r["lang_pred"], round(r["score"], 2), r["n_chars"]) for r in held if r["lang"] != r["lang_pred"]]
    assert right >= 0.97 * len(held), wrong
    assert sum(r["rejected"] for r in out) <= 0.02 * len(out), [r for r in out if r["rejected"]]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edges(spark):
    rows = [(1, "the cat and the dog are in the house", "en", "x"), (2, "le chat et le chien sont dans la maison", "fr", "x"), (3, None, "en", "x"), (4, "", None, None), (5, "123 !?", "fr", "x"), (None, "der Hund und die Katze", None, "x"), (7, "日本語", None, "x"), (8, "١٢", None, "x")]
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, score string")
    got = langid.identify(spark, frame).collect()
    assert len(got) == 16
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4 and all(by[i]["rejected"] for i in (3, 4, 5))
    assert by[7]["lang_pred"] in ("en", "fr") and by[None]["lang_pred"] in ("en", "fr")
    assert langid.identify(spark, frame.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark, frame.withColumn("lang", frame.lang.substr(9, 1)).where("false")).collect()} == set()


def test_subwords_stay_in_their_text():
    from siteloom.llm import textvec

    texts = ["ab", "", "xyz w", "é"]
    whole = [list(langid.subwords(raw, o)[0]) for _, raw, o in textvec.chunks(pa.array(texts))][0]
    alone = [x for t in texts for _, raw, o in textvec.chunks(pa.array([t])) for x in langid.subwords(raw, o)[0]]
    assert whole == alone


def test_every_language_is_learned(spark):
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 120 * 20)]
    rows = []
    for lang in range(120):
        own = alphabet[lang * 20 : lang * 20 + 20]
        rows += [(lang * 10 + i, " ".join("".join(own[(i + j + k) % 20] for k in range(3)) for j in range(12)), f"l{lang:03}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 120
    got = model.predict(pa.array([r[1] for r in rows]))[0]
    assert sum(a == r[2] for a, r in zip(got, rows, strict=True)) >= 0.95 * len(rows)


def test_sample_and_limit_are_whole(monkeypatch, spark):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.update(texts=list(texts), labels=labels))
    long = "the cat " * 2000
    langid.train(spark.createDataFrame([(i, long, "en") for i in range(1000)], "doc_id long, text string, lang string"))
    assert len(seen["texts"]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000)) and set(seen["texts"]) == {long}
    assert langid.REJECT == 0.5


def plain_prediction(model, text):
    """The rule, text by text and subword by subword."""
    import math
    import unicodedata

    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und", 0.0
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
    total, n = [0.0] * model.logits.shape[1], 0
    for order in langid.ORDERS:
        for i in range(len(raw) - order + 1):
            gram = 0
            for b in raw[i : i + order]:
                gram = (gram * 257 + b) % (1 << 32)
            h = (gram + order * 0x51ED27) * 0x9E3779B1 % (1 << 32)
            h ^= h >> 15
            h = h * 0x85EBCA77 % (1 << 32) >> 16
            n += 1
            for k, x in enumerate(model.logits[h]):
                total[k] += float(x)
    z = [x / n for x in total]
    if model.out is not None:
        z = [sum(a * float(w) for a, w in zip(z, column, strict=True)) for column in model.out.T]
    z = [a + float(b) for a, b in zip(z, model.bias, strict=True)]
    e = [math.exp(a - max(z)) for a in z]
    best = max(range(len(e)), key=e.__getitem__)
    return model.langs[best], e[best] / sum(e)


def test_predictions_are_those_of_the_plain_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(spark, docs, model).collect()
    assert len(rows) == docs.count()
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:150]:
        lang, score = plain_prediction(model, r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, r["doc_id"]
        assert r["rejected"] == (lang == "und" or r["score"] < langid.REJECT)


def test_accepted_with_clashing_columns(spark):
    rows = [(1, "the cat and the dog are in the house", "en", "a", 1.0, "q"), (2, None, "en", "b", 2.0, "r"), (6, "the house and the cat", "en", "c", 3.0, "s")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, _sl_0 string, score double, rejected string")
    got = langid.accepted(spark, docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows * 3 if r[1])


def test_long_texts_are_learned_from_anywhere(monkeypatch, spark):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.update(texts=list(texts)))
    long = "".join(f"{i:06}x" for i in range(30_000))
    langid.train(spark.createDataFrame([(i, long, "en") for i in range(60)], "doc_id long, text string, lang string"))
    assert {len(t) for t in seen["texts"]} == {langid.SAMPLE_CHARS}
    assert len({t[:50] for t in seen["texts"]}) > 30 and any(long.index(t) > len(long) // 2 for t in seen["texts"])
