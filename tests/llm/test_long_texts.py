"""One text of a few megabytes among short and missing ones goes through every operator whole."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siteloom.llm import chat, html_extract, jaccard_join, langid, licenses, line_dedup, minhash, mixing, packing

WORDS = 400_000
LONG = " ".join(f"word{i % 9973} the\n" if i % 7 == 0 else f"w{i}" for i in range(WORDS))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a", len(LONG)), (2, "short one", "en", "a", 9), (3, None, None, None, None), (4, LONG + " more", "en", "b", len(LONG) + 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_document_operators(spark, docs):
    n = len(LONG.split())
    lines = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark, docs, True).collect()}
    assert lines[1]["n_lines"] == LONG.count("\n") + 1 and lines[4]["text"].endswith(" more") and lines[3]["text"] is None
    prints = {r["doc_id"]: r for r in minhash.fingerprint_edits(spark, docs).collect()}
    half = len(LONG) // 2
    assert prints[1]["edited_sha256"] == hashlib.sha256((LONG[: len(LONG) - half] + (LONG + " more")[:half]).encode()).hexdigest()
    pieces = packing.pack(spark, docs).where("doc_id = 1").collect()
    assert len(pieces) > n // 2048 and {r["length"] for r in pieces[:-1]} >= {2048}
    found = licenses.scan_licenses(spark, docs).collect()
    assert len(found) == 4
    taken = {r["doc_id"]: r for r in mixing.mix(spark, docs).collect()}
    assert taken[1]["size"] == n and taken[3]["size"] == 0
    groups = {r["doc_id"]: r for r in jaccard_join.jaccard_components(spark, docs).collect()}
    assert groups[4]["component_id"] == 1 and groups[2]["component_id"] == 2 and groups[3]["n_shingles"] == 0
    lang = {r["doc_id"]: r for r in langid.identify(spark, docs).collect()}
    assert lang[1]["lang_pred"] == "en" and lang[3]["lang_pred"] == "und"


def test_pages_and_chats(spark):
    page = "<body><nav><a href='/'>menu</a></nav><article>" + "".join(f"<p>This is paragraph number {i}, of several words. </p>" for i in range(20_000)) + "</article>"
    out = html_extract.extract_main_text(spark, spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert out["text"].count("paragraph") == 20_000 and "menu" not in out["text"]
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "</s>")], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns).select(chat.read_turns(F.col("text")).alias("t")).first()
    assert [tuple(x) for x in made["t"]] == [("user", LONG), ("assistant", LONG + "</s>")]
