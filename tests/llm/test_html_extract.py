import html
import re

from siteloom.llm import html_extract as H


def plain(block):
    return " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", block)).split())


def test_field_on_pages_left_out():
    field = H.trained_field()
    wrong = total = 0
    for page, kept in H.labelled_pages(200, 77):
        feats, labels = H.labelled(page, kept)
        assert sum(labels) == len(kept)
        got = field.viterbi(field.scores(feats))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total, (wrong, total)


def test_table_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = H.op2_html_extract(spark, d).collect()
    assert len(got) == len(pages)
    right = 0
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        right += r["text"] == " ".join(b for b in map(plain, re.split(r"<(?:p|/p|h1|/h1|br)\b[^>]*>", body)) if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
    assert right == len(got)


def test_blocks():
    page = """<p>a&amp;b &lt;i&gt;<b>c</b>d<br>e<script>var x="</p><p>no";</script> f<!-- <p>no --> <p>second
      line<ul class='menu x-y'><li><a href="/">one</a><li>two</ul>1 < 2 &eacute;&#233; <div hidden>z</div><img alt="<p>"><p title="x>y">q</p><style>p{}"""
    got = H.leaf_blocks(page)
    assert [b.text for b in got] == ["a&b <i>cde f".replace("de", "d e"), "second line", "one", "two", "1 < 2 éé", "z", "q"]
    feats = H.features(got)
    assert {"in:ul", "in:li", "name:menu", "name:x", "name:y", "under:li"} <= set(feats[2]) and got[2].linked == 3
    assert all(len(f) == len(set(f)) for f in feats)
    assert "hidden" in feats[5] and "hidden" not in feats[6]
    assert [b.text for b in H.leaf_blocks('<p>x<p class="a')] == ["x"]


def test_viterbi_and_marginals_are_those_of_all_labellings():
    import itertools
    import math
    import random

    rng, field = random.Random(4), H.Field()
    for _ in range(30):
        field.move = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        field.start = rng.uniform(-1, 1)
        s = [rng.uniform(-3, 3) for _ in range(rng.randint(1, 6))]
        value = lambda y: y[0] * field.start + sum(a * b for a, b in zip(s, y, strict=True)) + sum(field.move[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
        every = list(itertools.product((0, 1), repeat=len(s)))
        assert tuple(field.viterbi(s)) == max(every, key=value)
        z = sum(math.exp(value(y)) for y in every)
        node, pair = field.marginals(s)
        for i in range(len(s)):
            assert abs(node[i] - sum(math.exp(value(y)) for y in every if y[i]) / z) < 1e-9
        for i in range(len(s) - 1):
            assert abs(pair[i][1][0] - sum(math.exp(value(y)) for y in every if y[i : i + 2] == (1, 0)) / z) < 1e-9


def test_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "just words here, and then some more of them. They go on for a while.", "x"), (1, "u", "<html><body><nav>a</nav>", "x")]
    got = H.extract_main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and [r["text"] for r in got[:2]] == ["", ""] and got[3]["n_chars"] == 0
    long = "<article>" + "<p>one two three four five six seven eight. </p>" * 5000 + "</article>"
    assert len(H.main_text(long, H.trained_field()).split()) == 40000
    assert H.extract_main_text(spark, spark.createDataFrame(rows[:0], "page_id long, url string, html string")).count() == 0


def test_scores_by_element_are_those_of_features():
    field = H.trained_field()
    for page, _ in [*H.labelled_pages(60, 5), ("<ul><li>a<li>b<ul><li>c</ul>d</x></ul><td>e<table><tr><td>f<td>g</tr></table>" * 3, [])]:
        blocks = H.leaf_blocks(page)
        for a, b in zip(field.block_scores(blocks), field.scores(H.features(blocks)), strict=True):
            assert abs(a - b) < 1e-9


def test_very_deep_pages(spark):
    n = 170_000
    deep = ["<div>x" * n, "<blockquote>" * n + "<li/>x" * n + "</em2>" * n + "</p>" * n, "<p class='a'><div id=b>" * n + "x"]
    out = H.extract_main_text(spark, spark.createDataFrame([(i, None, d) for i, d in enumerate(deep)], "page_id int, url string, html string"))
    assert dict(out.dtypes)["page_id"] == "bigint" and sorted(r["page_id"] for r in out.collect()) == [0, 1, 2]


def test_formulas_are_text():
    page = "<article><h1>On sums</h1><p>The value <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> is what we look for, as was said before.</p></article>"
    assert H.main_text(page, H.trained_field()) == "On sums The value x=2 is what we look for, as was said before."
