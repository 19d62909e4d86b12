"""Known answers from small inputs, and properties that hold for any input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.functions import special
from siteloom.functions.expression import compile_filter
from siteloom.operators import filters as FL
from siteloom.operators import joins as J
from siteloom.operators import models as M
from siteloom.operators import normalize as N
from siteloom.operators import registry
from siteloom.operators import rewrite as R
from siteloom.operators import stats as S
from siteloom.operators import tags as T
from siteloom.operators import windows as W
from siteloom.operators.intervals import overlaps
from siteloom.plans.relations import genotypes, second_input, sites

SF = "/root/testdata/sf0.001"
SITE = "site_id long, chrom string, contig_rank int, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, dp int, end long"


def frame(spark, rows):
    full = [(i, c, int(c[-1]), p, name, r, a.split(",") if a != "." else [], q, f, dp, None) for i, (c, p, name, r, a, q, f, dp) in enumerate(rows)]
    return spark.createDataFrame(full, SITE)


@pytest.fixture(scope="module")
def basic(spark):
    return frame(spark, [("1", 100, "rs1", "A", "G", 100.0, ["PASS"], 5), ("1", 200, None, "T", "A", 100.0, ["PASS"], 5), ("1", 300, None, "A", "AT", 100.0, ["PASS"], 5), ("1", 400, None, "C", "T,G", 100.0, ["PASS"], 5), ("1", 500, None, "A", ".", 100.0, ["PASS"], 5)]).cache()


def test_summary_of_the_basic_input(basic):
    s = S.summary(basic).first()
    assert (s["records"], s["no_alts"], s["snps"], s["indels"], s["multiallelic"], s["multiallelic_snps"]) == (5, 1, 3, 1, 1, 1)
    t = S.tstv(basic).first()
    assert (t["ts"], t["tv"]) == (2, 2)
    st = {r["type"]: r["n"] for r in S.substitutions(basic).collect()}
    assert len(st) == 12 and st["A>C"] == 0 and st["A>G"] == 1


def test_intersection_inputs(spark):
    rows = lambda *x: frame(spark, [("1", p, n, r, a, None, [], d) for p, n, r, a, d in x])
    a = rows((10, None, "A", "C", 5), (20, "id2", "G", "GA", 8), (30, None, "T", "G", 2))
    b = rows((10, None, "A", "C", 7), (20, "id2", "G", "GT", 9), (40, None, "C", "A", 4))
    c = rows((10, None, "A", "C", 6), (30, None, "T", "G", 3))
    at = lambda g: sorted(r["pos"] for r in g.collect())
    g = J.groups([a, b, c])
    assert at(J.in_exactly(g, 3)) == [10] and at(J.in_at_least(g, 2)) == [10, 30] and at(J.with_mask(g, "010")) == [20, 40]
    assert at(J.in_exactly(J.groups([a, b], "any"), 2)) == [10, 20] and at(J.in_exactly(J.groups([a, b], "indels"), 2)) == [10, 20] and at(J.in_exactly(J.groups([a, b], "id"), 2)) == [10, 20]
    assert at(J.only_first(a, [b, c])) == [20]
    p = J.pairwise(a, b).first()
    assert (p["both"], p["left_only"], p["right_only"]) == (1, 2, 2)
    m = {r["pos"]: r for r in J.merge_exact([a, b]).collect() if r["alt"] == "C"}
    assert m[10]["dp"] == 12 and m[10]["n_inputs"] == 2


def test_merge_of_alleles(spark):
    rows = lambda *x: frame(spark, [("1", p, None, r, a, None, [], 1) for p, r, a in x])
    m = J.merge_alleles([rows((5, "A", "C"), (9, "A", "T")), rows((5, "AT", "A,<DEL>"), (9, "G", "C"))]).orderBy("pos", "ref").collect()
    assert (m[0]["ref"], m[0]["alts"]) == ("AT", ["CT", "A", "<DEL>"])
    assert [list(x["map"]) for x in m[0]["maps"]] == [[0, 1], [0, 2, 3]]
    assert [(x["ref"], x["alts"]) for x in m[1:]] == [("A", ["T"]), ("G", ["C"])]


def test_sort_and_concat(spark):
    d = frame(spark, [("2", 25, None, "A", "T", None, [], 0), ("1", 20, None, "C", "T", None, [], 0), ("1", 10, None, "A", "G", None, [], 0), ("1", 10, None, "A", "C", None, [], 0), ("2", 15, None, "T", "A", None, [], 0)])
    got = [(r["chrom"], r["pos"], r["alts"][0]) for r in J.sort_sites(d).collect()]
    assert got == [("1", 10, "C"), ("1", 10, "G"), ("1", 20, "T"), ("2", 15, "A"), ("2", 25, "T")]
    assert J.concat([d, d]).count() == 10 and J.concat([d, d], "exact").count() == 5 and J.concat([d, d], "all").count() == 4 and J.concat([d, d], "snps").count() == 4


def test_metamorphic(spark):
    s, g = sites(spark, SF).cache(), genotypes(spark, SF).cache()
    p = compile_filter('QUAL>200 & TYPE="snp" | DP<9')
    assert s.where(p).count() + s.where(~p).count() == s.count()
    b = second_input(spark, SF)
    both = J.write_input(J.in_exactly(J.groups([s, b]), 2), [s, b], 0).count()
    twice = s.count() - J.groups([s]).count()
    assert abs(both + J.only_first(s, [b]).count() - s.count()) <= twice
    one = R.split_multiallelic(s)
    assert one.count() == s.select(F.sum(F.greatest(F.size("alts"), F.lit(1)))).first()[0]
    trimmed, tg = R.trim_unused_alts(s, g)
    assert tg.where(F.exists("alleles", lambda a: a < 0)).count() == 0
    again, _ = R.trim_unused_alts(trimmed.drop("an", "ac"), tg)
    assert again.select("site_id", "alts").exceptAll(trimmed.select("site_id", "alts")).count() == 0
    assert J.sort_sites(J.sort_sites(s)).collect() == J.sort_sites(s).collect()
    t = T.fill_tags(g).agg(F.sum("ac"), F.sum(F.col("ac_het") + F.col("ac_hom") + F.col("ac_hemi"))).first()
    assert t[0] == t[1]


def test_interval_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(i, f"c{rng.integers(3)}", int(p), int(p + rng.integers(0, 60000))) for i, p in enumerate(rng.integers(1, 300000, 150))]
    b = [(f"c{rng.integers(3)}", int(p), int(p + rng.choice([5, 20000, 3_000_000])), int(i)) for i, p in enumerate(rng.integers(1, 300000, 80))] + [("c1", None, 5000, 90), ("c2", 290000, None, 91)]
    left, right = spark.createDataFrame(a, "site_id long, chrom string, s long, e long"), spark.createDataFrame(b, "chrom string, start long, end long, name long")
    want = sorted((i, n) for i, c, s, e in a for d, x, y, n in b if c == d and s <= (y or 1 << 40) and (x or 1) <= e)
    got = overlaps(left, right, F.col("s"), F.col("e"))
    assert sorted((r["site_id"], r["name"]) for r in got.collect()) == want
    hit = {i for i, _ in want}
    assert {r[0] for r in overlaps(left, right, F.col("s"), F.col("e"), how="left_semi").select("site_id").collect()} == hit
    assert {r[0] for r in overlaps(left, right, F.col("s"), F.col("e"), how="left_anti").select("site_id").collect()} == set(range(150)) - hit


def test_windows_over_segments_are_as_over_contigs(spark, monkeypatch):
    s = sites(spark, SF).cache()
    distance = lambda: sorted(tuple(r) for r in W.variant_distance(s).select("site_id", "dist_back", "dist_fwd").collect())
    cluster = lambda: sorted(tuple(r) for r in W.cluster_size(s, 500).select("site_id", "n_cluster").collect())
    isles = lambda: sorted(tuple(r) for r in W.overlapping(s, F.col("pos") + 40).select("site_id", "overlaps").collect())
    chunks = lambda: sorted(tuple(r) for r in W.scatter(s, 100).select("site_id", "chunk").collect())
    whole = distance(), cluster(), isles(), chunks()
    monkeypatch.setattr(W, "SEGMENT", 777)
    assert (distance(), cluster(), isles(), chunks()) == whole


def test_set_genotypes(spark):
    g = spark.createDataFrame([(1, "A", [0, 1], False), (1, "B", [None, None], False), (1, "C", [1, None], True), (1, "D", [1, 1], False)], "site_id long, sample string, alleles array<int>, phased boolean")
    got = lambda t, n: {r["sample"]: (r["alleles"], r["phased"]) for r in R.set_genotypes(g, t, n).collect()}
    assert got(".", "0") == {"A": ([0, 1], False), "B": ([0, 0], False), "C": ([0, 0], True), "D": ([1, 1], False)}
    assert got("./.", "M")["B"][0] == [1, 1] and got("./x", ".")["C"][0] == [None, None] and got("a", "p")["A"] == ([0, 1], True)
    assert got("a", "m")["D"][0] == [0, 0] and got("a", "c:0|1")["B"] == ([0, 1], True) and got("a", "i")["A"][0] == [1, 0]
    assert {r["sample"]: r["alleles"] for r in R.missing_to_ref(g, major=True).collect()}["C"] == [1, 1]
    fixed = {r["sample"]: r["alleles"] for r in R.fix_ploidy(g, F.when(F.col("sample") == "A", 1).when(F.col("sample") == "B", 0).otherwise(3)).collect()}
    assert fixed == {"A": [0], "B": [None], "C": [1, None, None], "D": [1, 1, 1]}


def test_vectors_by_number(spark):
    d = spark.createDataFrame([([10, 20, 30, 40, 50, 60], [1, 2, 3], [7, 8], [0, 2])], "g array<int>, r array<int>, a array<int>, kept array<int>")
    got = d.select(R.pick_by_number(F.col("a"), F.col("kept"), "A"), R.pick_by_number(F.col("r"), F.col("kept"), "R"), R.pick_by_number(F.col("g"), F.col("kept"), "G")).first()
    assert list(got) == [[8], [1, 3], [10, 40, 60]]
    full = spark.range(1).select(N.localized_to_full(F.array(F.lit(5), F.lit(6)), F.array(F.lit(2)), F.lit(3)), N.localized_to_full(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2)), F.lit(3), "G")).first()
    assert list(full) == [[5, None, 6], [1, None, None, 2, None, 3]]


def test_tags_from_tags(spark):
    d = spark.createDataFrame([([-0.05, -1.0, -10.0], [0.1, 0.7, 0.2], [0.2, 0.8])], "gl array<double>, gp array<double>, hap array<double>")
    r = d.select(R.gl_to_pl(F.col("gl")), R.gl_to_gp(F.col("gl")), R.gp_to_gt(F.col("gp"), 0.4), R.gp_to_gt(F.col("gp"), 0.1), R.gp_to_gt(F.col("hap"), 0.4), T.dosage_from_likelihoods(F.array(F.lit(0), F.lit(0), F.lit(300)))).first()
    assert r[0] == [1, 10, 100] and sum(r[1]) == pytest.approx(1) and r[2] == [0, 1] and r[3] == [None, None] and r[4] == [1] and r[5] == pytest.approx(0.5)


def test_gap_filters(spark):
    d = frame(spark, [("1", 100, None, "A", "C", None, ["PASS"], 0), ("1", 103, None, "A", "AT", 5.0, ["PASS"], 0), ("1", 108, None, "G", "T", None, ["PASS"], 0), ("1", 110, None, "GA", "G", 9.0, ["PASS"], 0), ("1", 300, None, "G", "T", None, ["PASS"], 0)])
    assert [r["pos"] for r in FL.has_filter(FL.snp_gap(d, 3), "SnpGap").orderBy("pos").collect()] == [100, 108]
    assert [r["pos"] for r in FL.has_filter(FL.indel_gap(d, 10), "IndelGap").collect()] == [103]


def test_left_alignment(spark):
    assert N.left_align(5, "AA", "A", "GCAA") == (2, "CA", "C")
    assert N.left_align(5, "A", "AT", "CCC") == (5, "A", "AT") and N.left_align(5, "A", "C", "GG") == (5, "A", "C") and N.left_align(3, "GCACA", "GCA", "TT") == (3, "GCA", "G")
    ref = spark.createDataFrame([("1", 1, "GCAAAAT")], "chrom string, chunk_start long, bases string")
    d = frame(spark, [("1", 5, None, "AA", "A", None, [], 0), ("1", 3, None, "A", "T", None, [], 0)])
    assert sorted((r["pos"], r["ref"], r["alts"]) for r in N.left_align_sites(d, ref).collect()) == [(2, "CA", ["C"]), (3, "A", ["T"])]
    filled = N.fill_from_reference(d.withColumn("ref", F.lit("N")), ref)
    assert sorted((r["pos"], r["ref"]) for r in filled.collect()) == [(3, "A"), (5, "A")]


def test_atoms_and_duplicates(spark):
    assert M.allele_atoms("ACG", "ATT") == [(1, "C", "T"), (2, "G", "T")] and M.allele_atoms("A", "ATT") == [(0, "A", "ATT")]
    d = frame(spark, [("1", 5, None, "A", "C,AT", None, [], 0), ("1", 5, None, "A", "G", None, [], 0), ("1", 5, None, "A", "<DEL>", None, [], 0), ("1", 6, None, "A", "C", None, [], 0)])
    assert sorted(r["site_id"] for r in N.rmdup_any_key(d).collect()) == [0, 2, 3]
    assert N.atomize(d).count() == 5


def test_trios(spark):
    rows = [(1, "C", [0, 1]), (1, "F", [0, 0]), (1, "M", [1, 1]), (2, "C", [1, 1]), (2, "F", [0, 0]), (2, "M", [1, 1]), (3, "C", [0, None]), (3, "F", [0, 0]), (3, "M", [0, 0]), (4, "C", [0, 0]), (4, "F", [0, 0]), (4, "M", [0, 0])]
    g = spark.createDataFrame(rows, "site_id long, sample string, alleles array<int>")
    t = J.trio_rows(g, [("C", "F", "M")])
    assert {r["site_id"]: r["state"] for r in J.mendel(t).collect()} == {1: "good_alt", 2: "err", 3: "miss", 4: "good"}
    assert [r["site_id"] for r in J.de_novo_naive(t).collect()] == [2]


def test_de_novo_posterior():
    sure, no = [0, 300, 3000], [300, 0, 300]
    p = M.de_novo_probability(np.array([[no, sure, sure], [no, no, sure], [sure, sure, sure]], float))
    assert p[0] > 0.99 and p[1] < 1e-3 and p[2] < 1e-3


def test_prune_and_overlaps(spark):
    d = frame(spark, [("1", p, None, "ACGT", "A", q, ["PASS"], 0) for p, q in [(1, 5.0), (3, 9.0), (5, 1.0), (50, 1.0), (52, 2.0), (90, 1.0)]])
    assert sorted(r["pos"] for r in M.prune(d, 10, 1).collect()) == [1, 50, 90]
    assert sorted(r["pos"] for r in M.prune(d, 10, 1, "maxqual").collect()) == [3, 52, 90]
    kept = {r["site_id"] for r in J.overlap_min_qual(d).collect()}
    assert kept == {1, 4, 5}


def test_special_functions():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and special.gamma_p(2.5, 1.3) + special.gamma_q(2.5, 1.3) == pytest.approx(1)
    assert special.golden_minimum(lambda x: (x - 0.3) ** 2, 0, 1) == pytest.approx(0.3, abs=1e-6)
    assert special.pattern_search(lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2, np.zeros(2)) == pytest.approx([1, -2], abs=1e-5)
    lik = np.eye(3)[[0, 0, 1, 2]] + 1e-9
    assert special.allele_frequency_em(lik) == pytest.approx(3 / 8, abs=1e-3)
    chain = special.Chain([[0.95, 0.05], [0.05, 0.95]])
    emit = np.array([[0.9, 0.1]] * 5 + [[0.4, 0.6]] + [[0.9, 0.1]] * 3 + [[0.1, 0.9]] * 6)
    assert list(chain.viterbi(emit, np.arange(15))) == [0] * 9 + [1] * 6
    assert (chain.posterior(emit, np.arange(15)).argmax(axis=1) == chain.viterbi(emit, np.arange(15))).all()
    assert chain.fit(emit, np.arange(15)).move.sum(axis=1) == pytest.approx([1, 1])


def test_operators_by_name(spark, basic):
    out = registry.apply(basic, "filter expr='QUAL>50 & TYPE=\"snp\"' | sort | query format='%POS|%REF'")
    assert [r["line"] for r in out.collect()] == ["100|A", "200|T", "400|C"]
    with pytest.raises(registry.UnknownOperator):
        registry.apply(basic, "nope")
    assert "filter" in registry.names()
