"""What a task holds or repeats doesn't grow with the rows of a position, a chain, a chunk or a table."""

import pytest
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import prob
from siteloom.functions import variants as V
from siteloom.functions.expression import compile_value
from siteloom.operators import consensus as C
from siteloom.operators import merge as M
from siteloom.operators import models
from siteloom.plans import relations
from siteloom.sources import vcf

SF = "/root/testdata/sf0.001"


def plan_of(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_the_header_is_read_from_the_first_file_only(spark, tmp_path):
    (tmp_path / "part-0.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
    (tmp_path / "part-1.vcf.gz").write_bytes(b"no gzip" * 1000)
    assert vcf.read_header(spark, str(tmp_path)).version == "4.2"


def test_missing_values_are_not_cast(spark):
    d = spark.createDataFrame([("0/.",), ("1|2",), (".",), ("x/1",)], "gt string").select(G.parse(F.col("gt")).alias("a"))
    assert [r["a"] for r in d.collect()] == [[0, None], [1, 2], [None], [None, 1]]
    assert "[/|]" not in plan_of(d) and "= ." in plan_of(d)


def test_values_in_expressions_are_computed_once(spark):
    d = spark.createDataFrame([([8, 3],), ([0, 0],), ([5, 5],), ([1500, 1300],), ([0, 2000],)], "ad array<int>")
    got = d.select("ad", compile_value("BINOM(AD[0],AD[1])").alias("p"))
    assert [r["p"] for r in got.collect()] == pytest.approx([prob.binom_two_sided_value(*r["ad"]) for r in got.collect()], rel=1e-6)
    four = spark.createDataFrame([([5, 3, 9, 2],)], "pl array<int>").select(compile_value("FISHER(PL)").alias("p"))
    assert four.first()["p"] == pytest.approx(prob.fisher_value(5, 3, 9, 2))
    sites = spark.createDataFrame([("A", ["C"]), ("A", ["AT", "<DEL>"]), ("AC", ["A"]), ("A", [])], "ref string, alts array<string>")
    label = sites.select(V.class_label(V.variant_class(F.col("ref"), F.col("alts"))).alias("c"))
    assert [r["c"] for r in label.collect()] == ["snp", "indel,other", "indel", "ref"]
    assert plan_of(got).count("ad#") < 8 and plan_of(four).count("pl#") < 8 and plan_of(label).count("aggregate(") == 1


def frame(spark, n, name):
    d = spark.range(n).select(F.col("id").alias("site_id"), F.lit("c").alias("chrom"), F.lit(1).alias("contig_rank"), (1 + F.col("id") % 2).alias("pos"), F.lit("A").alias("ref"), F.array(F.substring(F.lit("CGT"), (1 + F.col("id") % 3).cast("int"), F.lit(1))).alias("alts"))
    call = F.struct(F.lit(name).alias("sample"), F.lit("0/1").alias("gt_raw"), F.array(F.lit(0), F.lit(1)).alias("alleles"), F.lit(False).alias("phased"), F.create_map(F.lit("DP"), F.array(F.lit("3"))).alias("fmt"))
    return d.select("*", F.lit(None).cast("string").alias("id"), F.lit(9.0).alias("qual"), F.array(F.lit("PASS")).alias("filters"), F.create_map(F.lit("DP"), F.array(F.col("site_id").cast("string"))).alias("info"), F.array(F.lit("GT"), F.lit("DP")).alias("format"), F.array(call).alias("samples"))


def test_records_of_a_position_are_numbered_before_they_are_gathered(spark):
    m = M.merge([frame(spark, 60, "a"), frame(spark, 20, "b")], "all")
    got = sorted((r["pos"], r["info"]["DP"][0], r["inputs"]) for r in m.collect())
    assert got == sorted((1 + i % 2, str(2 * i if i < 20 else i), [0, 1] if i < 20 else [0]) for i in range(60))
    assert "row_number()" in plan_of(m) and plan_of(m).count("Generate ") == 1


@pytest.mark.parametrize("keep", ["first", "maxqual"])
def test_pruning_walks_few_sites_of_a_position(spark, keep):
    s = spark.range(3000).select(F.col("id").alias("site_id"), F.lit("c").alias("chrom"), (1 + F.col("id") * 7 % 40 + F.when(F.col("id") % 2 == 0, 500).otherwise(0)).alias("pos"), (F.col("id") * 11 % 13).cast("double").alias("qual"))
    held, gone = [], set()
    for pos, name, q in sorted((r["pos"], r["site_id"], r["qual"]) for r in s.collect()):
        held = [h for h in held if pos - h[0] < 10] + [(pos, q, name)]
        if len(held) > 2:
            out = held[-1] if keep == "first" else min(held, key=lambda h: (h[1], -h[0]))
            held.remove(out)
            gone.add(out[2])
    got = models.prune(s, 10, 2, keep)
    assert {r["site_id"] for r in got.collect()} == set(range(3000)) - gone
    assert "FlatMapGroupsInPandas" not in plan_of(got) and "_nth" in plan_of(got)


def test_places_of_genotypes_grow_with_the_table(spark, monkeypatch):
    before = relations.genotypes(spark, SF)
    monkeypatch.setattr(relations, "PLACE", 4000)
    after = relations.genotypes(spark, SF)
    assert after.rdd.getNumPartitions() > 20
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_pieces_of_blocks_are_the_pairs_of_one_join(spark):
    block = lambda rows: spark.createDataFrame(rows, "site_id long, chrom string, pos long, ref string, alts array<string>, end long")
    a, b = M.expand_reference_blocks([block([(1, "c", 1, "A", ["<*>"], 9), (2, "c", 20, "A", ["<*>"], 20)]), block([(3, "c", 4, "A", ["<*>"], 6), (4, "c", 8, "A", ["T"], None)])])
    assert sorted((r["site_id"], r["pos"], r["end"]) for r in a.collect()) == [(1, 1, 3), (1, 4, 6), (1, 7, 7), (1, 8, 8), (1, 9, 9), (2, 20, 20)]
    assert sorted((r["site_id"], r["pos"], r["end"] or 0) for r in b.collect()) == [(3, 4, 6), (4, 8, 0)]
    assert "collect_set(at" not in plan_of(a)


def test_sites_are_joined_with_pieces_of_chunks(spark):
    bases = "".join("ACGT"[i * i % 7 % 4] for i in range(1000))
    ref = spark.createDataFrame([("c", 1, bases)], "chrom string, chunk_start long, bases string")
    s = spark.createDataFrame([("c", p) for p in (1, 255, 256, 257, 258, 512, 999, 1000, 1001)] + [("d", 5)], "chrom string, pos long")
    got = C.bases_at(s, ref, 3)
    assert {(r["chrom"], r["pos"]): r["base"] for r in got.collect()} == {("c", p): bases[p - 1 : p + 2] for p in (1, 255, 256, 257, 258, 512, 999, 1000, 1001)} | {("d", 5): None}
    assert "substring(bases" in plan_of(got).split("Join ")[1]
