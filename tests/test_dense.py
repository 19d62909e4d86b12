"""Tables where many rows share positions: no pairs are made that the result doesn't hold, and ties come in the order that is asked for."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import filters as FL

SF = "/root/testdata/sf0.001"


def range_joins(d):
    """Joins of the optimised plan that compare rows by a range."""
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.split("\n") if "Join " in x and "_re#" in x]


def dense(spark, n, width=3):
    return spark.range(n).select(
        F.col("id").alias("site_id"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("chrom"), (F.col("id") % 2 + 1).cast("int").alias("contig_rank"), (1 + F.col("id") * 7 % 40).alias("pos"),
        F.substring(F.lit("ACGT"), F.lit(1), (1 + F.col("id") % width).cast("int")).alias("ref"), F.array(F.lit("A")).alias("alts"), (F.col("id") * 11 % 13).cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), F.lit(None).cast("long").alias("end"),
    )


@pytest.mark.parametrize("how", ["semi", "anti", "mask"])
def test_regions_make_no_pairs(spark, how):
    s = dense(spark, 4000)
    r = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("chrom"), (1 + F.col("id") * 3 % 30).alias("start"), (F.col("id") * 3 % 30 + F.col("id") % 2).alias("end"))
    got = FL.mask_regions(s, r, "M") if how == "mask" else FL.in_regions(s, r, "record", exclude=how == "anti")
    spans = [tuple(x) for x in r.distinct().collect()]
    hit = {x["site_id"] for x in s.collect() if any(c == x["chrom"] and a <= x["pos"] + len(x["ref"]) - 1 and b >= x["pos"] for c, a, b in spans)}
    assert 0 < len(hit) < 4000
    ids = {x["site_id"] for x in (got.where(F.array_contains("filters", "M")) if how == "mask" else got).collect()}
    assert ids == (set(range(4000)) - hit if how == "anti" else hit)
    assert not range_joins(got)


def made_pairs(d):
    """Rows of the largest join of a frame that was collected."""
    d.write.format("noop").mode("overwrite").save()
    return max((int(x) for x in _rows_of_joins(d)), default=0)


def _rows_of_joins(d):
    plan = d._jdf.queryExecution().executedPlan()
    plan.execute().count()
    text = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while text:
        p = text.pop()
        if p.getClass().getSimpleName() in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            p = p.plan()
        if "Join" in p.getClass().getSimpleName():
            yield p.metrics().apply("numOutputRows").value()
        children = p.children()
        text += [children.apply(i) for i in range(children.size())]


def test_overlaps_of_dense_sites_make_few_pairs(spark):
    from siteloom.operators.joins import overlap_min_qual

    s = dense(spark, 3000)
    rows = [(r["chrom"], r["pos"], r["pos"] + len(r["ref"]) - 1, (r["qual"], -r["pos"], -r["site_id"]), r["site_id"]) for r in s.collect()]
    best = {}
    for c, a, z, q, _ in rows:
        for p in range(a, z + 1):
            best[c, p] = max(best.get((c, p), q), q)
    want = {i for c, a, z, q, i in rows if all(best[c, p] <= q for p in range(a, z + 1))}
    got = overlap_min_qual(s)
    assert {r["site_id"] for r in got.collect()} == want
    assert made_pairs(got) < 10_000


def test_frames_of_dense_indels_make_few_pairs(spark):
    from siteloom.operators.stats import frameshifts

    s = dense(spark, 2000).where("length(ref) > 1")
    e = spark.range(1000).select(F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("chrom"), (1 + F.col("id") * 7 % 40).alias("start"), (1 + F.col("id") * 7 % 40 + F.col("id") % 5).alias("end"), F.col("id").alias("name"))
    exons = e.collect()
    want = set()
    for r in s.collect():
        stop = r["pos"] + len(r["ref"]) - 1
        near = min(((x["name"], max(0, min(stop, x["end"]) - max(r["pos"] + 1, x["start"]) + 1)) for x in exons if x["chrom"] == r["chrom"] and x["start"] <= stop and x["end"] >= r["pos"]), default=None)
        want.add((r["site_id"], near and near[0], "na" if near is None else "out" if near[1] % 3 else "in"))
    got = frameshifts(s, e)
    assert {(r["site_id"], r["exon"], r["frame"]) for r in got.collect()} == want
    assert made_pairs(got) < 10_000


def test_records_of_groups_with_equal_ones(spark):
    from siteloom.operators import joins as J

    s = dense(spark, 400)
    other = s.where("pos < 20 and site_id % 3 = 0")
    keys = {(r["chrom"], r["pos"], r["ref"]) for r in other.collect()}
    want = sorted(r["site_id"] for r in s.collect() if (r["chrom"], r["pos"], r["ref"]) in keys)
    g = J.in_at_least(J.groups([s, other]), 2)
    assert sorted(r["site_id"] for r in J.records_in(g, [s, other], 0).collect()) == want
    assert len(want) > len(keys)


def test_numbers_are_of_the_sorted_frame(spark, tmp_path):
    from siteloom.operators import joins as J

    s = dense(spark, 1000)
    want = sorted((r["chrom"], r["pos"], r["ref"].lower(), ",".join(r["alts"]).lower(), r["site_id"]) for r in s.collect())
    got = J.numbered(J.sort_sites(s, names=True).select("site_id"), str(tmp_path / "sorted")).orderBy("nth").collect()
    assert [r["site_id"] for r in got] == [w[4] for w in want] and [r["nth"] for r in got] == list(range(1, 1001))


def test_ld_pairs_are_made_last_for_any_number_of_samples(spark):
    from siteloom.operators.joins import ld_r2

    s = dense(spark, 60)
    call = lambda i, k: None if (i * 5 + k) % 9 == 0 else [(i + k) % 3 % 2, (i * k) % 5 % 2]
    g = spark.createDataFrame([(i, k, f"N{k}", call(i, k)) for i in range(60) for k in range(1, 131) if call(i, k)], "site_id long, sample_id int, sample string, alleles array<int>")
    rows, want = s.select("site_id", "chrom", "pos").collect(), {}
    for a in rows:
        for b in rows:
            if a["chrom"] == b["chrom"] and b["pos"] - a["pos"] <= 9 and (b["pos"], b["site_id"]) > (a["pos"], a["site_id"]):
                xy = [(sum(call(a["site_id"], k)), sum(call(b["site_id"], k))) for k in range(1, 131) if call(a["site_id"], k) and call(b["site_id"], k)]
                n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
                vx, vy = n * sum(x * x for x, _ in xy) - sx * sx, n * sum(y * y for _, y in xy) - sy * sy
                if vx > 0 and vy > 0:
                    want[a["site_id"], b["site_id"]] = (n * sum(x * y for x, y in xy) - sx * sy) ** 2 / (vx * vy)
    got = ld_r2(g, s, 9)
    assert {(r["a"], r["b"]): r["r2"] for r in got.collect()} == pytest.approx(want)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert "_bin#" in joins[0]
