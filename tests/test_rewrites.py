from pyspark.sql import functions as F

from siteloom.functions.template import header_row
from siteloom.operators import rewrite as R
from siteloom.sources import vcf
from siteloom.sources.header import parse_header

HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"
LINE = "1\t5\t.\tA\tC,G,T\t.\tq10\tAF=0.1,0.2,0.3;XR=1,2,3,4;DP=9\tGT:AD:PL\t0/2:1,2,3,4:0,1,2,3,4,5,6,7,8,9\t./2:5,6,7,8:."


def site(spark):
    lines = spark.createDataFrame([(LINE, 0)], "value string, ord long")
    return vcf.parse_lines(lines, parse_header([HEAD]))


def test_trim_record(spark):
    numbers = {"INFO/AF": "A", "INFO/XR": "R", "FORMAT/AD": "R", "FORMAT/PL": "G"}
    r = R.trim_record(site(spark), numbers).first()
    assert r["alts"] == ["G"] and r["info"] == {"AF": ["0.2"], "XR": ["1", "3"], "DP": ["9"], "AC": ["2"], "AN": ["3"]}
    a, b = r["samples"]
    assert a["alleles"] == [0, 1] and b["alleles"] == [None, 1]
    assert a["fmt"]["AD"] == ["1", "3"] and a["fmt"]["PL"] == ["0", "3", "5"] and b["fmt"]["PL"] == [".", ".", "."]


def test_rename_and_keep(spark):
    r = R.rename_annotations(site(spark), {"INFO/DP": "DEPTH", "FILTER/q10": "low", "FORMAT/AD": "READS"}).first()
    assert "DEPTH" in r["info"] and "DP" not in r["info"] and r["filters"] == ["low"] and r["format"] == ["GT", "READS", "PL"] and r["samples"][0]["fmt"]["READS"] == ["1", "2", "3", "4"]
    k = R.keep_tags(site(spark), ["AF"], ["GT"]).first()
    assert set(k["info"]) == {"AF"} and k["format"] == ["GT"] and set(k["samples"][1]["fmt"]) == {"GT"}
    long = vcf.explode_samples(site(spark))
    assert sorted(x["sample"] for x in R.rename_samples(long, {"A": "Z"}).collect()) == ["B", "Z"]


def test_local_alleles(spark):
    pl = F.array(*(F.lit(x) for x in (50, 60, 70, 0, 60, 80, 90, 90, 90, 90)))  # 0/2 is the best of four alleles
    r = spark.range(1).select(R.local_alleles(pl, F.lit(3), 1).alias("one"), R.local_alleles(pl, F.lit(3), 2).alias("two")).first()
    assert r["one"] == [2] and r["two"] == [1, 2]


def test_header_row():
    assert header_row(r"%CHROM\t%POS[\t%GT]", ["A", "B"]) == "#[1]CHROM\t[2]POS\t[3]A:GT\t[4]B:GT"
    assert header_row("%POS %SUM(DP)", numbered=False) == "#POS SUM(DP)"


def test_trim_symbolic(spark):
    d = spark.createDataFrame([(1, ["C", "<*>"]), (2, ["<NON_REF>"]), (3, ["C"])], "site_id long, alts array<string>")
    assert [r["alts"] for r in R.trim_symbolic(d).orderBy("site_id").collect()] == [["C"], ["<NON_REF>"], ["C"]]
    assert [r["alts"] for r in R.trim_symbolic(d, always=True).orderBy("site_id").collect()] == [["C"], [], ["C"]]
