import math

import pytest
from pyspark.sql import functions as F

from siteloom.functions import expression as E
from siteloom.functions import genotypes as G
from siteloom.functions import prob
from siteloom.functions import template as T
from siteloom.functions import variants as V

ROWS = [
    (1, "1", 100, "rs1", "A", ["C"], 100.0, ["PASS"], {"DP": ["10"], "AF": ["0.05"], "DB": []}),
    (2, "1", 200, None, "G", ["T", "GA"], 10.0, ["q10", "s50"], {"DP": ["2"], "AF": ["0.5", "0.1"]}),
    (3, "1", 300, "x", "ACGT", ["A"], None, ["PASS"], {"AF": ["0.20"], "S": ["ab,c"]}),
]
SAMPLES = [
    [("A", [0, 1], False, {"DP": ["8"], "AD": ["5", "3"]}), ("B", [0, 0], True, {"DP": ["9"], "AD": ["9", "0"]})],
    [("A", [None, None], False, {"DP": ["."]}), ("B", [1, 2], True, {"DP": ["20"]})],
    [("A", [1], True, {}), ("B", [0, None], False, {"DP": ["4"]})],
]
SCHEMA = "site_id long, chrom string, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,array<string>>, samples array<struct<sample:string,alleles:array<int>,phased:boolean,fmt:map<string,array<string>>>>"


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(*r, s) for r, s in zip(ROWS, SAMPLES, strict=True)], SCHEMA).cache()


@pytest.mark.parametrize(
    "text,want",
    [
        ("QUAL>=50", [1]), ("QUAL<50", [2]), ("!(QUAL<50)", [1, 3]), ("QUAL=\".\"", [3]), ("DP>5", [1]), ("INFO/DP>5 & AF<0.1", [1]),
        ("AF>0.4", [2]), ("AF<0.2", [1, 2]), ("AF=0.2", [3]), ("AF!=0.5", [1, 3]), ("DP!=10", [2, 3]), ("ID=\".\"", [2]), ("ID!=\".\"", [1, 3]),
        ("FILTER=\"q10\"", [2]), ("FILTER!=\"PASS\"", [2]), ("TYPE=\"snp\"", [1, 2]), ("TYPE=\"indel\"", [2, 3]), ("N_ALT=2", [2]), ("ALT=\"GA\"", [2]), ("REF~\"^A\"", [1, 3]), ("ID!~\"rs\"", [2, 3]),
        ("AF[0]>0.1", [2, 3]), ("AF[1]>0", [2]), ("AF[*]<0.15", [1, 2]), ("MAX(AF)>0.3", [2]), ("MIN(AF)=0.1", [2]), ("SUM(AF)>0.55", [2]), ("AVG(AF)>0.25", [2]), ("MEDIAN(AF)>0.25", [2]), ("STDEV(AF)>0.1", [2]), ("COUNT(AF)=2", [2]),
        ("POS%200=100", [1, 3]), ("POS+1=101", [1]), ("DP+1=11", [1]), ("AF*2>0.3", [3]), ("DP/2=5", [1]), ("-POS=-100", [1]), ("POS*2>500", [3]), ("ABS(0-POS)>250", [3]), ("STRLEN(REF)=4", [3]), ("PHRED(0.1)>9.9 & PHRED(0.1)<10.1", [1, 2, 3]),
        ("GT=\"het\"", [1, 2, 3]), ("GT=\"RR\"", [1]), ("GT=\"mis\"", [2, 3]), ("GT=\"aA\"", [2]), ("GT=\"A\"", [3]), ("GT[0:0]=\"het\"", [1]), ("GT!=\"alt\"", []), ("GT=\"0/1\"", [1]),
        ("FMT/DP>8", [1, 2]), ("FMT/DP[1]>8", [1, 2]), ("FMT/AD[0:1]=3", [1]), ("N_PASS(FMT/DP>5)=2", [1]), ("F_PASS(GT=\"alt\")>=0.5", [1, 2, 3]), ("F_MISSING>0.4", [2, 3]), ("N_PASS(GT=\"mis\")>0", [2, 3]),
        ("QUAL>50 | DP<5", [1, 2]), ("QUAL>50 || DP<5 && POS>1000", [1]), ("DB", []), ("DP", [1, 2]), ("NOPE>1", []), ("DP/0>1", []), ("MIN(NOPE)<1", []), ("S=\"ab,c\"", [3]), ("DP=\"10.0\"", [1]), ("N_SAMPLES=2", [1, 2, 3]), ("ILEN=3", [3]),
    ],
)
def test_expressions(sites, text, want):
    got = [r[0] for r in sites.where(E.compile_filter(text, E.vcf_scope())).select("site_id").orderBy("site_id").collect()]
    assert got == want
    n = sites.where(~E.compile_filter(text, E.vcf_scope())).count()
    assert n + len(want) == len(ROWS)


@pytest.mark.parametrize("text", ["QUAL>", "(QUAL>1", "QUAL>1)", "1<2<3", "QUAL ? 1", "NOPE(1)", "BAD/Y>1 &", ""])
def test_bad_expressions(sites, text):
    with pytest.raises(E.ExpressionError):
        E.compile_filter(text, E.vcf_scope())


def test_files(sites, tmp_path):
    (tmp_path / "ids").write_text("rs1\n\nx\n")
    assert [r[0] for r in sites.where(E.compile_filter(f"ID=@{tmp_path}/ids", E.vcf_scope())).select("site_id").collect()] == [1, 3]
    assert [r[0] for r in sites.where(E.compile_filter(f"ID!=@{tmp_path}/ids", E.vcf_scope())).select("site_id").collect()] == [2]


def test_exact_tests_in_expressions(sites):
    got = sites.select(E.compile_value("BINOM(FMT/AD[0:*])", E.vcf_scope()).alias("b"), E.compile_value("FISHER(FMT/AD)", E.vcf_scope()).alias("f")).collect()
    assert got[0]["b"] == pytest.approx(2 * sum(math.comb(8, i) for i in range(4)) / 256)
    assert got[0]["f"] == pytest.approx(prob.fisher_value(5, 3, 9, 0))


@pytest.mark.parametrize(
    "text,want",
    [
        (r"%CHROM:%POS\t%ID %REF %ALT %QUAL %FILTER", ["1:100\trs1 A C 100 PASS", "1:200\t. G T,GA 10 q10;s50", "1:300\tx ACGT A . PASS"]),
        ("%INFO/DP %AF %AF{1} %NOPE %%", ["10 0.05 . . %", "2 0.5,0.1 0.1 . %", ". 0.20 . . %"]),
        ("%TYPE %N_ALT %END", ["snp 1 100", "snp,indel 2 200", "indel 1 303"]),
        ("%POS[ %SAMPLE=%GT:%TGT:%DP]", ["100 A=0/1:A/C:8 B=0|0:A|A:9", "200 A=./.:./.:. B=1|2:T|GA:20", "300 A=1:A:. B=0/.:ACGT/.:4"]),
        ("%MAX(AF) %N_PASS(FMT/DP>5)", ["0.05 2", "0.5 1", "0.2 0"]),
    ],
)
def test_templates(sites, text, want):
    assert [r["line"] for r in T.render_sites(sites.orderBy("site_id"), text).collect()] == want


def test_bad_template(sites):
    with pytest.raises(T.TemplateError):
        T.compile_template("[%GT", sites)


def test_variant_helpers(spark):
    rows = [("A", ["C"]), ("A", ["."]), ("AC", ["GT"]), ("AC", ["AT"]), ("A", ["AT", "*"]), ("A", ["<DEL>"]), ("A", ["N[1:5["]), ("A", ["<*>"]), ("A", [])]
    d = spark.createDataFrame(rows, "ref string, alts array<string>")
    got = [r[0] for r in d.select(V.class_label(V.variant_class(F.col("ref"), F.col("alts")))).collect()]
    assert got == ["snp", "ref", "mnp", "snp", "indel,overlap", "other", "bnd", "ref", "ref"]
    n = spark.range(1).select(*(V.genotype_index(F.lit(a), F.lit(b)) for a, b in ((0, 0), (0, 1), (1, 1), (2, 0), (1, 2), (2, 2)))).first()
    assert list(n) == [0, 1, 2, 3, 4, 5]


def test_genotype_helpers(spark):
    texts = ["0/1", "1|1", "./.", "0/.", ".", "1", "1/2"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("a", G.parse(F.col("t"))).withColumn("p", G.is_phased(F.col("t")))
    assert [r[0] for r in d.select(G.render(F.col("a"), F.col("p"))).collect()] == ["0/1", "1|1", "./.", "0/.", ".", "1", "1/2"]
    assert [r[0] for r in d.select(G.view_class(F.col("a"))).collect()] == ["het", "hom", "miss", "hom", "miss", "hom", "het"]
    assert [r[0] for r in d.select(G.is_class(F.col("a"), "het")).collect()] == [True, False, False, True, False, False, True]
    assert [r[0] for r in d.select(G.hap_pair(F.col("a"), F.col("p"))).collect()] == ["0* 1*", "1 1", "?  ?".replace("  ", " "), "0* ?", "? -", "1 -", "1* 2*"]


def brute_fisher(a, b, c, d):
    r, s, n = a + b, a + c, a + b + c + d
    p = {x: math.comb(r, x) * math.comb(n - r, s - x) for x in range(max(0, r + s - n), min(r, s) + 1)}
    return sum(v for v in p.values() if v <= p[a]) / math.comb(n, s)


def test_exact_tests(spark):
    for t in [(3, 1, 1, 3), (10, 0, 2, 8), (0, 0, 3, 4), (5, 5, 5, 5), (1, 9, 11, 3)]:
        assert prob.fisher_value(*t) == pytest.approx(brute_fisher(*t))
    assert prob.binom_two_sided_value(0, 0) == -1 and prob.binom_two_sided_value(4, 4) == 1
    assert prob.binom_two_sided_value(1, 5) == pytest.approx(2 * (1 + 6) / 64)
    rng = __import__("random").Random(3)
    tables = [tuple(rng.randint(0, 30) for _ in range(4)) for _ in range(60)] + [(0, 0, 0, 0), (2000, 1500, 1400, 1900), (0, 9, 0, 4)]
    d = spark.createDataFrame(tables, "a int, b int, c int, d int")
    c = F.col
    got = d.select("a", "b", "c", "d", prob.fisher_two_sided(c("a"), c("b"), c("c"), c("d")).alias("f"), prob.binom_two_sided(c("a"), c("b")).alias("t"), prob.hwe(c("a") + c("b"), c("c") + c("d"), c("c")).alias("h"), prob.exc_het(c("a") + c("b"), c("c") + c("d"), c("c")).alias("e")).collect()
    for r in got:
        assert r["f"] == pytest.approx(prob.fisher_value(*r[:4]), rel=1e-6, abs=1e-12) and r["t"] == pytest.approx(prob.binom_two_sided_value(r["a"], r["b"]), rel=1e-6, abs=1e-12)
        assert [r["h"], r["e"]] == pytest.approx(prob.hwe_value(r["a"] + r["b"], r["c"] + r["d"], r["c"]), rel=1e-6, abs=1e-12)
    # all heterozygote counts of 6 rare alleles in 10 people
    w = {h: 2**h * math.factorial(10) // (math.factorial(h) * math.factorial((6 - h) // 2) * math.factorial(10 - h - (6 - h) // 2)) for h in (0, 2, 4, 6)}
    for h in w:
        p, tail = prob.hwe_value(14, 6, h)
        assert p == pytest.approx(sum(v for v in w.values() if v <= w[h]) / sum(w.values()))
        assert tail == pytest.approx(sum(v for k, v in w.items() if k >= h) / sum(w.values()))


def line_frame(spark, fmt, samples, info="."):
    from siteloom.sources import vcf
    from siteloom.sources.header import parse_header

    names = [f"S{i}" for i in range(len(samples))]
    head = parse_header(["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names)])
    line = "\t".join(["1", "9", ".", "A", "C,G", "60", "PASS", info, fmt, *samples])
    return vcf.parse_lines(spark.createDataFrame([(line, 0)], "value string, ord long"), head)


@pytest.mark.parametrize(
    "fmt,samples,info,text,want",
    [
        ("DP", ["4", "12", "."], ".", "FMT/DP[1]>10", True), ("DP", ["4", "12", "."], ".", "COUNT(FMT/DP[*]>10)=1", True),
        ("GT:DP", ["0/1:12", "0/0:22", "./.:3"], ".", "N_PASS(FMT/DP>10)=2", True), ("GT:DP", ["0/1:12", "0/0:22", "./.:3"], ".", 'N_PASS(GT!="0/0" && DP>=10)=1', True),
        ("GT:DP", ["0/1:12", "0/0:22", "./.:3"], ".", "QUAL=60 && N_PASS(FORMAT/DP>10)=2", True), ("GT:DP", ["0/1:12", "0/0:22", "./.:3"], ".", "F_PASS(FMT/DP>10)>0.666 & F_PASS(FMT/DP>10)<0.667", True),
        ("GT:DP", ["0/1:12", "0/0:22", "./.:3"], ".", "F_MISSING>0.33 & F_MISSING<0.34", True), ("GT:DP", ["0/1:12", "0/0:22", "./.:3"], ".", 'F_PASS(GT="mis")<0.34', True),
        ("GT:DP:GQ", ["0/1:12:99", "0/0:3:25"], ".", "FMT/GQ=25 | FMT/DP=10", True), ("GT:DP:GQ", ["0/1:12:99", "0/0:3:25"], ".", "FMT/DP=4 | FMT/GQ=12", False),
        *(("GT", ["0/0", "0/1", "1/1", "1/2", "2"], ".", f'GT="{c}"', c != "R") for c in "R A RR RA AR AA aA Aa HOM HET HAP".split()), ("GT", ["0/1"], ".", 'GT="HAP"', False),
        ("AD:FR", ["1,11:1,11", "2,11:2,12"], ".", "AD[:1]=11", True), ("AD:FR", ["1,11:1,11", "2,11:2,12"], ".", "AD[1:]=11", True), ("AD:FR", ["1,11:1,11", "2,11:2,12"], ".", "FR[0:1]=11", True), ("AD:FR", ["1,11:1,11", "2,11:2,12"], ".", "FR[1:1]=11", False),
        ("GT", ["0/0"], "AD=3,9", "MIN(AD)=3 && MAX(AD)=9", True), ("GT", ["0/0"], "AD=3,9", "0 && UNKNOWN>1", False), ("GT", ["0/0"], "AD=3,9", "SMPL_SUM(AD)=12 & sAVG(AD)=6 & MEAN(AD)=6 & MEDIAN(AD)=6 & sSTDEV(AD)=3", True),
        ("GT", ["0/0"], "D=-4;P=0.01", "ABS(D)=4 & PHRED(P)>19.999 & PHRED(P)<20.001", True), ("GT", ["0/0"], "C=1X4M,1X3M1X", "STRLEN(C[0])=4 & STRLEN(C[*])=6", True), ("GT", ["0/0"], "C=1X4M,1X3M1X", "STRLEN(C[*])=2", False),
        ("GT", ["0/0"], "AD=10,2", "binom(AD)>0.0385742 & binom(AD)<0.0385743 & phred(binom(10,2))>14.136 & phred(binom(10,2))<14.138", True), ("GT", ["0/0"], "X=1,9,11,3;F=1,11;R=9,3", "fisher(X)>0.00275945 & fisher(X)<0.00275946 & fisher(F,R)>0.00275945 & fisher(F,R)<0.00275946", True),
        ("GT", ["0/0"], "T=a b", "T='a b'", True), ("GT", ["0/0"], "X=1", "!(X < -1.5e-2)", True),
    ],
)
def test_known_expressions(spark, fmt, samples, info, text, want):
    assert line_frame(spark, fmt, samples, info).where(E.compile_filter(text, E.vcf_scope())).count() == int(want)


def test_text_escapes():
    assert E.parse(r"'a\tb'").value == "a\tb" and E.parse(r'"\d\""').value == r'\d"'
