import pytest
from pyspark.sql import functions as F

from siteloom.operators import stats as S
from siteloom.plans.relations import genotypes, second_input, sites
from siteloom.sources import bcf, bgzf, sinks, store
from siteloom.sources.header import parse_header

SF = "/root/testdata/sf0.001"
LINES = [
    "1\t20\trs1\tC\tT,G\t9.5\tPASS\tDP=7;AF=0.1,0.25;DB\tGT:DP:NM\t./.:.:x\t1:300:yy",
    "2\t10\t.\tA\t<DEL>\t.\tq10;PASS\tEND=70000\tGT:DP:NM\t0|1:4:.\t0/2:-5:abc",
    "1\t5\t.\tA\t.\t30\t.\t.",
]
HEAD = """##fileformat=VCFv4.2
##contig=<ID=1>
##contig=<ID=2>
##FILTER=<ID=q10,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=END,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="d">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="d">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
##FORMAT=<ID=NM,Number=1,Type=String,Description="d">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB""".splitlines()


def test_bcf_round_trip(spark, tmp_path):
    header = parse_header(HEAD)
    data = bcf.encode(header, LINES)
    back, lines = bcf.decode(data)
    assert back == header and list(lines) == LINES
    (tmp_path / "a.bcf").write_bytes(bgzf.compress(data))
    h, d = bcf.read_bcf(spark, str(tmp_path / "a.bcf"))
    assert h.samples == ("A", "B") and d.count() == 3 and d.where("end = 70000").first()["alts"] == ["<DEL>"]
    with pytest.raises(bcf.BcfError):
        bcf.encode(header, ["3\t1\t.\tA\tC\t.\t.\t."])
    with pytest.raises(bcf.BcfError):
        bcf.decode(b"plain text")


def test_bcf_in_ranges(spark, tmp_path):
    header = parse_header(HEAD)
    many = []
    for i in range(4000):
        f = LINES[i % len(LINES)].split("\t")
        f[1] = str(1 + i)
        f[7] = ";".join(x for x in f[7].split(";") if not x.startswith("END=")) or "."
        many.append("\t".join(f))
    (tmp_path / "a.bcf").write_bytes(bgzf.compress(bcf.encode(header, many)))
    size = (tmp_path / "a.bcf").stat().st_size
    for step in (1 << 25, size // 2, size // 5):
        h, d = bcf.read_bcf(spark, str(tmp_path / "a.bcf"), step)
        assert h == header and sorted(r["pos"] for r in d.select("pos").collect()) == list(range(1, 4001))


def test_store(spark, tmp_path):
    s = sites(spark, SF)
    store.write_store(s, str(tmp_path / "s"))
    got = store.query_region(spark, str(tmp_path / "s"), "chr2", 1000, 30000)
    assert got.count() == s.where("chrom = 'chr2' and pos between 1000 and 30000").count() > 0
    assert "PartitionFilters: [isnotnull(chrom" in got._jdf.queryExecution().toString()
    n = {r["chrom"]: r["n"] for r in store.contig_statistics(spark, str(tmp_path / "s"), ["chr1", "chr9"]).collect()}
    assert n == {"chr1": s.where("chrom = 'chr1'").count(), "chr9": 0}


def test_sinks(spark, tmp_path):
    s, g = sites(spark, SF), genotypes(spark, SF)
    sinks.split_by_sample(g, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("name = 'S3'").count() == g.where("sample = 'S3'").count()
    sinks.scatter_to(s, 400, str(tmp_path / "chunks"))
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "chunks")).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()] == [400, 400, 400, 300]
    sinks.write_intersection([s, second_input(spark, SF)], str(tmp_path / "isec"), 2)
    assert spark.read.parquet(str(tmp_path / "isec/0000")).count() > 0
    hap = sinks.hap_rows(g, s, legend=True).first()
    assert len(hap["legend"].split()) == 4 and len(hap["line"].split()) % 2 == 0
    t = sinks.tall("SN", S.summary(s), [])
    assert {r["key"]: r["value"] for r in t.collect()}["records"] == s.count()
    card = sinks.site_cards(s).first()["card"].split("\n")
    assert len(card) == 8 and len({len(x) for x in card}) == 1


def test_output_types_and_provenance():
    assert sinks.output_mode("v") == ("vcf", 0) and sinks.output_mode("z9") == ("vcf.gz", 9) and sinks.output_mode("b") == ("bcf", 6) and sinks.output_mode("u") == ("bcf", 0)
    for bad in ("", "x", "z10", "u1", "zz"):
        with pytest.raises(ValueError):
            sinks.output_mode(bad)
    h = parse_header(HEAD).with_provenance("tool", "1", "view a").with_provenance("tool", "2", "view b")
    assert [x for x in h.lines() if x.startswith("##tool")] == ["##toolVersion=2", "##toolCommand=view b"]
