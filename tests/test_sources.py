import pytest
from pyspark.sql import functions as F

from siteloom.functions.expression import compile_filter, vcf_scope
from siteloom.operators import consensus as C
from siteloom.sources import bgzf, companions, vcf
from siteloom.sources.header import HeaderError, merge_headers, parse_header

TEXT = """##fileformat=VCFv4.2
##contig=<ID=1,length=1000>
##contig=<ID=2>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
2\t25\t.\tA\tT\t.\t.\tDP=5;DB\tGT:DP\t0/1:3\t1|1:4
1\t20\trs1\tC\tT,G\t9.5\tPASS\tDP=7;AF=0.1,0.2\tGT\t./.\t1
1\t10\t.\tA\tG\t30\tq10;s50\t.\tGT:DP\t0|0:.\t0/1
1\t10\t.\tA\tC\t30\tq10\tDP=1\tGT\t0/0\t0/0
"""


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(TEXT)
    return str(p)


def test_read(spark, path):
    header, sites = vcf.read_vcf(spark, path)
    assert header.contigs == ["1", "2"] and header.samples == ("A", "B") and header.type("INFO", "DP") == "Integer"
    rows = sites.orderBy("site_id").collect()
    assert [(r["chrom"], r["pos"], r["id"], r["ref"], r["alts"], r["qual"], r["filters"]) for r in rows[:2]] == [("2", 25, None, "A", ["T"], None, []), ("1", 20, "rs1", "C", ["T", "G"], 9.5, ["PASS"])]
    assert rows[0]["info"] == {"DP": ["5"], "DB": []} and rows[2]["info"] == {} and rows[0]["contig_rank"] == 1
    assert rows[1]["samples"][0]["alleles"] == [None, None] and rows[1]["samples"][1]["alleles"] == [1]
    assert rows[2]["samples"][1]["fmt"]["DP"] == ["."]
    long = vcf.explode_samples(sites)
    assert long.count() == 8
    assert [r["pos"] for r in sites.where(compile_filter("DP>4 & GT=\"alt\"", vcf_scope())).collect()] == [25, 20]


def test_round_trip(spark, path, tmp_path):
    header, sites = vcf.read_vcf(spark, path)
    out = str(tmp_path / "out")
    vcf.write_vcf(sites, header, out)
    back, again = vcf.read_vcf(spark, out)
    assert back == header
    body = [x for x in TEXT.splitlines() if not x.startswith("#")]
    got = [r["value"] for r in spark.read.text(out).where("not startswith(value, '#')").collect()]
    assert sorted(got) == sorted(x.replace("\t0|0:.\t0/1", "\t0|0:.\t0/1:.") for x in body)
    assert sorted((r["chrom"], r["pos"]) for r in again.collect()) == [("1", 10), ("1", 10), ("1", 20), ("2", 25)]
    files = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    lines = "".join((tmp_path / "out" / f).read_text() for f in files).splitlines()
    assert lines[0] == "##fileformat=VCFv4.2"
    assert [tuple(x.split("\t")[:5]) for x in lines if not x.startswith("#")] == [("1", "10", ".", "A", "C"), ("1", "10", ".", "A", "G"), ("1", "20", "rs1", "C", "T,G"), ("2", "25", ".", "A", "T")]


def test_bgzf(spark, tmp_path):
    data = (TEXT + "".join(f"1\t{i}\t.\tA\tC\t.\t.\tDP={i}\tGT\t0/1\t0/0\n" for i in range(100, 9000))).encode()
    (tmp_path / "a.vcf.gz").write_bytes(bgzf.compress(data))
    lines = bgzf.read_lines(spark, str(tmp_path / "a.vcf.gz"))
    assert [r["value"] for r in lines.orderBy("ord").collect()] == data.decode().splitlines()
    header = parse_header([x for x in TEXT.splitlines() if x.startswith("#")])
    assert vcf.parse_lines(lines, header).count() == 8904
    _, sites = vcf.read_vcf(spark, str(tmp_path / "a.vcf.gz"))  # as plain gzip
    assert sites.count() == 8904
    for step in (700, 3000, 20_000):  # ranges of less than a block and of several
        part = bgzf.read_lines(spark, str(tmp_path / "a.vcf.gz"), step)
        assert [r["value"] for r in part.orderBy("ord").collect()] == data.decode().splitlines()
    long = b"\n".join([b"x" * 200_000, b"y", b"", b"z" * 70_000])  # lines over several blocks, and no line end at the end
    (tmp_path / "b.gz").write_bytes(bgzf.compress(long, level=0))
    assert [r["value"] for r in bgzf.read_lines(spark, str(tmp_path / "b.gz"), 40_000).orderBy("ord").collect()] == [x.decode() for x in long.split(b"\n") if x]


def test_bgzf_parts(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(TEXT + "".join(f"1\t{i}\t.\tA\tC\t.\t.\tDP={i}\tGT\t0/1\t0/0\n" for i in range(100, 9000)))
    header, sites = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    out = str(tmp_path / "parts")
    bgzf.write_vcf_gz(sites, header, out)
    again, back = bgzf.read_vcf_gz(spark, out, 5000)
    assert again == header and back.count() == sites.count() == 8904
    bgzf.join_parts(out, str(tmp_path / "one.vcf.gz"))
    joined = (tmp_path / "one.vcf.gz").read_bytes()
    assert joined.endswith(bgzf.END)
    text = b"".join(bgzf.decompress_block(joined[a : a + n]) for a, n in bgzf.blocks(joined)).decode().splitlines()
    assert text[: len(header.lines())] == header.lines() and len(text) == len(header.lines()) + 8904
    assert [int(x.split("\t")[1]) for x in text if x.startswith("1\t")] == sorted(int(x.split("\t")[1]) for x in text if x.startswith("1\t"))
    with pytest.raises(bgzf.BgzfError):
        list(bgzf.texts_from(bgzf.open_file(str(tmp_path / "a.vcf")), 0, 100))
    with pytest.raises(bgzf.BgzfError):
        list(bgzf.blocks(b"plain"))


def test_headers():
    h = parse_header(["##fileformat=VCF4.2", "##x=1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    assert h.version == "4.2" and h.warnings and h.lines()[0] == "##fileformat=VCFv4.2" and "##x=1" in h.lines()
    a = parse_header([x for x in TEXT.splitlines() if x.startswith("#")])
    with pytest.raises(HeaderError):
        merge_headers([a, a])
    assert merge_headers([a, a], force_samples=True).samples == ("A", "B", "2:A", "2:B")
    assert a.renamed({"A": "X"}).samples == ("X", "B")
    assert list(a.with_contigs({"2": 5, "3": 7}).fields["contig"]) == ["2", "3"]
    with pytest.raises(HeaderError):
        parse_header(["##fileformat=VCFv4.2"])


def test_short_records_are_an_error(spark, tmp_path):
    (tmp_path / "b.vcf").write_text(TEXT + "1\t2\n")
    _, sites = vcf.read_vcf(spark, str(tmp_path / "b.vcf"))
    with pytest.raises(Exception, match="fewer than 8 fields"):
        sites.collect()


def test_regions(spark, tmp_path):
    assert companions.parse_region("1") == ("1", None, None)
    assert companions.parse_region("1:5") == ("1", 5, 5)
    assert companions.parse_region("1:1,000-2,000") == ("1", 1000, 2000)
    assert companions.parse_region("chr2:7-") == ("chr2", 7, None)
    assert companions.parse_region("{HLA:01}:1-2") == ("HLA:01", 1, 2)
    with pytest.raises(companions.RegionError):
        companions.parse_region("1:9-2")
    assert [tuple(r)[:3] for r in companions.region_list(spark, "1:5-10,2").collect()] == [("1", 5, 10), ("2", None, None)]
    (tmp_path / "x.bed").write_text("#c\n1\t9\t30\tex1\n")
    (tmp_path / "x.tab").write_text("1\t9\n2\t5\t8\n")
    assert [tuple(r) for r in companions.read_regions(spark, str(tmp_path / "x.bed")).collect()] == [("1", 10, 30, "ex1")]
    assert [tuple(r)[:3] for r in companions.read_regions(spark, str(tmp_path / "x.tab")).collect()] == [("1", 9, 9), ("2", 5, 8)]


def test_companions(spark, tmp_path):
    (tmp_path / "p.ped").write_text("F1 C D M 1 0 EUR\nF1 D 0 0 1 0\n")
    assert [tuple(r) for r in companions.read_ped(spark, str(tmp_path / "p.ped")).collect()] == [("F1", "C", "D", "M", 1, "EUR"), ("F1", "D", None, None, 1, None)]
    (tmp_path / "p.ploidy").write_text("X 1 60000 M 1\n* * * M 2\n* * * F 2\nY 1 100 M 1\nY 1 100 F 0\n")
    rules = companions.read_ploidy(spark, str(tmp_path / "p.ploidy"))
    gt = spark.createDataFrame([("X", 5, "M"), ("X", 70000, "M"), ("Y", 5, "F"), ("1", 1, "U")], "chrom string, pos long, sex string")
    assert sorted((r["chrom"], r["pos"], r["ploidy"]) for r in companions.ploidy_at(gt, rules).collect()) == [("1", 1, 2), ("X", 5, 1), ("X", 70000, 2), ("Y", 5, 0)]
    (tmp_path / "g.gff3").write_text("##gff-version 3\n1\ts\tgene\t1\t100\t.\t+\t.\tID=g1;Name=a%3Bb\n1\ts\tmRNA\t1\t100\t.\t+\t.\tID=t1;Parent=g1\n1\ts\texon\t50\t90\t.\t+\t.\tParent=t1\n1\ts\texon\t1\t20\t.\t+\t.\tParent=t1\n1\ts\tCDS\t5\t20\t.\t+\t0\tParent=t1\n")
    gff = companions.read_gff(spark, str(tmp_path / "g.gff3"))
    assert gff.where("type = 'gene'").first()["name"] == "a;b"
    m = companions.gene_model(gff).first()
    assert m["gene"] == "g1" and [tuple(e) for e in m["exons"]] == [(1, 20), (50, 90)] and [tuple(e) for e in m["cds"]] == [(5, 20)]
    (tmp_path / "t.tsv").write_text("rs1\t1\t10\tAC\nrs2\t1\t11\t--\nrs3\t1\t12\tII\n")
    t = companions.letters_to_genotype(companions.read_tsv(spark, str(tmp_path / "t.tsv"), "ID,CHROM,POS,AA").withColumn("ref", F.lit("A")))
    assert [(r["id"], r["alts"], r["alleles"]) for r in t.collect()] == [("rs1", ["C"], [0, 1]), ("rs2", [], [None, None])]


def test_fasta_and_consensus(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">1 description\nACGT\nACGT\n>2:101-104 x\nGGCC\n")
    ref = companions.read_fasta(spark, str(tmp_path / "r.fa"))
    assert sorted(tuple(r) for r in ref.collect()) == [("1", 1, "ACGTACGT"), ("2", 101, "GGCC")]
    assert C.apply_variants("ACGTACGT", 1, [(2, "C", "TT"), (7, "G", "A")]) == "ATTGTACAT"
    with pytest.raises(C.ReferenceMismatch):
        C.apply_variants("ACGT", 1, [(2, "G", "A")])
    v = spark.createDataFrame([("1", 2, "C", "TT"), ("1", 7, "G", "A")], "chrom string, pos long, ref string, alt string")
    seq = C.consensus_of(ref.where("chrom = '1'"), v)
    assert seq.first()["seq"] == "ATTGTACAT"
    assert [r["line"] for r in C.fasta_lines(seq, 4).orderBy("nth").collect()] == [">1", "ATTG", "TACA", "T"]
    s = spark.createDataFrame([("1", 3), ("1", 8)], "chrom string, pos long")
    assert [r["base"] for r in C.bases_at(s, ref).orderBy("pos").collect()] == ["G", "T"]


def test_gen_and_hap(spark):
    lines = spark.createDataFrame([("1:5_A_C 1:5_A_C 5 A C 0.1 0.8 0.1 1.0 0.0 0.0",)], "line string")
    assert [(r["pos"], r["sample_id"], r["gt"]) for r in companions.parse_gen(lines).collect()] == [(5, 1, "0/1"), (5, 2, "0/0")]
    h = spark.createDataFrame([("0", "1"), ("0*", "1*"), ("?", "?"), ("1", "-")], "a string, b string")
    assert [r[0] for r in h.select(companions.hap_to_gt(F.col("a"), F.col("b"))).collect()] == ["0|1", "0/1", ".|.", "1"]
