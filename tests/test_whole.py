"""Queries over all rows of a size at which every chunk and sample has some, against plain Python."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from siteloom.plans.relations import genotypes, sites

SF = "/root/testdata/sf0.01"


def test_check_ploidy_reads_all_samples(spark):
    g = genotypes(spark, SF).where(F.exists("alleles", lambda a: a.isNotNull())).join(sites(spark, SF).select("site_id", "chrom", "pos"), "site_id")
    want, last = [], None
    for r in sorted(g.select("sample", "chrom", "pos", "site_id", F.size("alleles").alias("p")).collect()):
        if last != (r["sample"], r["chrom"], r["p"]):
            last = r["sample"], r["chrom"], r["p"]
            want.append([*last, r["pos"], r["pos"], 0])
        want[-1][4:] = r["pos"], want[-1][5] + 1
    got = entry.queries()["check_ploidy"](spark, SF).select("sample", "chrom", "ploidy", "start", "end", "n").collect()
    assert sorted(map(list, got)) == sorted(want)
    assert {(w[0], w[2]) for w in want} == {(f"S{i}", 1 if i == 7 else 2) for i in range(1, 8)}


def test_consensus_applies_all_snps(spark):
    rows = sites(spark, SF).where("length(ref) = 1 and size(alts) > 0").select("chrom", "pos", "alts").collect()
    want: dict[str, list[str]] = {}
    snps: dict = {}
    for r in rows:
        if all(len(a) == 1 for a in r["alts"]):
            at = r["chrom"], r["pos"]
            snps[at] = min(snps.get(at, "Z"), r["alts"][0])
    for chrom in {c for c, _ in snps}:
        want[chrom] = ["ACGT"[p % 4] for p in range(1, 100001)]
    for (chrom, pos), alt in snps.items():
        want[chrom][pos - 1] = alt
    assert any(pos > 1 << 16 for _, pos in snps)
    got = {r["chrom"]: r["seq"] for r in entry.queries()["consensus"](spark, SF).collect()}
    assert got == {c: "".join(s) for c, s in want.items()}


def test_header_of_any_length(spark, tmp_path):
    from siteloom.sources.vcf import read_header

    meta = ["##fileformat=VCFv4.2", *(f"##contig=<ID=c{i}>" for i in range(100_001)), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA", "c1\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1"]
    (tmp_path / "a.vcf").write_text("\n".join(meta) + "\n")
    assert list(read_header(spark, str(tmp_path / "a.vcf")).samples) == ["A"]


def test_prune_is_the_plain_walk(spark):
    from siteloom.operators.models import prune

    s = sites(spark, SF)
    rows = sorted((r["chrom"], r["pos"], r["site_id"], r["qual"] or 0.0) for r in s.select("chrom", "pos", "site_id", "qual").collect())
    for keep in ("first", "maxqual"):
        held, gone, last = [], set(), None
        for chrom, pos, name, q in rows:
            held = [h for h in held if pos - h[0] < 100] if chrom == last else []
            last = chrom
            held.append((pos, q, name))
            if len(held) > 2:
                out = held[-1] if keep == "first" else min(held, key=lambda h: (h[1], -h[0]))
                held.remove(out)
                gone.add(out[2])
        assert {r["site_id"] for r in prune(s, 100, 2, keep).select("site_id").collect()} == {r[2] for r in rows} - gone
