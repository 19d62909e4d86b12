"""Sinks of several outputs: by sample, by chunk, by intersection; haplotype files, reports, tables for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.operators import joins as J
from siteloom.operators.windows import scatter
from siteloom.sources.header import Header


def output_mode(text: str) -> tuple[str, int]:
    """An output type and its compression level: ``v`` text, ``z`` block-compressed text, ``b`` BCF, ``u`` BCF without compression, ``t`` tab-separated; ``z``, ``b`` and ``t`` may be followed by a level."""
    kind, level = text[:1], text[1:]
    if kind not in "vzbut" or not kind or (level and (kind not in "zbt" or not level.isdigit() or int(level) > 9)):
        raise ValueError(f"unknown output type {text!r}")
    return {"v": "vcf", "z": "vcf.gz", "b": "bcf", "u": "bcf", "t": "tsv"}[kind], int(level) if level else 0 if kind in "uvt" else 6


def write_sites(sites: DataFrame, header: Header, path: str, mode: str = "v") -> None:
    """A frame as read from VCF in the form of an output type."""
    from siteloom.sources import bcf, bgzf
    from siteloom.sources.vcf import write_vcf

    kind, level = output_mode(mode)
    if kind == "vcf":
        write_vcf(sites, header, path)
    elif kind == "vcf.gz":
        bgzf.write_vcf_gz(sites, header, path, level)
    elif kind == "bcf":
        bcf.write_bcf(sites, header, path, level)
    else:
        sites.select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.array_join("filters", ";").alias("filters")).write.option("sep", "\t").csv(path)


def split_by_sample(gt: DataFrame, path: str, groups: DataFrame | None = None) -> None:
    """Genotypes in a folder for each sample, or for each group of ``groups`` (sample, name); a sample may be in many."""
    if groups is None:
        gt.withColumn("name", F.col("sample")).write.partitionBy("name").parquet(path)
    else:
        gt.join(groups, "sample").write.partitionBy("name").parquet(path)


def scatter_to(sites: DataFrame, size: int, path: str) -> None:
    scatter(sites, size).write.partitionBy("chunk").parquet(path)


def write_intersection(inputs: list[DataFrame], path: str, n: int, mode: str = "none") -> None:
    """``sites`` (chrom, pos, what, mask) of groups in ``n`` inputs at least, and input i's records of them in ``000i``."""
    g = J.in_at_least(J.groups(inputs, mode), n)
    g.select("chrom", "pos", "what", "mask").write.parquet(f"{path}/sites")
    for i in range(len(inputs)):
        J.write_input(g, inputs, i).write.parquet(f"{path}/{i:04d}")


def write_intersection_files(inputs: list[DataFrame], headers: list[Header], path: str, n: int, mode: str = "none", output: str = "z") -> None:
    """The same as files: ``000i`` holds input i's records, ``sites`` tab-separated groups with a digit for each input, ``README.txt`` says which is which."""
    g = J.in_at_least(J.groups(inputs, mode), n)
    bits = F.concat(*(F.map_contains_key("sites", F.lit(i)).cast("int").cast("string") for i in range(len(inputs))))
    g.select("chrom", "pos", "what", bits.alias("inputs")).write.option("sep", "\t").csv(f"{path}/sites")
    for i, (d, h) in enumerate(zip(inputs, headers, strict=True)):
        write_sites(J.records_in(g, inputs, i, mode) if "info" in d.columns else d, h, f"{path}/{i:04d}", output)
    lines = ["Records of each input in groups found in enough inputs:", *(f"{i:04d}\tinput {i + 1}" for i in range(len(inputs))), "sites\tgroups, with 1 for each input that has them"]
    inputs[0].sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/README.txt")


def hap_rows(gt: DataFrame, sites: DataFrame, legend: bool = False) -> DataFrame:
    """(site_id, line) of haplotypes of biallelic sites; with ``legend`` (site_id, legend, line) with the site apart."""
    one = sites.where(F.size("alts") == 1)
    per = gt.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", G.hap_pair(F.col("alleles"), F.col("phased")).alias("h")))).alias("hs"))
    marker = F.concat_ws("_", F.concat_ws(":", "chrom", F.col("pos").cast("string")), "ref", F.col("alts")[0])
    haps = F.array_join(F.transform("hs", lambda x: x["h"]), " ")
    d = one.join(per, "site_id")
    where = F.concat_ws(" ", marker, F.col("pos").cast("string"), "ref", F.col("alts")[0])
    return d.select("site_id", where.alias("legend"), haps.alias("line")) if legend else d.select("site_id", F.concat_ws(" ", "chrom", where, haps).alias("line"))


def tall(section: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """A statistics frame as (section, id, key, value), for one table of all sections."""
    values = [c for c in df.columns if c not in keys]
    who = F.concat_ws("\t", *(F.coalesce(F.col(k).cast("string"), F.lit(".")) for k in keys)) if keys else F.lit("0")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in values)))
    return df.select(F.lit(section).alias("section"), who.alias("id"), pairs.alias("p")).select("section", "id", "p.*")


def site_cards(sites: DataFrame) -> DataFrame:
    """(site_id, card): a boxed text for each site, for reading."""
    rows = [("Position", F.concat_ws(":", "chrom", F.col("pos").cast("string"))), ("ID", F.coalesce("id", F.lit("."))), ("REF", F.col("ref")), ("ALT", F.array_join("alts", ",")), ("QUAL", F.coalesce(F.col("qual").cast("string"), F.lit("."))), ("FILTER", F.array_join("filters", ";"))]
    width = F.greatest(*(F.length(v) for _, v in rows), F.lit(1))
    edge = F.concat(F.lit("+----------+-"), F.repeat(F.lit("-"), width), F.lit("-+"))
    lines = [F.concat(F.lit(f"| {k:<8} | "), F.rpad(v, width, F.lit(" ")), F.lit(" |")) for k, v in rows]
    return sites.select("site_id", F.concat_ws("\n", edge, *lines, edge).alias("card"))
