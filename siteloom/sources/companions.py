"""Region lists, pedigrees, ploidy and sample files, FASTA, GFF3, and tab-separated genotypes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.consensus import CHUNK

_REGION = re.compile(r"^(?:\{(?P<braced>[^}]+)\}|(?P<chrom>[^:]+))(?::(?P<start>[\d,]+)?(?P<dash>-)?(?P<end>[\d,]+)?)?$")
REGION = "chrom string, start long, end long, name string"


class RegionError(ValueError):
    pass


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """``chr``, ``chr:pos``, ``chr:from-to``, ``chr:from-``; contigs with colons in braces. 1-based, inclusive; None is unbounded."""
    m = _REGION.match(text)
    if not m:
        raise RegionError(f"bad region {text!r}")
    number = lambda x: int(x.replace(",", "")) if x else None
    start, end = number(m["start"]), number(m["end"])
    if start is not None and not m["dash"]:
        end = start
    if start is not None and end is not None and end < start:
        raise RegionError(f"region {text!r} ends before it starts")
    return m["braced"] or m["chrom"], start, end


def region_list(spark: SparkSession, text: str) -> DataFrame:
    rows = [(*parse_region(x), None) for x in text.split(",")]
    return spark.createDataFrame(rows, REGION)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated regions: 0-based half-open for names that begin or end with bed, else 1-based (chrom, pos) or (chrom, from, to)."""
    bed = re.search(r"\.bed(\.gz)?$", path) is not None
    f = F.split("value", r"[\t ]+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|track|browser|$)"))
    start = F.get(f, F.lit(1)).cast("long") + (1 if bed else 0)
    end = F.coalesce(F.get(f, F.lit(2)).try_cast("long"), start)
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), start.alias("start"), end.alias("end"), F.get(f, F.lit(3)).alias("name"))


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """(family, child, father, mother, sex, population) of a pedigree; absent parents are null."""
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    who = lambda i: F.when(~at(i).isin("0", "."), at(i))
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(at(0).alias("family"), at(1).alias("child"), who(2).alias("father"), who(3).alias("mother"), at(4).try_cast("int").alias("sex"), at(6).alias("population"))


def read_ploidy(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, sex, ploidy); ``*`` contigs hold the defaults by sex, with null bounds."""
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(at(0).alias("chrom"), at(1).try_cast("long").alias("start"), at(2).try_cast("long").alias("end"), at(3).alias("sex"), at(4).cast("int").alias("ploidy"))


def ploidy_at(gt: DataFrame, rules: DataFrame, default: int = 2) -> DataFrame:
    """``gt`` (chrom, pos, sex, ...) with ``ploidy``: of the interval it lies in, else the sex's default, else ``default``."""
    inside = rules.where("chrom <> '*'").select("chrom", F.col("start").alias("_s"), F.col("end").alias("_e"), "sex", F.col("ploidy").alias("_p"))
    star = rules.where("chrom = '*'").select("sex", F.col("ploidy").alias("_d"))
    cond = (F.col("g.chrom") == F.col("r.chrom")) & (F.col("g.sex") == F.col("r.sex")) & F.col("pos").between(F.col("_s"), F.col("_e"))
    out = gt.alias("g").join(inside.alias("r"), cond, "left").select("g.*", "_p").join(star, "sex", "left")
    return out.withColumn("ploidy", F.coalesce("_p", "_d", F.lit(default))).drop("_p", "_d")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, chunk_start, bases): a reference in chunks. A header ``name:from-to`` places its sequence; sequences are gathered by contig."""
    lines = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = lines.where("value <> ''").select(F.regexp_extract(head, r"^(.*?)(?::(\d+)-\d+)?$", 1).alias("chrom"), F.coalesce(F.regexp_extract(head, r":(\d+)-\d+$", 1).try_cast("long"), F.lit(1)).alias("first"), seq.alias("seq"))
    cut = rows.select("chrom", "first", F.posexplode(F.expr(f"transform(sequence(0, greatest(0, cast((length(seq) - 1) div {CHUNK} as int))), i -> substring(seq, i * {CHUNK} + 1, {CHUNK}))")).alias("i", "bases"))
    return cut.select("chrom", (F.col("first") + F.col("i").cast("long") * CHUNK).alias("chunk_start"), "bases")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, source, type, start, end, strand, phase, id, parent, name, attributes) of GFF3."""
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) == 9)).select(F.explode(F.array(f)).alias("f"))
    tags = F.str_to_map(F.col("f")[8], F.lit(";"), F.lit("="))
    tag = lambda k: decode(F.try_element_at(tags, F.lit(k)))
    c = lambda i: F.when(F.col("f")[i] != ".", F.col("f")[i])
    return rows.select(c(0).alias("chrom"), c(1).alias("source"), c(2).alias("type"), c(3).cast("long").alias("start"), c(4).cast("long").alias("end"), c(6).alias("strand"), c(7).try_cast("int").alias("phase"), tag("ID").alias("id"), tag("Parent").alias("parent"), tag("Name").alias("name"), tags.alias("attributes"))


def gene_model(gff: DataFrame) -> DataFrame:
    """(gene, transcript, chrom, strand, exons, cds): each transcript with its parts in order."""
    span = F.struct("start", "end")
    parts = gff.where("type in ('exon', 'CDS')").groupBy(F.col("parent").alias("transcript")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "exon", span))).alias("exons"), F.array_sort(F.collect_list(F.when(F.col("type") == "CDS", span))).alias("cds")
    )
    made = gff.where("type in ('mRNA', 'transcript')").select(F.col("id").alias("transcript"), F.col("parent").alias("gene"), "chrom", "strand")
    return made.join(parts, "transcript", "left")


def gen_rows(gt: DataFrame, sites: DataFrame, probabilities) -> DataFrame:  # noqa: ANN001
    """(site_id, line) of three genotype probabilities for each sample of biallelic sites; the first of a position."""
    from pyspark.sql import Window

    one = sites.where(F.size("alts") == 1).withColumn("_n", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("site_id"))).where("_n = 1")
    per = gt.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", F.array_join(probabilities.cast("array<string>"), " ").alias("p")))).alias("ps"))
    marker = F.concat_ws("_", F.concat_ws(":", "chrom", F.col("pos").cast("string")), "ref", F.col("alts")[0])
    return one.join(per, "site_id").select("site_id", F.concat_ws(" ", marker, marker, F.col("pos").cast("string"), "ref", F.col("alts")[0], F.array_join(F.transform("ps", lambda x: x["p"]), " ")).alias("line"))


def parse_gen(lines: DataFrame) -> DataFrame:
    """(marker, chrom, pos, ref, alt, sample_id, gt): the likeliest of three, the first of equal ones."""
    f = F.split("line", " ")
    rows = lines.select(f[0].alias("marker"), F.substring_index(f[0], ":", 1).alias("chrom"), f[2].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), F.slice(f, 6, F.size(f)).cast("array<double>").alias("p"))
    each = F.transform(F.sequence(F.lit(0), (F.size("p") / 3).cast("int") - 1), lambda i: F.slice("p", i * 3 + 1, 3))
    at = lambda p: F.array_position(p, F.array_max(p)).cast("int")
    out = rows.select("marker", "chrom", "pos", "ref", "alt", F.posexplode(each).alias("i", "p3"))
    return out.select("marker", "chrom", "pos", "ref", "alt", (F.col("i") + 1).alias("sample_id"), F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), at(F.col("p3"))).alias("gt"))


def hap_to_gt(first, second):  # noqa: ANN001, ANN201
    """Two haplotype fields as a genotype text: ``? ?`` is missing, any ``*`` unphased, ``-`` haploid."""
    clean = lambda c: F.when(c == "?", ".").otherwise(F.regexp_replace(c, r"\*", ""))
    sep = F.when(first.contains("*") | second.contains("*"), "/").otherwise("|")
    return F.when(second == "-", clean(first)).otherwise(F.concat(clean(first), sep, clean(second)))


def read_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A tab-separated file with a list of column names; ``-`` skips one."""
    names = columns.split(",")
    f = F.split("value", r"\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return rows.select(*(F.get(f, F.lit(i)).alias(n.lower()) for i, n in enumerate(names) if n != "-"))


def letters_to_genotype(rows: DataFrame) -> DataFrame:
    """(chrom, pos, ref, aa) of two-letter calls to alts and alleles: REF is 0, other letters in order of their coming; insertions and deletions go."""
    keep = rows.where(~F.col("aa").rlike("[ID]"))
    letters = F.when(F.col("aa").isin("-", "--", "."), F.array().cast("array<string>")).otherwise(F.filter(F.split("aa", ""), lambda x: x != ""))
    out = keep.withColumn("_l", letters).withColumn("alts", F.array_distinct(F.filter("_l", lambda x: x != F.col("ref"))))
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
    return out.withColumn("alleles", F.when(F.size("_l") == 0, none).otherwise(F.transform("_l", lambda x: F.when(x == F.col("ref"), 0).otherwise(F.array_position("alts", x).cast("int"))))).drop("_l")
