"""VCF text as a frame of sites and back.

Lines are split by Spark's own text reader, so plain files are read in parallel by byte ranges and through any file system that Spark knows. Compressed files
are read whole each; ``bgzf`` reads block-compressed ones in parallel. INFO and FORMAT stay maps of texts; their types are in the header.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions.lets import let
from siteloom.sources.header import Header, parse_header
from siteloom.sources.scratch import scratch_path

SAMPLES = "array<struct<sample:string,gt_raw:string,alleles:array<int>,phased:boolean,fmt:map<string,array<string>>>>"


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a file, or of the first of several in name order. Only meta lines are gathered, and of other files nothing is read."""
    names = sorted(spark.read.text(path).inputFiles())
    plain = len(names) > 1 and not any("%" in n for n in names)
    lines = []
    for name in names if plain else [path]:
        for r in spark.read.text(name).where(F.col("value").startswith("#")).toLocalIterator():
            lines.append(r["value"].rstrip("\r"))
            if lines[-1].startswith("#CHROM"):
                return parse_header(lines)
    return parse_header(lines)


def _dot(c: Column) -> Column:
    return F.when(c != ".", c)


def _listed(c: Column, sep: str) -> Column:
    return F.when(c.isin(".", ""), F.array().cast("array<string>")).otherwise(F.split(c, sep))


def parse_info(text: Column) -> Column:
    """Map of tag to texts; a flag's is empty. Of repeated tags the first counts."""
    items = F.filter(F.split(text, ";"), lambda x: ~x.isin("", "."))
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.split(F.substring(x, F.instr(x, "=") + 1, F.length(x)), ",")).otherwise(F.array().cast("array<string>")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(pairs, lambda p: p["k"] == k), F.lit(0))["v"])))


def render_info(info: Column) -> Column:
    items = F.transform(F.map_entries(info), lambda e: F.when(F.size(e["value"]) == 0, e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, ".").otherwise(F.array_join(items, ";"))


def _samples(fields: Column, keys: Column, names: list[str]) -> Column:
    def one(name: Column, i: Column) -> Column:
        return let(F.split(F.get(fields, i + 9), ":"), lambda values: of(name, values))

    def of(name: Column, values: Column) -> Column:
        fmt = F.map_from_arrays(keys, F.transform(keys, lambda _, j: F.split(F.coalesce(F.get(values, j), F.lit(".")), ",")))
        at = F.array_position(keys, "GT").cast("int")
        raw = F.when(at > 0, F.get(values, at - 1))
        return F.struct(name.alias("sample"), raw.alias("gt_raw"), F.coalesce(G.parse(raw), F.array(F.lit(None).cast("int"))).alias("alleles"), F.coalesce(G.is_phased(raw), F.lit(False)).alias("phased"), fmt.alias("fmt"))

    return F.transform(F.array(*map(F.lit, names)), one)


def parse_lines(lines: DataFrame, header: Header, input_id: int = 0) -> DataFrame:
    """``lines`` (value, ord) to sites in canonical columns; records with too few fields are an error."""
    f = F.col("f")
    rank = F.map_from_arrays(F.array(*map(F.lit, header.contigs)), F.array(*map(F.lit, range(len(header.contigs))))) if header.contigs else None
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("f", F.split(F.regexp_replace("value", "\r$", ""), "\t"))
    rows = rows.withColumn("f", F.when(F.size("f") >= 8, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a record has fewer than 8 fields: "), F.substring("value", 1, 80)))))
    info = parse_info(f[7])
    out = rows.select(
        F.lit(input_id).alias("input_id"), F.col("ord").alias("site_id"), f[0].alias("chrom"),
        (F.coalesce(F.try_element_at(rank, f[0]), F.lit(len(header.contigs))) if rank is not None else F.lit(0)).alias("contig_rank"),
        f[1].cast("long").alias("pos"), _dot(f[2]).alias("id"), f[3].alias("ref"), _listed(f[4], ",").alias("alts"), _dot(f[5]).cast("double").alias("qual"), _listed(f[6], ";").alias("filters"), info.alias("info"), "f",
    )
    end = F.get(F.try_element_at("info", F.lit("END")), F.lit(0)).try_cast("long")
    out = out.withColumn("end", end)
    if header.samples:
        out = out.withColumn("format", F.split(f[8], ":")).withColumn("samples", _samples(f, F.col("format"), list(header.samples)))
    else:
        out = out.withColumn("format", F.array().cast("array<string>")).withColumn("samples", F.array().cast(SAMPLES))
    return out.drop("f")


def read_vcf(spark: SparkSession, path: str, input_id: int = 0) -> tuple[Header, DataFrame]:
    """Header and sites of a VCF file (plain or gzip). ``site_id`` grows in file order within an input."""
    header = read_header(spark, path)
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return header, parse_lines(lines, header, input_id)


def explode_samples(sites: DataFrame) -> DataFrame:
    """A row for each site and sample."""
    return sites.select("site_id", F.posexplode("samples").alias("sample_id", "s")).select("site_id", (F.col("sample_id") + 1).alias("sample_id"), "s.*")


def render_lines(sites: DataFrame, header: Header) -> DataFrame:
    """``line`` of each site."""
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    qual = F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("decimal(20,0)").cast("string")).otherwise(F.col("qual").cast("string"))
    parts = [F.col("chrom"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), dot(F.array_join("alts", ",")), dot(qual), dot(F.array_join("filters", ";")), render_info(F.col("info"))]
    if header.samples:
        value = lambda s, k: F.when(k == "GT", F.coalesce(G.render(s["alleles"], s["phased"]), F.lit("."))).otherwise(F.coalesce(F.array_join(F.try_element_at(s["fmt"], k), ","), F.lit(".")))
        parts.append(F.array_join("format", ":"))
        parts.append(F.array_join(F.transform("samples", lambda s: F.array_join(F.transform("format", lambda k: value(s, k)), ":")), "\t"))
    return sites.select("contig_rank", "pos", "ref", "alts", "site_id", F.concat_ws("\t", *parts).alias("line"))


@contextmanager
def ordered_lines(sites: DataFrame, header: Header) -> Iterator[DataFrame]:
    """``line`` of each site, in partitions by ranges of position. Ranges are found by a pass of its own, so lines are kept in the shared folder in between."""
    spark, path = sites.sparkSession, scratch_path(sites.sparkSession, "lines")
    render_lines(sites, header).write.parquet(path)
    try:
        yield spark.read.parquet(path).repartitionByRange("contig_rank", "pos").sortWithinPartitions("contig_rank", "pos", F.lower("ref"), F.lower(F.array_join("alts", ",")), "site_id").select("line")
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_vcf(sites: DataFrame, header: Header, path: str, ordered: bool = True, compression: str | None = None) -> None:
    """Part files in position order under ``path``, the header in a first one of its own; together in name order they are one VCF file."""
    options = {"compression": compression} if compression else {}
    with ordered_lines(sites, header) if ordered else nullcontext(render_lines(sites, header)) as lines:
        lines.select("line").write.options(**options).text(path)
    jvm, conf = sites.sparkSession.sparkContext._jvm, sites.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-00-header.vcf")
    out = where.getFileSystem(conf).create(where)
    try:
        out.write(("\n".join(header.lines()) + "\n").encode())
    finally:
        out.close()
