"""Variant relations derived from the star-schema tables: sites from orders, genotypes from lineitem.

``site``: site_id, chrom, contig_rank, pos, id, ref, alts, qual, filters, dp, end.
``gt``: site_id, sample_id, sample, alleles (null = missing), phased, dp, ad, gq; clustered by site_id, so that what follows by site
needs no further shuffle.

``BASE`` holds the same relations as DuckDB SQL for the oracles, with alleles as a0, a1 and ploidy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 7
#: Bases of a contig: sites lie from 1 to it.
CONTIG = 100000
#: Bytes of a table's files that a task takes after a shuffle, at most.
PLACE = 1 << 22


def _kind(k: Column) -> Column:
    out = F.lit("snp")
    for n, name in ((7, "ins"), (13, "del"), (17, "mnp"), (19, "none"), (23, "sym")):
        out = F.when(k % n == 0, name).otherwise(out)
    return out


def _base(at: Column) -> Column:
    return F.substring(F.lit("ACGT"), (1 + at % 4).cast("int"), F.lit(1))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind, b, other = _kind(k), _base(k), _base(k + 1 + c % 3)
    alts = (
        F.when(kind == "sym", F.array(F.lit("<DEL>")))
        .when(kind == "none", F.array().cast("array<string>"))
        .when(kind == "mnp", F.array(F.concat(other, F.lit("T"))))
        .when(kind == "del", F.array(b))
        .when(kind == "ins", F.array(F.concat(b, F.lit("TT"))))
        .when(k % 11 == 0, F.array(other, _base(k + 1 + (c + 1) % 3)))
        .otherwise(F.array(other))
    )
    pos = 1 + (k * 37) % 100000
    return o.select(
        k.alias("site_id"),
        F.concat(F.lit("chr"), (1 + c % 5).cast("string")).alias("chrom"),
        (1 + c % 5).cast("int").alias("contig_rank"),
        pos.alias("pos"),
        F.when(k % 3 == 0, F.concat(F.lit("rs"), k.cast("string"))).alias("id"),
        F.when(kind == "del", F.concat(b, F.lit("AC"))).when(kind == "mnp", F.concat(b, F.lit("G"))).otherwise(b).alias("ref"),
        alts.alias("alts"),
        F.when(k % 29 != 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("qual"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("PASS"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("LowQual"))).otherwise(F.array(F.lit("LowQual"), F.lit("q10"))).alias("filters"),
        (c % 60).cast("int").alias("dp"),
        F.when(kind == "sym", pos + 10 + k % 50).alias("end"),
    )


def _clustered(table: DataFrame, key: str) -> DataFrame:
    """Rows by ``key``, in places whose number grows with the table, so that a task's memory doesn't. Small tables are left to Spark, which joins their places."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // PLACE)
    return table.repartition(n, key) if n > table.sparkSession.sparkContext.defaultParallelism else table.repartition(key)


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _clustered(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    g = g.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("dp"))
    k, p, s, kind = F.col("l_orderkey"), F.col("p"), F.col("s"), _kind(F.col("l_orderkey"))

    def allele(x: Column, missing: int) -> Column:
        return F.when(x % missing == 0, None).when(kind == "none", 0).when((kind == "snp") & (k % 11 == 0) & (x % 5 == 1), 2).otherwise((x % 2).cast("int"))

    first, second = allele(p, 10), allele(s, 12)
    alt_reads = F.expr("cast(dp * (s % 4) div 4 as int)")
    return g.select(
        k.alias("site_id"),
        F.col("l_linenumber").cast("int").alias("sample_id"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("sample"),
        F.when(F.col("l_linenumber") == SAMPLES, F.array(first)).otherwise(F.array(first, second)).alias("alleles"),
        (s % 3 == 0).alias("phased"),
        "dp",
        F.array(F.col("dp") - alt_reads, alt_reads).alias("ad"),
        ((p * 7 + s) % 100).cast("int").alias("gq"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals (name, chrom, start, end) from parts: one for each part, of its size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    start = 1 + (F.col("p_partkey") * 61) % 100000
    return p.select(F.col("p_partkey").alias("name"), F.concat(F.lit("chr"), (1 + F.expr("p_partkey div 20") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("p_size")).alias("end"))


def second_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second call set over the same sites: two thirds of them, an eighth with another ALT."""
    s = sites(spark, sf_dir).where("site_id % 3 <> 0")
    return s.withColumn("alts", F.when(F.col("site_id") % 8 == 1, F.array(F.concat("ref", F.lit("GG")))).otherwise(F.col("alts"))).withColumn("dp", F.col("dp") + 7)


BASE = """
WITH k AS (SELECT *, CASE WHEN o_orderkey % 23 = 0 THEN 'sym' WHEN o_orderkey % 19 = 0 THEN 'none' WHEN o_orderkey % 17 = 0 THEN 'mnp'
    WHEN o_orderkey % 13 = 0 THEN 'del' WHEN o_orderkey % 7 = 0 THEN 'ins' ELSE 'snp' END AS kind,
  substr('ACGT', 1 + o_orderkey % 4, 1) AS b, substr('ACGT', 1 + (o_orderkey + 1 + o_custkey % 3) % 4, 1) AS b2,
  substr('ACGT', 1 + (o_orderkey + 1 + (o_custkey + 1) % 3) % 4, 1) AS b3, 1 + (o_orderkey * 37) % 100000 AS p FROM orders),
site AS (SELECT o_orderkey AS site_id, 'chr' || (1 + o_custkey % 5) AS chrom, CAST(1 + o_custkey % 5 AS INT) AS contig_rank, p AS pos,
  CASE WHEN o_orderkey % 3 = 0 THEN 'rs' || o_orderkey END AS id,
  CASE kind WHEN 'del' THEN b || 'AC' WHEN 'mnp' THEN b || 'G' ELSE b END AS ref,
  CASE kind WHEN 'sym' THEN ['<DEL>'] WHEN 'none' THEN []::VARCHAR[] WHEN 'mnp' THEN [b2 || 'T'] WHEN 'del' THEN [b] WHEN 'ins' THEN [b || 'TT']
    ELSE CASE WHEN o_orderkey % 11 = 0 THEN [b2, b3] ELSE [b2] END END AS alts,
  CASE WHEN o_orderkey % 29 <> 0 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS qual,
  CASE o_orderstatus WHEN 'F' THEN ['PASS'] WHEN 'O' THEN ['LowQual'] ELSE ['LowQual', 'q10'] END AS filters,
  CAST(o_custkey % 60 AS INT) AS dp, CASE WHEN kind = 'sym' THEN p + 10 + o_orderkey % 50 END AS "end", kind FROM k),
g0 AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS INT) AS dp,
  CASE WHEN l_orderkey % 23 = 0 THEN 'sym' WHEN l_orderkey % 19 = 0 THEN 'none' WHEN l_orderkey % 17 = 0 THEN 'mnp' WHEN l_orderkey % 13 = 0 THEN 'del' WHEN l_orderkey % 7 = 0 THEN 'ins' ELSE 'snp' END AS kind
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
gt AS (SELECT l_orderkey AS site_id, CAST(l_linenumber AS INT) AS sample_id, 'S' || l_linenumber AS sample,
  CASE WHEN p % 10 = 0 THEN NULL WHEN kind = 'none' THEN 0 WHEN kind = 'snp' AND l_orderkey % 11 = 0 AND p % 5 = 1 THEN 2 ELSE CAST(p % 2 AS INT) END AS a0,
  CASE WHEN l_linenumber = 7 OR s % 12 = 0 THEN NULL WHEN kind = 'none' THEN 0 WHEN kind = 'snp' AND l_orderkey % 11 = 0 AND s % 5 = 1 THEN 2 ELSE CAST(s % 2 AS INT) END AS a1,
  CASE WHEN l_linenumber = 7 THEN 1 ELSE 2 END AS ploidy, s % 3 = 0 AS phased, dp,
  dp - CAST(dp * (s % 4) // 4 AS INT) AS ad0, CAST(dp * (s % 4) // 4 AS INT) AS ad1, CAST((p * 7 + s) % 100 AS INT) AS gq FROM g0),
al AS (SELECT site_id, sample_id, a0 AS a FROM gt UNION ALL SELECT site_id, sample_id, a1 FROM gt WHERE ploidy = 2),
region AS (SELECT p_partkey AS name, 'chr' || (1 + p_partkey // 20 % 5) AS chrom, 1 + (p_partkey * 61) % 100000 AS start, 1 + (p_partkey * 61) % 100000 + p_size AS "end" FROM part),
site2 AS (SELECT * REPLACE (CASE WHEN site_id % 8 = 1 THEN [ref || 'GG'] ELSE alts END AS alts, dp + 7 AS dp) FROM site WHERE site_id % 3 <> 0)
"""
