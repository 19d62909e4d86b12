"""A Parquet store of sites: partitioned by contig and position bin, so that a region reads its partitions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases in a position bin.
BIN = 1 << 22


def write_store(sites: DataFrame, path: str) -> None:
    """Sorted within partitions by position, so that row-group statistics prune within a bin too."""
    d = sites.withColumn("pos_bin", F.floor(F.col("pos") / BIN).cast("int"))
    d.repartition("chrom", "pos_bin").sortWithinPartitions("chrom", "pos_bin", "pos").write.partitionBy("chrom", "pos_bin").parquet(path)


def query_region(spark: SparkSession, path: str, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Sites whose position lies in a region; partition and row-group pruning do what an index would."""
    d = spark.read.parquet(path).where(F.col("chrom") == chrom)
    if start is not None:
        d = d.where((F.col("pos_bin") >= start // BIN) & (F.col("pos") >= start))
    if end is not None:
        d = d.where((F.col("pos_bin") <= end // BIN) & (F.col("pos") <= end))
    return d.drop("pos_bin")


def contig_statistics(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """(chrom, n), zeros for contigs without records if a list is given."""
    n = spark.read.parquet(path).groupBy("chrom").agg(F.count("*").alias("n"))
    if contigs is None:
        return n
    return spark.createDataFrame([(c,) for c in contigs], "chrom string").join(n, "chrom", "left").select("chrom", F.coalesce("n", F.lit(0)).alias("n"))
