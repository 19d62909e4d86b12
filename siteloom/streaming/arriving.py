"""Arriving variant shards as a stream: stateless filters and projections, windowed counts with a watermark, exactly-once table sink.

Files that come to a folder are read once each; lines of any shard with the agreed header are parsed as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.functions.expression import compile_filter, vcf_scope
from siteloom.sources.header import Header
from siteloom.sources.vcf import parse_lines


def arriving_sites(spark: SparkSession, folder: str, header: Header, files_per_trigger: int = 64) -> DataFrame:
    """A streaming frame of sites. ``site_id`` is a hash of the line, as files have no common order."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_lines(lines.withColumn("ord", F.xxhash64("value")), header).withColumn("arrived", F.current_timestamp())


def passing(sites: DataFrame, expression: str) -> DataFrame:
    return sites.where(compile_filter(expression, vcf_scope()))


def counts_by_time(sites: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Sites by arrival window and contig; state older than the watermark goes."""
    return sites.withWatermark("arrived", late).groupBy(F.window("arrived", window), "chrom").agg(F.count("*").alias("n"))


def append_to_table(sites: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table partitioned by contig; the checkpoint makes each shard count once. Ends when all that is there is read."""
    return sites.writeStream.format("parquet").partitionBy("chrom").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
