"""Mixing sources to target weights: an exact cut of each source in a reproducible random order.

Native. Documents are ordered within their source by a hash of doc_id; the order is cut into
equal ranges of hash values, so that the prefix sums need sums by (source, range) and the rows of one
range in each source only. A hot source is spread over all its ranges. What comes out is one
row for each source (the cut), which is joined to the documents; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch

#: Times that a document may be taken.
MOST_EPOCHS = 3
#: Weights of the sources in their order, repeated.
WEIGHTS = (1, 2, 3)
#: Rows meant to lie in one range of hash values.
RANGE_ROWS = 8192

_WORD = r"[^\x20\x09-\x0D]+"
_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    """The first 60 bits of MD5 of doc_id as text ('' if null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares of the total by weight, none above ``most`` sizes.

    Sources take ``weights`` in turn by code point, null last. The excess of a source whose share is
    above its limit goes to the others by weight until none is above: all uncapped sources stand at one level
    of target by weight. One row for each source is all that is gathered here.
    """
    last = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(last) - 1) % n + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(up), F.lit(0))).alias("left"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(up), F.lit(0))).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows)
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def cuts(scratch: Scratch, docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each source: source_size, target, whole epochs, and the document at which the rest of the budget ends."""
    rows = docs.select("source", "doc_id", _key(F.col("doc_id")).alias("key"), n_words(F.col("text")).alias("size"))
    rows = scratch.cut(rows, "sizes")
    n = rows.count()
    ranges = 1
    while ranges * range_rows < n and ranges < 1 << 30:
        ranges *= 2
    in_range = F.shiftright("key", _BITS - (ranges.bit_length() - 1))
    sums = scratch.cut(rows.groupBy("source", in_range.alias("part")).agg(F.sum("size").alias("part_size")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    goal = scratch.cut(goal, "goal")
    by = Window.partitionBy("source").orderBy("part")
    reached = sums.withColumn("upto", F.sum("part_size").over(by)).withColumn("before", F.col("upto") - F.col("part_size"))
    at = (
        goal.where("rest > 0").alias("g").join(reached.alias("s"), F.expr("g.source <=> s.source and s.before < g.rest and s.upto >= g.rest"))
        .select("g.source", "s.part", "s.before", "g.rest")
    )
    at = scratch.cut(at, "at")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    edge = (
        rows.withColumn("part", in_range).alias("r")
        .join(F.broadcast(at.alias("a")) if at.count() <= 100_000 else at.alias("a"), F.expr("r.source <=> a.source and r.part = a.part"))
        .groupBy("r.source", "key", "doc_id", "size")
        .agg(F.count("*").alias("same"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        .withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("same")).over(inside))
        .where(F.expr("upto >= rest and upto - size * same < rest"))
        .select("source", F.struct("key", "doc_id", "size").alias("edge"), F.expr("(rest - (upto - size * same)) div same").alias("edge_words"))
    )
    return goal.alias("g").join(edge.alias("e"), F.expr("g.source <=> e.source"), "left").select("g.*", "edge", "edge_words")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken, the words that the mix takes.

    Each source is taken ``epochs`` times whole, then in the order of hash keys up to the exact rest
    of its budget, floor(target) words; the document at the cut gives its first words only.
    Null text: size 0. Null source: a source of its own, last. Null doc_id: hashed as ''. Rows equal in
    source, doc_id and size that meet at the cut share what is left evenly. No rows: no rows. Columns named
    like the added ones are replaced; others pass through.
    """
    with Scratch(spark, "mix") as scratch:
        cut = Scratch(spark, "mix").keep(cuts(scratch, docs), "cuts")
    cut = cut.select(*(F.col(c).alias(f"_sl_{c}") for c in cut.columns))
    small = cut.count() <= 100_000  # one row for each source; beyond that Spark joins by shuffle
    size = n_words(F.col("text"))
    out = docs.drop("size", "source_size", "target", "taken").withColumn("_sl_n", size)
    out = out.join(F.broadcast(cut) if small else cut, F.col("source").eqNullSafe(F.col("_sl_source")), "left")
    here = F.struct(_key(F.col("doc_id")).alias("key"), F.col("doc_id"), F.col("_sl_n").alias("size"))
    more = F.when(F.col("_sl_edge").isNull() | (here > F.col("_sl_edge")), 0).when(here < F.col("_sl_edge"), F.col("_sl_n")).otherwise(F.col("_sl_edge_words"))
    return out.select(
        *(c for c in docs.columns if c not in ("size", "source_size", "target", "taken")),
        F.col("_sl_n").alias("size"),
        F.col("_sl_source_size").alias("source_size"),
        F.col("_sl_target").alias("target"),
        (F.col("_sl_epochs") * F.col("_sl_n") + more).cast("long").alias("taken"),
    )


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: a row for each whole time that a document is taken, one more with
    its first words if the cut falls within it. Documents of no words stay once; those not taken go."""
    out = mix(spark, docs.select(*docs.columns))
    rest = F.col("taken") - F.expr("taken div greatest(size, 1)") * F.col("size")
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.expr("if(size = 0, 1, cast(taken div size as int))")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn("_sl_cut", F.explode(copies))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0)), F.lit(1), F.col("_sl_cut").cast("int")), " ")
    text = F.when(F.col("_sl_cut") < 0, F.col("text")).otherwise(part)
    columns = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_sl_cut") < 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return out.select(*(v.alias(k) for k, v in columns.items()))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio FROM w),
v AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM r),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) FILTER (level <= ratio) OVER () * w) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest FROM e),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""
