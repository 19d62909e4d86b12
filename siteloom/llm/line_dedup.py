"""Removal of passages that repeat across documents, by overlapping windows of three lines.

Native: every step is a DataFrame expression. Only window hashes are shuffled in bulk; texts move
once, to meet the positions to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch

#: Lines in a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(docs: DataFrame) -> DataFrame:
    """(_sl_doc, _sl_text, _sl_pos, _sl_a, _sl_b): a 128-bit hash for each window that isn't blank throughout."""
    lines = docs.select(
        F.col("doc_id").alias("_sl_doc"),
        F.xxhash64("text").alias("_sl_text"),
        F.transform(_lines(F.col("text")), lambda x: F.trim(x)).alias("l"),
    ).where(F.size("l") >= WINDOW)

    def window(i: Column) -> Column:
        part = [F.col("l")[i + k] for k in range(WINDOW)]
        blank = part[0] == ""
        for p in part[1:]:
            blank = blank & (p == "")
        a = F.xxhash64(*part)
        return F.when(~blank, F.struct(i.cast("int").alias("_sl_pos"), a.alias("_sl_a"), F.xxhash64(*part[::-1], F.lit(WINDOW)).alias("_sl_b")))

    made = F.filter(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window), lambda x: x.isNotNull())
    return lines.select("_sl_doc", "_sl_text", F.inline(made))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, report: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later occurrences of repeated three-line windows taken out.

    A window is three consecutive lines, compared without spaces at their ends; windows of three
    blank lines don't count. Of equal windows in all documents the first by (doc_id, text hash,
    position) stays; the lines that later ones cover are merged into spans and removed.
    n_chars, where there, follows the text. With ``report``, ``n_lines``, ``n_removed`` and ``spans``
    (first line, last line; from 0) are added, replacing columns of those names.

    Null text: stays null, 0 lines. Empty text or fewer than three lines: unchanged. Null doc_id:
    sorts first. Rows that agree in doc_id and text count as one document and get the same text.
    Other columns pass through unchanged. A document that repeats wholly keeps its row, with empty text.
    """
    with Scratch(spark, "lines") as scratch:
        found = _windows(docs)
        first = (
            found.groupBy("_sl_a", "_sl_b")
            .agg(F.min(F.struct("_sl_doc", "_sl_text", "_sl_pos")).alias("_sl_first"), F.count("*").alias("_sl_n"))
            .where("_sl_n > 1")
            .select("_sl_a", "_sl_b", "_sl_first")
        )
        first = scratch.cut(first, "first")
        later = (
            found.join(first, ["_sl_a", "_sl_b"])
            .where(~F.struct("_sl_doc", "_sl_text", "_sl_pos").eqNullSafe(F.col("_sl_first")))
            .groupBy(F.col("_sl_doc").alias("_sl_d"), F.col("_sl_text").alias("_sl_t"))
            .agg(F.array_sort(F.collect_set("_sl_pos")).alias("_sl_p"))
        )
        later = Scratch(spark, "lines").keep(later, "later")
    return _without(docs, later, report)


def _without(docs: DataFrame, later: DataFrame, report: bool) -> DataFrame:
    p = F.col("_sl_p")
    starts = F.filter(p, lambda x, i: (i == 0) | (x > F.get(p, i - 1) + WINDOW))
    ends = F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + WINDOW)), lambda x: x + WINDOW - 1)
    spans = F.arrays_zip(starts.alias("first"), ends.alias("last"))
    # by shuffle at every size: what is removed grows with the input
    out = docs.join(later.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_sl_d")) & (F.xxhash64(docs["text"]) == F.col("_sl_t")), "left")
    out = out.withColumn("_sl_spans", F.when(p.isNotNull(), spans))
    s, lines = F.col("_sl_spans"), _lines(F.col("text"))
    # what stays: the lines before each span, and those after the last
    begins = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["last"] + 1))
    stops = F.concat(F.transform(s, lambda x: x["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice(lines, a + 1, b - a)))
    text = F.when(s.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = out.select(*(F.col(c) for c in docs.columns if c != "text"), F.col("text").alias("_sl_was"), text.alias("text"), "_sl_spans")
    columns = {c: F.col(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(s.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    if report:
        columns |= {
            "n_lines": F.when(F.col("_sl_was").isNull(), 0).otherwise(F.size(_lines(F.col("_sl_was")))).cast("long"),
            "n_removed": F.when(s.isNull(), 0).otherwise(F.aggregate(s, F.lit(0), lambda n, x: n + x["last"] - x["first"] + 1)).cast("long"),
            "spans": F.coalesce(s, F.array().cast("array<struct<first:int,last:int>>")),
        }
    return out.select(*(v.alias(k) for k, v in columns.items()))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_lines(spark, docs, report=True).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, i, trim(ls[i]) AS a, trim(ls[i + 1]) AS b, trim(ls[i + 2]) AS c FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM k WHERE a <> '' OR b <> '' OR c <> ''),
cov AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE nth > 1),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS j FROM l),
y AS (SELECT x.doc_id, coalesce(string_agg(x.line, chr(10) ORDER BY x.j) FILTER (cov.j IS NULL), '') AS text, count(cov.j) AS n_removed, count(*) AS n_lines
      FROM x LEFT JOIN cov ON x.doc_id = cov.doc_id AND x.j = cov.j GROUP BY x.doc_id)
SELECT d.doc_id, y.text, CAST(coalesce(y.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(y.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN y ON d.doc_id = y.doc_id
"""
