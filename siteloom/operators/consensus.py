"""Consensus sequences: variants applied to reference chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases in a reference chunk.
CHUNK = 1 << 16
#: Bases in a piece of a chunk, where a row is joined for few bases.
PIECE = 1 << 8


class ReferenceMismatch(ValueError):
    pass


def apply_variants(sequence: str, start: int, variants: list[tuple[int, str, str]]) -> str:
    """``sequence``, which begins at position ``start``, with (pos, ref, alt) applied from the right. Symbolic ALTs and ``*`` are left out.

    A REF that isn't in the sequence is an error.
    """
    for pos, ref, alt in sorted(variants, reverse=True):
        if alt.startswith("<") or alt in ("*", "."):
            continue
        at = pos - start
        if at < 0 or sequence[at : at + len(ref)].upper() != ref.upper():
            raise ReferenceMismatch(f"REF {ref} at {pos} isn't the reference's {sequence[max(at, 0) : at + len(ref)]}")
        sequence = sequence[:at] + alt + sequence[at + len(ref) :]
    return sequence


def consensus_chunks(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """``reference`` (chrom, chunk_start, bases) and ``variants`` (chrom, pos, ref, alt), none over the edge of a chunk, to (chrom, chunk_start, seq)."""
    v = variants.withColumn("chunk_start", (F.floor((F.col("pos") - 1) / CHUNK) * CHUNK + 1).cast("long"))
    per = v.groupBy("chrom", "chunk_start").agg(F.collect_list(F.struct("pos", "ref", "alt")).alias("vs"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seq = [apply_variants(b, s, [(x["pos"], x["ref"], x["alt"]) for x in vs] if vs is not None else []) for b, s, vs in zip(p["bases"], p["chunk_start"], p["vs"], strict=True)]
            yield p[["chrom", "chunk_start"]].assign(seq=seq)

    return reference.join(per, ["chrom", "chunk_start"], "left").mapInPandas(run, "chrom string, chunk_start long, seq string")


def consensus_of(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """(chrom, seq): chunks in order as one sequence for each contig."""
    c = consensus_chunks(reference, variants)
    parts = F.array_sort(F.collect_list(F.struct("chunk_start", "seq")))
    return c.groupBy("chrom").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))


def synthetic_reference(contigs: DataFrame, length: int, base: Column) -> DataFrame:
    """(chrom, chunk_start, bases) of contigs whose base at ``pos`` is an expression of it."""
    p = contigs.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(length)))).withColumn("b", base)
    p = p.withColumn("chunk_start", (F.floor((F.col("pos") - 1) / CHUNK) * CHUNK + 1).cast("long"))
    return p.groupBy("chrom", "chunk_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("bases"))


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(chrom, nth, line): a header and lines of ``width`` bases."""
    lines = F.concat(F.array(F.concat(F.lit(">"), "chrom")), F.expr(f"regexp_extract_all(seq, '.{{1,{width}}}', 0)"))
    return sequences.select("chrom", F.posexplode(lines).alias("nth", "line"))


def bases_at(sites: DataFrame, reference: DataFrame, length: int = 1) -> DataFrame:
    """Adds ``base``: ``length`` reference bases from each site's position, within its chunk. An equi-join on short pieces of chunks, so that no site carries a chunk."""
    at = F.explode(F.sequence(F.lit(0), F.lit(CHUNK - PIECE), F.lit(PIECE)))
    pieces = reference.where((F.col("chunk_start") - 1) % CHUNK == 0).select("chrom", "chunk_start", "bases", at.alias("_sl_i"))
    pieces = pieces.select("chrom", (F.col("chunk_start") + F.col("_sl_i")).cast("long").alias("_sl_at"), F.substring("bases", F.col("_sl_i") + 1, F.lit(PIECE + length - 1)).alias("_sl_bases"))
    d = sites.withColumn("_sl_at", (F.floor((F.col("pos") - 1) / PIECE) * PIECE + 1).cast("long")).join(pieces, ["chrom", "_sl_at"], "left")
    return d.withColumn("base", F.upper(F.substring("_sl_bases", (F.col("pos") - F.col("_sl_at") + 1).cast("int"), F.lit(length)))).drop("_sl_bases", "_sl_at")
