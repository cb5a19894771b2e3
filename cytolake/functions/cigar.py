"""CIGAR strings as native expressions: no UDF, so scans stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLOCK = "array<struct<start:int,end:int>>"


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>>; null for a null CIGAR, empty for `*`."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(1)), lambda x: x.cast("int"))
    kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(2))
    return F.zip_with(kinds, lengths, lambda op, n: F.struct(op.alias("op"), n.alias("len")))


def _walk(ops: Column, pos: Column, keep: tuple[str, ...]) -> Column:
    """Reference intervals of the ops in keep; M, D, N, = and X advance the reference."""
    zero = F.struct(pos.cast("int").alias("at"), F.array().cast(BLOCK).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["len"]
        grown = F.when(x["op"].isin(*keep), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(F.when(x["op"].isin("M", "D", "N", "=", "X"), end).otherwise(acc["at"]).alias("at"), grown.alias("out"))

    return F.aggregate(ops, zero, step)["out"]


def aligned_blocks(cigar: Column, pos: Column) -> Column:
    """RD-03: 0-based half-open aligned blocks (M, = and X)."""
    return _walk(cigar_ops(cigar), pos, ("M", "=", "X"))


def gap_blocks(cigar: Column, pos: Column) -> Column:
    """RD-03: 0-based half-open gaps (N)."""
    return _walk(cigar_ops(cigar), pos, ("N",))


def last_block(cigar: Column, pos: Column) -> Column:
    """The last aligned block as a struct (start, end), null where nothing is aligned; no list of blocks is built."""
    zero = F.struct(pos.cast("int").alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end, aligned = acc["at"] + x["len"], x["op"].isin("M", "=", "X")
        return F.struct(
            F.when(x["op"].isin("M", "D", "N", "=", "X"), end).otherwise(acc["at"]).alias("at"), F.when(aligned, acc["at"]).otherwise(acc["start"]).alias("start"), F.when(aligned, end).otherwise(acc["end"]).alias("end")
        )

    return F.aggregate(cigar_ops(cigar), zero, step, lambda acc: F.when(acc["start"].isNotNull(), F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length of the common part of two half-open intervals, 0 where they don't meet."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))
