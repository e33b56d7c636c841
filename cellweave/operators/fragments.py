"""From a read to the intervals it covers (F1-F11). Each function returns a Column of
array<struct<start,end>>; an invalid fragment is an empty array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCKS, PAIRED, REVERSE, UNMAPPED, has, lacks
from .predicates import proper_pair


def interval(start: Column, end: Column) -> Column:
    one = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
    return F.when(end > start, one).otherwise(F.array().cast(BLOCKS))


def blocks() -> Column:  # F1
    return F.col("blocks")


def extended(length: int, max_fragment: int | None = None) -> Column:  # F2, F3, F5
    """Proper pairs cover their fragment, other reads `length` bases from their 5' end.
    Fragments over max_fragment (4 * length by default) count as single reads."""
    most = max_fragment or (4 * length if length else 1000)
    rev = has(REVERSE)
    pair = F.when(rev, F.struct(F.col("mate_start").alias("start"), F.col("end").alias("end"))).otherwise(
        F.struct(F.col("start").alias("start"), (F.col("start") + F.abs("tlen")).alias("end"))
    )
    single = F.when(rev, F.struct((F.col("end") - length).alias("start"), F.col("end").alias("end"))).otherwise(
        F.struct(F.col("start").alias("start"), (F.col("start") + length).alias("end"))
    )
    chosen = F.when(proper_pair(most), pair).otherwise(single)
    return F.filter(F.array(chosen.cast("struct<start:bigint,end:bigint>")), lambda b: b["end"] > b["start"])


def centred(length: int, max_fragment: int | None = None) -> Column:  # F6
    """An interval of the read's length in the middle of its extended fragment."""
    half = F.floor(F.col("query_len") / 2)
    return F.transform(
        extended(length, max_fragment),
        lambda b: F.struct(
            (F.floor((b["start"] + b["end"]) / 2) - half).cast("long").alias("start"),
            (F.floor((b["start"] + b["end"]) / 2) - half + F.col("query_len")).cast("long").alias("end"),
        ),
    )


def mnase(least: int = 130, most: int = 200, max_fragment: int = 1000) -> Column:  # F7
    """The middle 2 (even lengths) or 3 (odd) bases of forward proper pairs."""
    ok = proper_pair(max_fragment) & lacks(REVERSE) & (F.col("tlen") > 0) & F.col("tlen").between(least, most)
    start = F.col("start") + F.floor(F.col("tlen") / 2) - 1
    size = F.when(F.col("tlen") % 2 == 0, 2).otherwise(3)
    return F.when(ok, interval(start, start + size)).otherwise(F.array().cast(BLOCKS))


def offset(first: int, last: int | None = None) -> Column:  # F8
    """Positions first .. last of the aligned bases, from 1, negative from the end,
    counted from the read's 5' end, as intervals. Blocks are cut by their running
    length, so a long or spliced read is never spread into bases."""
    last = first if last is None else last
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + (b["end"] - b["start"]))
    place = lambda k: F.lit(k - 1).cast("long") if k > 0 else total + k
    low, high = place(first), place(last) + 1
    low, high = F.greatest(F.least(low, high - 1), F.lit(0)), F.least(F.greatest(high, low + 1), total)
    rev = has(REVERSE)
    a, z = F.when(rev, total - high).otherwise(low), F.when(rev, total - low).otherwise(high)
    seen = F.aggregate(
        "blocks",
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,end:bigint,n:bigint>>").alias("out")),
        lambda s, b: F.struct((s["n"] + b["end"] - b["start"]).alias("n"), F.concat(s["out"], F.array(F.struct(b["start"].alias("start"), b["end"].alias("end"), s["n"].alias("n")))).alias("out")),
        lambda s: s["out"],
    )
    cut = F.transform(
        seen,
        lambda b: F.struct(
            (b["start"] + F.greatest(a - b["n"], F.lit(0))).cast("long").alias("start"),
            F.least(b["start"] + (z - b["n"]), b["end"]).cast("long").alias("end"),
        ),
    )
    inside = (a < total) & (z > 0) & (z > a) & (F.lit(abs(first)) <= total)
    return F.when(inside, F.filter(cut, lambda b: b["end"] > b["start"])).otherwise(F.array().cast(BLOCKS))


def with_fragments(reads: DataFrame, fragments: Column | None = None) -> DataFrame:  # F10
    """Replaces `blocks`; reads that cover nothing go."""
    x = reads if fragments is None else reads.withColumn("blocks", fragments)
    return x.filter((F.size("blocks") > 0) & lacks(UNMAPPED))


def default_length(reads: DataFrame, most: int = 2000) -> DataFrame:  # F4
    """`length`: the median fragment length of proper pairs up to `most`, null if it is under the median read length (then reads are not extended)."""
    pairs = has(PAIRED) & has(2) & (F.abs("tlen") <= most) & (F.col("tlen") > 0)
    x = reads.agg(F.percentile(F.when(pairs, F.col("tlen")), F.lit(0.5)).alias("fragment"), F.percentile("query_len", F.lit(0.5)).alias("read"))
    return x.select(F.when(F.col("fragment") >= F.col("read"), F.col("fragment").cast("long")).alias("length"))


def strand_offset(strand: str | None, given: tuple[int, ...] | None) -> tuple[int, ...] | None:  # F9
    """A strand filter without an offset counts the whole aligned stretch."""
    return (1, -1) if strand and not given else given
