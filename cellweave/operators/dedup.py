"""Duplicate reads (U1, U2) and distances between reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import REVERSE, has

#: Order of reads in a file; ties are broken by name so that results are fixed.
ORDER = ("start", "read_seq", "query_name")


def duplicate_key(kind: str) -> Column:
    """The key of one of start_bc, start_bc_umi, start_end_bc, start_end_bc_umi."""
    parts = set(kind.split("_"))
    tlen, start = F.col("tlen"), F.col("start")
    left = tlen >= 0
    s = F.when(left, start).otherwise(F.col("mate_start"))
    e = F.when(left, start + tlen).otherwise(F.col("mate_start") - tlen)
    mate = F.col("mate_chrom")
    if "end" in parts:
        e = F.when(mate != F.col("chrom"), F.col("mate_start")).otherwise(e)
    else:
        s = F.when(~has(REVERSE), s)
        e = F.when(has(REVERSE), e)
        mate = F.col("chrom")
    umi = F.col("umi") if "umi" in parts else F.lit(None).cast("string")
    return F.struct(F.col("bc").alias("bc"), umi.alias("umi"), s.alias("s"), e.alias("e"), mate.alias("mate"), has(REVERSE).alias("rev"))


def drop_adjacent(reads: DataFrame, kind: str, by: Sequence[str] = ("sample", "chrom"), tile: int = 1_000_000) -> DataFrame:
    """A read goes if its key equals that of the read before it in file order,
    whatever the cell. `by` is where the file order starts anew.

    A contig is not one window partition: reads are cut in tiles of positions, each a
    partition of its own, and the key before a tile's first read is the last key of the
    nearest tile with reads, from one small row for each tile.
    """
    x = reads.withColumn("_key", duplicate_key(kind)).withColumn("_tile", F.floor(F.col("start") / tile))
    place = F.struct(*ORDER)
    last = x.groupBy(*by, "_tile").agg(F.max_by("_key", place).alias("_last"))
    before = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy("_tile"))).drop("_last")
    w = Window.partitionBy(*by, "_tile").orderBy(*ORDER)
    x = x.withColumn("_prev", F.lag("_key").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    names = (*by, "_tile")
    before = before.select(*[F.col(c).alias(f"_b_{c}") for c in names], "_carried")
    x = x.join(before, _all([F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in names]), "left")
    previous = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev"))
    return x.filter(previous.isNull() | ~previous.eqNullSafe(F.col("_key"))).select(*reads.columns)


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def mark_positional(reads: DataFrame, kind: str, by: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    """Adds `is_dup`, true if an earlier read at the same start has the key."""
    w = Window.partitionBy(*by, "start", "_key").orderBy("read_seq", "query_name")
    return reads.withColumn("_key", duplicate_key(kind)).withColumn("is_dup", F.row_number().over(w) > 1).drop("_key")


def drop_positional(reads: DataFrame, kind: str, by: Sequence[str] = ("sample", "chrom")) -> DataFrame:
    return mark_positional(reads, kind, by).filter(~F.col("is_dup")).drop("is_dup")


def distance_to_previous(marked: DataFrame, by: Sequence[str] = ("sample", "chrom"), tile: int = 1_000_000) -> DataFrame:
    """Adds `distance` to the previous distinct start; 0 for the first read and for
    duplicates, null for another read at the same start. Starts are compared over the
    distinct starts, a much smaller table than the reads, in tiles of positions as in U1."""
    starts = marked.select(*by, "start").distinct().withColumn("_tile", F.floor(F.col("start") / tile))
    last = starts.groupBy(*by, "_tile").agg(F.max("start").alias("_last"))
    names = (*by, "_tile")
    before = last.select(*[F.col(c).alias(f"_b_{c}") for c in names], F.lag("_last").over(Window.partitionBy(*by).orderBy("_tile")).alias("_carried"))
    starts = starts.withColumn("_prev", F.lag("start").over(Window.partitionBy(*names).orderBy("start")))
    starts = starts.join(before, _all([F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in names]), "left")
    starts = starts.select(*by, "start", (F.col("start") - F.coalesce("_prev", "_carried")).alias("_gap"))
    x = marked.join(starts, [*by, "start"])
    first = F.row_number().over(Window.partitionBy(*by, "start").orderBy("read_seq", "query_name")) == 1
    x = x.withColumn("_first", first)
    d = F.when(F.col("is_dup"), F.lit(0)).when(F.col("_first"), F.coalesce("_gap", F.lit(0)))
    return x.withColumn("distance", d.cast("long")).select(*marked.columns, "distance")
