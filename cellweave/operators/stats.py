"""Per-cell read statistics and barcode selection (A9-A12, A24, W5, the read table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import REVERSE, cell_id, has
from . import dedup
from . import predicates as P
from .intervals import overlap_join, read_span

COUNTERS = (
    "Total_sampled", "Filtered", "Blacklisted", "Low_MAPQ", "Missing_Flags", "Excluded_Flags", "Internal_Duplicates", "Marked_Duplicates",
    "Singletons", "Wrong_strand", "Wrong_motif", "Unwanted_GC_content", "Low_aligned_fraction",
)


def filter_statistics(
    reads: DataFrame, cells: DataFrame, options: P.ReadFilter, dedup_key: str | None = None, blacklist: DataFrame | None = None,
    motif: tuple[DataFrame, list[tuple[str, str]]] | None = None, sampling: tuple[DataFrame, int, int] | None = None,
) -> DataFrame:  # A9
    """One row for each cell (sample, bc) of `cells` with the 13 counters.

    Tests are not exclusive; Filtered counts reads that fail any. All counters come from
    one pass and one aggregate. `sampling`: (contigs, bin size, distance) of P18.
    """
    x = reads.filter(P.mapped() & P.has_tag(options.tag))
    if sampling:
        contigs, size, distance = sampling
        x = x.join(F.broadcast(contigs.select("chrom", "length")), "chrom").filter(P.in_sample(size, distance)).select(*reads.columns)
    x = dedup.mark_positional(x, dedup_key) if dedup_key else x.withColumn("is_dup", F.lit(False))
    if blacklist is not None:
        span = read_span(x.select("sample", "chrom", "start", "read_seq", "query_name", "query_len", "end"))
        bad = overlap_join(span, blacklist.select("chrom", "start", "end")).select("sample", "read_seq", "query_name").distinct().withColumn("_bad", F.lit(True))
        x = x.join(bad, ["sample", "read_seq", "query_name"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    else:
        x = x.withColumn("_bad", F.lit(False))
    x = P.motif(x, *motif) if motif else x.withColumn("motif_ok", F.lit(True))
    tests: dict[str, Column] = {
        "Blacklisted": F.col("_bad"),
        "Low_MAPQ": ~P.min_mapq(options.min_mapq),
        "Missing_Flags": ~P.flag_include(options.flag_include),
        "Excluded_Flags": ~P.flag_exclude(options.flag_exclude),
        "Internal_Duplicates": F.col("is_dup"),
        "Marked_Duplicates": P.duplicate_mark(),
        "Singletons": P.singleton(),
        "Wrong_strand": ~P.strand(options.strand) if options.strand else F.lit(False),
        "Wrong_motif": ~F.col("motif_ok"),
        "Unwanted_GC_content": ~F.coalesce(P.gc_between(*options.gc), F.lit(False)) if options.gc else F.lit(False),
        "Low_aligned_fraction": ~F.coalesce(P.min_aligned_fraction(options.min_aligned), F.lit(False)),
    }
    any_ = F.lit(False)
    for t in tests.values():
        any_ = any_ | t
    sums = x.groupBy("sample", "bc").agg(F.count("*").alias("Total_sampled"), F.count_if(any_).alias("Filtered"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    out = cells.select("sample", "bc").distinct().join(sums, ["sample", "bc"], "left")
    return out.select(cell_id().alias("cell_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def as_percent(stats: DataFrame) -> DataFrame:  # A10
    """All counters but the first as percentages of it; null where it is 0."""
    total = F.nullif("Total_sampled", F.lit(0))
    return stats.select("cell_id", "Total_sampled", *[(F.col(c) * 100.0 / total).alias(c) for c in COUNTERS[1:]])


def bins_per_barcode(reads: DataFrame, size: int = 100_000) -> DataFrame:  # A11
    """bc, count: bins in which the barcode starts a read."""
    x = reads.select("bc", "chrom", F.floor(F.col("start") / size).alias("bin")).distinct()
    return x.groupBy("bc").agg(F.count("*").alias("count"))


def select_barcodes(per_barcode: DataFrame, least: int, bins: int) -> DataFrame:  # A12
    """Adds `selected`: at least min(least, number of bins) bins."""
    return per_barcode.withColumn("selected", F.col("count") >= min(least, bins))


def knee(per_barcode: DataFrame) -> DataFrame:  # W5, K11
    """bc, count, rank (ties share the least), log10_count. Ranks follow from the number of
    barcodes with each count, a small table, so barcodes are not sorted in one place."""
    sizes = per_barcode.groupBy("count").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = sizes.select("count", (F.coalesce(above, F.lit(0)) + 1).cast("long").alias("rank"))
    return per_barcode.join(ranks, "count").select("bc", "count", "rank", F.log10("count").alias("log10_count"))


def filter_totals(reads: DataFrame, options: P.ReadFilter) -> DataFrame:  # A24
    return reads.agg(F.count("*").alias("total"), F.count_if(F.coalesce(options.column(), F.lit(False))).alias("remaining"))


def read_table(reads: DataFrame, whitelist: DataFrame, options: P.ReadFilter, dedup_key: str = "start_bc", blacklist: DataFrame | None = None) -> DataFrame:
    """One row for each read that passes: chrom, whether its barcode is listed, start,
    is_dup, distance to the previous start, GC content, strand, name."""
    x = reads.filter(P.mapped() & P.min_mapq(options.min_mapq) & P.min_aligned_fraction(options.min_aligned))
    if blacklist is not None:
        span = read_span(x.select("sample", "chrom", "start", "read_seq", "query_name", "query_len", "end"))
        bad = overlap_join(span, blacklist.select("chrom", "start", "end"), "left_semi").select("sample", "read_seq", "query_name").distinct()
        x = x.join(bad, ["sample", "read_seq", "query_name"], "left_anti")
    x = dedup.distance_to_previous(dedup.mark_positional(x, dedup_key))
    listed = whitelist.select("bc").distinct().withColumn("in_whitelist", F.lit(True))
    x = x.join(listed, "bc", "left").withColumn("in_whitelist", F.coalesce("in_whitelist", F.lit(False)))
    return x.select("sample", "chrom", "in_whitelist", "start", "is_dup", "distance", P.gc_content().alias("gc"), has(REVERSE).alias("is_reverse"), "query_name")
