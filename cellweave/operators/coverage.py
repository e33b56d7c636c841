"""Coverage of groups of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import run_length


def cells_with_groups(samples: DataFrame, groups: DataFrame) -> DataFrame:  # J13
    """Every (sample, barcode of any group) with its cluster, null without one."""
    every = samples.select("sample").distinct().crossJoin(groups.select("barcode").distinct())
    return every.join(groups, ["sample", "barcode"], "left")


def sample_differences(samples: DataFrame, groups: DataFrame) -> DataFrame:  # J14, X5
    """sample, missing_in: samples that only the reads or only the groups have."""
    a, b = samples.select("sample").distinct(), groups.select("sample").distinct()
    return a.subtract(b).withColumn("missing_in", F.lit("groups")).unionByName(b.subtract(a).withColumn("missing_in", F.lit("reads")))


def group_coverage(counts: DataFrame, groups: DataFrame) -> DataFrame:  # A13
    """cluster, chrom, bin, value: sums over the member cells."""
    g = groups.filter("cluster is not null").select(F.concat_ws("::", "sample", "barcode").alias("cell_id"), "cluster")
    return counts.join(g, "cell_id").groupBy("cluster", "chrom", "bin").agg(F.sum("count").alias("value"))


def scaled(coverage: DataFrame, factor: float) -> DataFrame:  # A22
    return coverage.withColumn("value", F.col("value") * factor)


def cpm(coverage: DataFrame, ignore: Sequence[str] = (), by: str = "cluster") -> DataFrame:  # A19
    """Counts per million of the group's total, chromosomes in `ignore` left out of the
    total; groups with less than 10 counts are dropped."""
    kept = coverage.filter(~F.col("chrom").isin(*ignore)) if ignore else coverage
    total = kept.groupBy(by).agg((F.sum("value") / 1e6).alias("_m")).filter("_m >= 1e-5")
    return coverage.join(F.broadcast(total), by).withColumn("value", F.col("value") / F.col("_m")).drop("_m")


def cpm_of_runs(coverage: DataFrame, by: str = "cluster") -> DataFrame:
    """The other reading of CPM: the total is over run-length merged rows of each contig."""
    runs = run_length(coverage, [by, "chrom"])
    total = runs.groupBy(by).agg((F.sum("value") / 1e6).alias("_m")).filter("_m >= 1e-5")
    return runs.join(F.broadcast(total), by).withColumn("value", F.col("value") / F.col("_m")).drop("_m")


def mean(coverage: DataFrame, groups: DataFrame) -> DataFrame:  # A20, A21
    """Divided by the cells of the group, those without reads too. Of binarized counts: the frequency."""
    sizes = groups.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("_n"))
    return coverage.join(F.broadcast(sizes), "cluster").withColumn("value", F.col("value") / F.col("_n")).drop("_n")


def smoothed(coverage: DataFrame, width: int, by: Sequence[str] = ("cluster", "chrom")) -> DataFrame:  # W6
    """Mean over `width` bins around each, missing bins as 0, by range on the bin number."""
    left, right = -(-(width - 1) // 2), (width - 1) // 2
    w = Window.partitionBy(*by).orderBy("bin").rangeBetween(-left, right)
    return coverage.withColumn("value", F.sum("value").over(w) / width)


def without_zero_bins(coverage: DataFrame) -> DataFrame:  # W9
    return coverage.filter("value <> 0")


def genome_order(rows: DataFrame, contigs: DataFrame) -> DataFrame:  # O1
    return rows.join(F.broadcast(contigs.select("chrom", "chrom_idx")), "chrom").orderBy("chrom_idx", "start").drop("chrom_idx")
