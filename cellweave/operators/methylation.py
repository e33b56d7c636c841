"""Methylation per bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratios(rows: DataFrame, context: str) -> DataFrame:
    """cell, bin_id, depth, ratio from (cell, ctxt, binID, meth, unmeth), of which the
    last is the depth. Rows without a bin go; depth 0 gives null."""
    x = rows.filter((F.col("ctxt") == context) & F.col("binID").isNotNull())
    return x.select("cell", F.col("binID").alias("bin_id"), F.col("unmeth").alias("depth"), (F.col("meth") / F.nullif("unmeth", F.lit(0.0))).alias("ratio"))


def bin_summary(r: DataFrame, cells: int) -> DataFrame:
    """bin_id, median_depth, missing (cells without a ratio), std of the ratios."""
    return r.groupBy("bin_id").agg(F.percentile("depth", F.lit(0.5)).alias("median_depth"), (F.lit(cells) - F.count("ratio")).alias("missing"), F.stddev_pop("ratio").alias("std"))


def imputed(r: DataFrame, cells: DataFrame) -> DataFrame:
    """Every (cell, bin): the ratio, or the bin's mean where the cell has none."""
    grid = r.select("bin_id").distinct().crossJoin(cells.select("cell").distinct())
    x = grid.join(r.select("cell", "bin_id", "ratio"), ["cell", "bin_id"], "left")
    return x.withColumn("ratio", F.coalesce("ratio", F.avg("ratio").over(Window.partitionBy("bin_id"))))


def variable_bins(r: DataFrame, least: float) -> DataFrame:
    return r.groupBy("bin_id").agg(F.stddev_pop("ratio").alias("std")).filter(F.col("std") > least)
