"""Quality metrics of cells and features, and filters on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOPS = (50, 100, 200, 500)


def gini(counts: DataFrame) -> DataFrame:  # A14
    """cell_id, gini of the non-zero counts; null for one or none."""
    x = counts.filter("count > 0")
    w = Window.partitionBy("cell_id").orderBy("count")
    x = x.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("cell_id")))
    value = F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("count")) / (F.max("n") * F.sum("count"))
    return x.groupBy("cell_id").agg(F.when(F.max("n") > 1, value).alias("gini"))


def cell_metrics(counts: DataFrame, tops: Sequence[int] = TOPS) -> DataFrame:  # A15
    """Features and counts of each cell, and the share of its `k` strongest features."""
    x = counts.filter("count > 0").withColumn("r", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("count"), "feature_id")))
    x = x.groupBy("cell_id").agg(
        F.count("*").alias("n_genes_by_counts"), F.sum("count").alias("total_counts"),
        *[(100 * F.sum(F.when(F.col("r") <= k, F.col("count")).otherwise(0)) / F.sum("count")).alias(f"pct_counts_in_top_{k}_genes") for k in tops],
    )
    return x.withColumn("log1p_n_genes_by_counts", F.log1p("n_genes_by_counts")).withColumn("log1p_total_counts", F.log1p("total_counts"))


def feature_metrics(counts: DataFrame, cells: int | None = None) -> DataFrame:  # A15
    n = counts.select("cell_id").distinct().count() if cells is None else cells
    x = counts.filter("count > 0").groupBy("feature_id").agg(F.count("*").alias("n_cells_by_counts"), F.sum("count").alias("total_counts"))
    x = x.withColumn("mean_counts", F.col("total_counts") / n).withColumn("pct_dropout_by_counts", 100 * (1 - F.col("n_cells_by_counts") / n))
    return x.withColumn("log1p_mean_counts", F.log1p("mean_counts")).withColumn("log1p_total_counts", F.log1p("total_counts"))


def describe(metrics: DataFrame) -> DataFrame:  # A16
    """metric, min, max of every numeric column, from one aggregate."""
    names = [c for c, t in metrics.dtypes if t in ("int", "bigint", "double", "float")]
    one = metrics.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c)["min"].alias("min"), F.col(c)["max"].alias("max")) for c in names])).alias("x")).select("x.*")


def totals(counts: DataFrame) -> DataFrame:  # A17
    return counts.agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("feature_id").alias("features"))


def parse_ranges(text: str) -> dict[str, tuple[float, float]]:
    """ "name: low, high; name: low, high" """
    out = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, bounds = part.partition(":")
        low, high = (float(v) for v in bounds.split(","))
        out[name.strip()] = (low, high)
    return out


def _between(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    for name, (low, high) in ranges.items():
        df = df.filter(F.col(name).between(low, high))
    return df


def filtered(
    counts: DataFrame, obs: DataFrame, var: DataFrame, cells: Mapping[str, tuple[float, float]] | None = None, features: Mapping[str, tuple[float, float]] | None = None,
    bad_chroms: Sequence[str] = (), bad_cells: Sequence[str] = (),
) -> DataFrame:  # X7
    """Counts within inclusive ranges of the columns of obs and var, features first.
    The metrics are those given, not recomputed between the two."""
    if bad_chroms:
        var = var.filter(~F.col("chrom").isin(*bad_chroms))
    if bad_cells:
        obs = obs.filter(~F.col("cell_id").isin(*bad_cells))
    x = counts.join(_between(var, features or {}).select("feature_id"), "feature_id", "left_semi")
    return x.join(_between(obs, cells or {}).select("cell_id"), "cell_id", "left_semi")


def preprocessed(counts: DataFrame, min_cell_sum: float, min_region_sum: float) -> DataFrame:  # M23
    """Binarized; cells and regions of at least the given sums, both taken beforehand."""
    b = counts.filter("count > 0").select("cell_id", "feature_id", F.lit(1.0).alias("count"))
    cells = b.groupBy("cell_id").agg(F.sum("count").alias("s")).filter(F.col("s") >= min_cell_sum)
    regions = b.groupBy("feature_id").agg(F.sum("count").alias("s")).filter(F.col("s") >= min_region_sum)
    return b.join(cells, "cell_id", "left_semi").join(regions, "feature_id", "left_semi")
