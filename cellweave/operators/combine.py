"""Combining samples and modalities."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(counts: Mapping[str, DataFrame]) -> DataFrame:  # X2
    """Rows of all samples, cells renamed label_cell, features that all samples have."""
    common = reduce(lambda a, b: a.intersect(b), [c.select("feature_id") for c in counts.values()])
    parts = [c.withColumn("cell_id", F.concat(F.lit(label + "_"), "cell_id")) for label, c in counts.items()]
    return reduce(DataFrame.unionByName, parts).join(common, "feature_id", "left_semi").select("cell_id", "feature_id", "count")


def with_modality(counts: Mapping[str, DataFrame]) -> DataFrame:  # X3
    """All rows, with the modality each comes from."""
    return reduce(DataFrame.unionByName, [c.withColumn("modality", F.lit(m)) for m, c in counts.items()])


def modality_cells(stacked: DataFrame) -> DataFrame:
    """cell_id, modalities (sorted array): the outer join of the modalities' cells."""
    return stacked.groupBy("cell_id").agg(F.sort_array(F.collect_set("modality")).alias("modalities"))


def common_cells(stacked: DataFrame) -> DataFrame:  # X4, J17
    """Cells that every modality has."""
    n = stacked.select("modality").distinct().count()
    return stacked.groupBy("cell_id").agg(F.countDistinct("modality").alias("n")).filter(F.col("n") == n).select("cell_id")


def all_barcodes(*tables: DataFrame) -> DataFrame:  # X1
    return reduce(DataFrame.union, [t.select("bc") for t in tables]).distinct()


def common_contigs(*tables: DataFrame) -> DataFrame:  # X6
    return reduce(lambda a, b: a.intersect(b), [t.select("chrom", "length") for t in tables])


def with_positions(var: DataFrame, positions: DataFrame) -> DataFrame:  # J15
    """chrom, start, end by feature_id; null where unknown."""
    return var.join(positions.select("feature_id", "chrom", "start", "end"), "feature_id", "left")


def with_metadata(obs: DataFrame, metadata: DataFrame, how: str = "left") -> DataFrame:  # J16
    return obs.join(metadata, "cell_id", how)


def wide(values: DataFrame, rows: str, columns: str, value: str) -> DataFrame:  # J19
    """One column for each distinct value of `columns`; missing is null."""
    return values.groupBy(rows).pivot(columns).agg(F.first(value))
