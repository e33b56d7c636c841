"""Writers (K1-K3, K5-K9). Tables go out as Parquet; text formats keep their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import general_format


def write_matrix(counts: DataFrame, obs: DataFrame, var: DataFrame, path: str) -> None:  # K1, K7
    """A star schema: <path>/counts, <path>/obs, <path>/var."""
    for name, df in (("counts", counts), ("obs", obs), ("var", var)):
        df.write.parquet(f"{path}/{name}")


def read_matrix(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:  # S12, S13
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("counts", "obs", "var"))


def write_matrix_market(counts: DataFrame, prefix: str) -> None:  # K2
    """<prefix>.counts.mtx (features x cells, from 1), .rownames.txt, .colnames.txt: folders
    of one text file each, as the format has a header line and numbers its names."""
    rows = counts.select("feature_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("feature_id")))
    cols = counts.select("cell_id").distinct().withColumn("j", F.row_number().over(Window.orderBy("cell_id")))
    body = counts.join(rows, "feature_id").join(cols, "cell_id").select("i", "j", F.col("count").cast("long").alias("n"))
    spark = counts.sparkSession
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 1, f"{rows.count()} {cols.count()} {counts.count()}")], "i int, j int, value string")
    text = body.select("i", "j", F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("n").cast("string")).alias("value"))
    head.unionByName(text).orderBy("i", "j").select("value").coalesce(1).write.text(f"{prefix}.counts.mtx")
    rows.orderBy("i").select("feature_id").coalesce(1).write.text(f"{prefix}.rownames.txt")
    cols.orderBy("j").select("cell_id").coalesce(1).write.text(f"{prefix}.colnames.txt")


def write_bedgraph(runs: DataFrame, path: str, group: str = "cluster") -> None:  # K3
    """One folder for each group, <path>/<group>=<name>, of files sorted by (chrom, start)
    that follow one another by range; values with six significant digits."""
    x = runs.select(group, "chrom", "start", "end", general_format("value").alias("value"))
    x = x.repartitionByRange(group, "chrom", "start").sortWithinPartitions(group, "chrom", "start")
    x.write.partitionBy(group).csv(path, sep="\t")


def write_table(df: DataFrame, path: str) -> None:  # K5, K6, K8
    """A small per-cell table as one tab-separated file with a header."""
    df.coalesce(1).write.csv(path, sep="\t", header=True)


def write_split(passed: DataFrame, failed: DataFrame, path: str) -> None:  # K9
    passed.write.parquet(f"{path}/passed")
    failed.write.parquet(f"{path}/failed")


def write_bedpe(fragments: DataFrame, path: str) -> None:  # K9
    fragments.select("chrom", "start", "end", "query_name", "bc").write.csv(path, sep="\t")
