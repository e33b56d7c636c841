"""Readers of the text formats (S5-S10, S14, S16-S18) and the region argument."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _trimmed(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:  # S5
    """chrom, start, end, name, strand. Fields may be ragged and padded. A region is named
    chrom:start-end; a repeated one gets the suffix _r1, _r2, ...; rows are ordered by
    (start, end) within a chromosome for that numbering, not by file order."""
    x = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|track|browser|$)")).withColumn("f", F.split("value", "\t"))
    at = lambda k: F.when(F.size("f") > k, _trimmed(F.col("f")[k]))
    x = x.select(at(0).alias("chrom"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), F.regexp_extract("value", r"[\t ]([+-])(?:[\t ]|$)", 1).alias("strand"))
    x = x.withColumn("strand", F.when(F.col("strand") != "", F.col("strand")).otherwise("."))
    again = F.row_number().over(Window.partitionBy("chrom", "start", "end").orderBy("strand")) - 1
    name = F.concat(F.col("chrom"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    return x.withColumn("_n", again).select("chrom", "start", "end", F.when(F.col("_n") > 0, F.concat(name, F.lit("_r"), F.col("_n"))).otherwise(name).alias("name"), "strand")


def attributes(text: str | Column) -> Column:  # S7
    """GTF attributes (key "value";) as a map; of a repeated key the first counts."""
    t = F.col(text) if isinstance(text, str) else text
    keys = F.regexp_extract_all(t, F.lit(r'([A-Za-z0-9_]+)\s+"[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(t, F.lit(r'[A-Za-z0-9_]+\s+"([^"]*)"'), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.struct(F.element_at(keys, i).alias("key"), F.element_at(values, i).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.when(F.size(keys) > 0, F.map_from_entries(first))


def read_gtf_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, feature, start (0-based), end, strand, attributes."""
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))
    return x.select(
        F.col("f")[0].alias("chrom"), F.col("f")[2].alias("feature"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("long").alias("end"),
        F.col("f")[6].alias("strand"), attributes(F.col("f")[8]).alias("attributes"),
    )


def read_gtf(spark: SparkSession, path: str | list[str], transcript: str = "transcript", exon: str = "exon", designator: str = "transcript_id", keep_exons: bool = False) -> DataFrame:  # S6
    """Transcripts as regions (chrom, start, end, name, strand); with keep_exons also
    `exons`, and the span of the exons where the file has no transcript record."""
    x = read_gtf_records(spark, path).withColumn("name", F.col("attributes")[designator])
    whole = x.filter(F.col("feature") == transcript).select("chrom", "start", "end", "name", "strand")
    if not keep_exons:
        return whole
    parts = x.filter(F.col("feature") == exon).groupBy("chrom", "name", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    y = parts.join(whole.select("chrom", "name", "start", "end"), ["chrom", "name"], "full")
    start, end = F.coalesce("start", F.array_min(F.transform("exons", lambda e: e["start"]))), F.coalesce("end", F.array_max(F.transform("exons", lambda e: e["end"])))
    return y.select("chrom", start.alias("start"), end.alias("end"), "name", F.coalesce("strand", F.lit(".")).alias("strand"), F.coalesce("exons", F.array(F.struct(start.alias("start"), end.alias("end")))).alias("exons"))


def in_region(regions: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Features that overlap the region, whole, not cut."""
    x = regions.filter(F.col("chrom") == chrom)
    if start is not None:
        x = x.filter(F.col("end") > start)
    return x if end is None else x.filter(F.col("start") < end)


def parse_region(text: str) -> tuple[str, int | None, int | None]:  # S16
    """chr[:start[:end]]; commas, semicolons, pipes, braces and ! are ignored and - is read as a colon."""
    clean = re.sub(r"[,;|!{}()]", "", text).strip().replace("-", ":")
    parts = [p for p in clean.split(":") if p]
    if not parts or len(parts) > 3:
        raise ValueError(f"not a region: {text!r}")
    return parts[0], *(int(parts[k]) if len(parts) > k else None for k in (1, 2))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:  # S9
    return spark.read.text(path).select(F.trim("value").alias("bc")).filter("bc <> ''").distinct()


def read_groups(spark: SparkSession, path: str) -> DataFrame:  # S10
    """sample, barcode, cluster of a file with columns (sample, barcode, cluster) or
    ("sample::barcode", x, y, cluster); # starts a comment, the first row is a header."""
    x = spark.read.csv(path, sep="\t", header=True, comment="#")
    if len(x.columns) == 3:
        return x.toDF("sample", "barcode", "cluster")
    if len(x.columns) == 4:
        cell, _, _, cluster = x.columns
        both = F.split(F.col(f"`{cell}`"), "::")
        return x.select(both[0].alias("sample"), both[1].alias("barcode"), F.col(f"`{cluster}`").alias("cluster"))
    raise ValueError(f"expected 3 or 4 columns, found {len(x.columns)}")


def read_matrix_market(spark: SparkSession, prefix: str) -> DataFrame:  # S14
    """Counts (cell_id, feature_id, count) of <prefix>.counts.mtx with .rownames.txt
    (features) and .colnames.txt (cells), joined by line number."""

    def names(path: str, column: str) -> DataFrame:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("k", column))
        return whole.select(column, (F.col("k") + 1).cast("long").alias("k"))

    # The size line comes first after the comments; whole-text reading would tell it by place,
    # but the counts may be large, so it is told by its numbers: names of both lists and entries.
    x = spark.read.text(f"{prefix}.counts.mtx").filter(~F.col("value").startswith("%")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    x = x.select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.col("f")[2].cast("double").alias("count"))
    rows, cols = names(f"{prefix}.rownames.txt", "feature_id"), names(f"{prefix}.colnames.txt", "cell_id")
    size = (rows.count(), cols.count(), float(x.count() - 1))
    same = (F.col("i") == size[0]) & (F.col("j") == size[1]) & (F.col("count") == size[2])
    # An entry at the last corner can look like the size line; then one of the two stays.
    twice = x.filter(same)
    x = x.filter(~same).unionByName(twice.limit(max(0, twice.count() - 1)))
    return x.join(rows.withColumnRenamed("k", "i"), "i").join(cols.withColumnRenamed("k", "j"), "j").select("cell_id", "feature_id", "count")


def read_methylation(spark: SparkSession, path: str) -> DataFrame:  # S17
    """cell (from the file's name), ctxt, binID, meth, unmeth of per-cell tables."""
    x = spark.read.csv(path, sep="\t", header=True)
    cell = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return x.select(cell.alias("cell"), "ctxt", "binID", F.col("meth").cast("double").alias("meth"), F.col("unmeth").cast("double").alias("unmeth"))


def munged(regions: DataFrame, contigs: DataFrame) -> DataFrame:  # S18
    """Chromosome names written as the contigs write theirs (chr1 or 1); rows of unknown
    contigs are an error."""
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    names = contigs.select(F.col("chrom").alias("_name"), bare("chrom").alias("_bare"))
    x = regions.withColumn("_bare", bare("chrom")).join(F.broadcast(names), "_bare", "left")
    unknown = x.filter("_name is null").select("chrom").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown contig {unknown[0][0]!r}")
    return x.withColumn("chrom", F.col("_name")).select(*regions.columns)


def union_of_files(reads: dict[str, DataFrame]) -> DataFrame:  # S3
    """Reads of several files, labelled; the sample's place in the dict orders columns."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [r.withColumn("sample", F.lit(label)) for label, r in reads.items()])


def in_range(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:  # S2
    """Reads that overlap a range; on Parquet sorted by (chrom, start) the scan prunes row groups."""
    return reads.filter((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
