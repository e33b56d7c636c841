"""Tiling, overlap joins and run-length merging.

A pure range condition would become a nested-loop join, and an equi-join on the contig
alone a handful of huge partitions. Both sides are cut into tiles instead and joined on
(chrom, tile); a pair is kept only in the tile that holds the first base they share,
so no distinct is needed. Intervals much longer than a tile are joined in a second
class with longer tiles, so a side never fans out to more than FAN tiles a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 512
FAN = 16
#: Tile sizes of the length classes: FAN times as long each, up to whole chromosomes.
CLASSES = 5


def _class(length: Column, tile: int) -> Column:
    """0 for intervals up to FAN tiles, k for those up to FAN ** (k + 1)."""
    out = F.lit(CLASSES - 1)
    for k in range(CLASSES - 2, -1, -1):
        out = F.when(length <= tile * FAN ** (k + 1), k).otherwise(out)
    return out


def _size(k: Column, tile: int) -> Column:
    return F.element_at(F.array(*[F.lit(tile * FAN**i).cast("long") for i in range(CLASSES)]), k + 1)


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", tile: int = TILE, on: Sequence[str] = ("chrom",), key: Sequence[str] | None = None) -> DataFrame:
    """Pairs of rows whose [start, end) share a base and whose `on` columns are equal.

    The columns of `left`, then those of `right` with `r_` before their names. how:
    inner, left (rows without a partner once, with nulls), left_semi, left_anti. `key`:
    columns that tell the rows of `left` apart; the last three find rows by them, else by all.
    Only the length classes that occur among the rows of `right` cost anything: a row of
    `left` is tiled once for each, found by one small aggregate.
    """
    names = [f"r_{c}" for c in right.columns]
    r = right.toDF(*names).withColumn("_c", _class(F.col("r_end") - F.col("r_start"), tile))
    size = _size(F.col("_c"), tile)
    r = r.withColumn("_size", size).withColumn("_t", F.explode(F.sequence(F.floor(F.col("r_start") / size), F.floor((F.col("r_end") - 1) / size)))).filter("r_end > r_start")
    ends = F.greatest("end", F.col("start") + 1) - 1

    def tiles_of(k: int) -> Column:
        step = tile * FAN**k
        return F.transform(F.sequence(F.floor(F.col("start") / step), F.floor(ends / step)), lambda t: F.struct(F.lit(k).alias("_c"), t.alias("_t")))

    tiles = F.flatten(F.array(*[tiles_of(k) for k in range(CLASSES)]))
    present = F.broadcast(r.select(F.col("_c").alias("_have")).distinct())  # CLASSES rows at most
    x = left.withColumn("_x", F.explode(tiles)).withColumn("_c", F.col("_x._c")).withColumn("_t", F.col("_x._t")).drop("_x")
    x = x.join(present, F.col("_c") == F.col("_have"), "left_semi")
    x, r = x.withColumnsRenamed({"_c": "_lc", "_t": "_lt"}), r.withColumnsRenamed({"_c": "_rc", "_t": "_rt"})
    same = (F.col("_lc") == F.col("_rc")) & (F.col("_lt") == F.col("_rt"))
    for c in on:
        same = same & (F.col(c) == F.col(f"r_{c}"))
    touch = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")) & (F.col("_lt") == F.floor(F.greatest("start", "r_start") / F.col("_size")))
    pairs = x.join(r, same & touch)
    key = key or left.columns
    if how == "inner":
        return pairs.select(*left.columns, *names)
    if how == "left":
        hit = pairs.select(*left.columns, *names)
        miss = left.join(pairs.select(*[F.col(c).alias(f"_k_{c}") for c in key]).distinct(), _equal(key), "left_anti")
        return hit.unionByName(miss, allowMissingColumns=True)
    keys = pairs.select(*[F.col(c).alias(f"_k_{c}") for c in key]).distinct()
    return left.join(keys, _equal(key), how)


def _equal(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out


def to_bins(reads: DataFrame, size: int) -> DataFrame:  # J1
    """One row for each read and bin that a block of it touches: adds `bin`."""
    touched = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.sequence(F.floor(b["start"] / size), F.floor((b["end"] - 1) / size)))))
    return reads.withColumn("bin", F.explode(touched))


def bin_regions(bins: DataFrame, contigs: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """Adds start and end of `bin`; the last bin of a contig is cut at its end."""
    step = stride or size
    x = bins.join(F.broadcast(contigs.select("chrom", "length")), "chrom")
    x = x.withColumn("start", (F.col("bin") * step).cast("long"))
    return x.withColumn("end", F.least(F.col("start") + size, F.col("length"))).filter("start < length").drop("length")


def to_spaced_bins(reads: DataFrame, size: int, distance: int, contigs: DataFrame) -> DataFrame:  # J3
    """Bins of `size` at every size + distance bases; a last bin that the contig cuts is dropped."""
    stride = size + distance
    spans = F.flatten(
        F.transform("blocks", lambda b: F.filter(F.sequence(F.floor(b["start"] / stride), F.floor((b["end"] - 1) / stride)), lambda k: (k * stride < b["end"]) & (k * stride + size > b["start"])))
    )
    x = reads.withColumn("bin", F.explode(F.array_distinct(spans))).join(F.broadcast(contigs.select("chrom", "length")), "chrom")
    return x.filter(F.col("bin") * stride + size <= F.col("length")).select(*reads.columns, "bin")


def sample_stride(contigs: DataFrame, samples: int) -> int:  # J4
    """Stride that spreads `samples` bins over the genome."""
    return max(1, (contigs.agg(F.sum("length")).first()[0] or 0) // max(1, samples))


def bins_in_regions(regions: DataFrame, size: int) -> DataFrame:  # J5
    """Each region cut into bins from its start; the last one ends with the region."""
    x = regions.withColumn("_s", F.explode(F.sequence("start", F.col("end") - 1, F.lit(size).cast("long"))))
    cut = {"start": F.col("_s"), "end": F.least(F.col("_s") + size, F.col("end"))}
    return x.select(*[cut.get(c, F.col(c)).alias(c) for c in regions.columns])


def region_bins(chrom: str, start: int, end: int, size: int) -> tuple[int, int]:  # J6
    """The region's start moved down to a multiple of the bin size."""
    return start // size * size, end


def clip_to_region(binned: DataFrame, chrom: str, start: int, end: int, size: int) -> DataFrame:
    low, high = region_bins(chrom, start, end, size)
    x = binned.filter((F.col("chrom") == chrom) & (F.col("start") >= low) & (F.col("start") < high))
    return x.withColumn("end", F.least(F.col("end"), F.lit(high).cast("long")))


def without_blacklisted(rows: DataFrame, blacklist: DataFrame, tile: int = TILE) -> DataFrame:  # J7, J10
    return overlap_join(rows, blacklist.select("chrom", "start", "end"), "left_anti", tile)


def read_span(reads: DataFrame) -> DataFrame:
    """Reads with the span that the blacklist is held against: query_len - 1 bases."""
    return reads.withColumn("end", F.col("start") + F.greatest(F.col("query_len") - 1, F.lit(1)))


def merged(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """Disjoint intervals: rows that overlap or lie within `gap` bases become one."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    x = intervals.select("chrom", "start", "end").withColumn("_m", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_island", F.sum(F.when(F.col("_m").isNull() | (F.col("start") > F.col("_m") + gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def free_space(contigs: DataFrame, blacklist: DataFrame) -> DataFrame:  # J8
    """The contigs less the blacklist, as disjoint intervals."""
    m = merged(blacklist)
    w = Window.partitionBy("chrom").orderBy("start")
    gaps = m.withColumn("_next", F.lead("start").over(w)).join(F.broadcast(contigs.select("chrom", "length")), "chrom", "right")
    after = gaps.select("chrom", F.coalesce("end", F.lit(0).cast("long")).alias("start"), F.least(F.coalesce("_next", "length"), F.col("length")).alias("end"))
    before = m.groupBy("chrom").agg(F.min("start").alias("end")).select("chrom", F.lit(0).cast("long").alias("start"), "end")
    return after.unionByName(before).filter("end > start")


def free_bins(contigs: DataFrame, blacklist: DataFrame, size: int) -> DataFrame:
    """Bins that start anew after each blacklisted interval."""
    return bins_in_regions(free_space(contigs, blacklist), size)


def _last_before(rows: DataFrame, points: DataFrame, at: Column, reach: int, name: str) -> DataFrame:
    """Adds `name`: the greatest `p` of `points` (chrom, p) that is not past `at`, null if there
    is none; one that is more than `reach` away may be found or not. Rows and points meet in
    tiles of at least `reach` positions, in one pass over each tile in order; of the tile
    before only the last point is carried over."""
    step = max(TILE, reach)
    p = points.filter("chrom is not null and p is not null").distinct().withColumn("_t", F.floor(F.col("p") / step))
    carried = p.groupBy("chrom", "_t").agg(F.max("p").alias("p")).withColumn("_t", F.col("_t") + 1)
    p = p.unionByName(carried).withColumn("_at", F.col("p"))
    x = rows.withColumn("_at", at).withColumn("_t", F.floor(F.col("_at") / step)).withColumn("_row", F.lit(True))
    w = Window.partitionBy("chrom", "_t").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.unionByName(p, allowMissingColumns=True).withColumn(name, F.last("p", ignorenulls=True).over(w))
    return x.filter("_row").select(*rows.columns, name)


def clip_windows(regions: DataFrame, blacklist: DataFrame, extension: int) -> DataFrame:  # J9
    """Windows in which reads of a region are fetched when reads are extended: the
    region widened by `extension`, but not past the nearest blacklisted interval. Equal
    regions give one row. Only the nearest interval on each side is looked for, so the
    work does not follow the number of intervals that a window touches."""
    keys = [c for c in regions.columns if c != "exons"]
    x = regions.select(*keys).distinct()
    x = _last_before(x, blacklist.select("chrom", F.col("end").alias("p")), F.col("start"), extension, "_low")
    x = _last_before(x, blacklist.select("chrom", (-F.col("start")).alias("p")), -F.col("end"), extension, "_high")
    low, high = F.greatest(F.col("start") - extension, F.lit(0)), F.col("end") + extension
    return x.select(
        "chrom", F.greatest(low, F.coalesce("_low", low)).alias("start"), F.least(high, F.coalesce(-F.col("_high"), high)).alias("end"), *[c for c in keys if c not in ("chrom", "start", "end")]
    )


def run_length(bins: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:  # W4
    """Adjacent intervals of equal value become one; null and NaN runs are left out."""
    w = Window.partitionBy(*by).orderBy("start")
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    x = bins.withColumn("_v", v).withColumn("_new", F.when((F.lag("end").over(w) == F.col("start")) & F.lag("_v").over(w).eqNullSafe(F.col("_v")), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_v is not null")
    return x.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("_v").alias(value)).drop("_run")


def features_of_bins(bins: DataFrame, genes: DataFrame) -> DataFrame:  # J11
    """For each bin the overlapping genes as an array of (name, strand), null if none."""
    hit = overlap_join(bins.select("chrom", "start", "end"), genes.select("chrom", "start", "end", "name", "strand"), "left")
    pair = F.when(F.col("r_name").isNotNull(), F.struct(F.col("r_name").alias("gene"), F.col("r_strand").alias("strand")))
    x = hit.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(pair)).alias("genes"))
    return x.withColumn("genes", F.when(F.size("genes") > 0, F.col("genes")))


def bins_of_gene(annotated: DataFrame, gene: str, first: bool = False) -> DataFrame:  # J12, W8
    """Bins of a gene, whatever the case of its name; `first`: only the one at its start."""
    x = annotated.withColumn("x", F.explode("genes")).filter(F.lower("x.gene") == gene.lower())
    x = x.select("chrom", "start", "end", F.col("x.gene").alias("gene"), F.col("x.strand").alias("strand"))
    if not first:
        return x
    bin_ = F.struct("chrom", "start", "end")
    x = x.groupBy("gene", "strand").agg(F.min_by(bin_, "start").alias("low"), F.max_by(bin_, "start").alias("high"))
    return x.withColumn("b", F.when(F.col("strand") == "-", F.col("high")).otherwise(F.col("low"))).select("b.*", "gene", "strand")
