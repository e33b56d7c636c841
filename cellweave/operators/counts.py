"""Counting reads per cell and bin or feature (A1-A8, A18, X7 helpers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import cell_id, feature_id
from .intervals import TILE, bin_regions, to_bins


def count_bins(reads: DataFrame, size: int, contigs: DataFrame | None = None, binarize: bool = False) -> DataFrame:
    """cell_id, chrom, bin, count (and start, end with `contigs`). A read counts once in
    each bin that a block of it touches. Only non-zero counts; partial sums are
    combined before the one shuffle."""
    x = to_bins(reads, size).withColumn("cell_id", cell_id())
    keys = ["cell_id", "chrom", "bin"]
    if binarize:  # A2
        out = x.select(*keys).distinct().withColumn("count", F.lit(1.0))
    else:  # A1
        out = x.groupBy(*keys).agg(F.count("*").cast("double").alias("count"))
    return out if contigs is None else bin_regions(out, contigs, size)


#: Tiles of the length classes of features are this many times as long each, and SHARE times as long as their features at least.
STEPS, SHARE = 16, 4
#: Parts by cell in which each tile is counted, so that no tile is one task.
CELL_PARTS = 16
#: Pairs of a block and a target that are looked at in one go, and rows of an output batch.
PAIRS, BATCH_ROWS = 1_000_000, 65_536
#: A cell of more pairs than DENSE + targets / 7 is counted over all targets of the tile, by ranks instead of pairs.
DENSE = 1_250
#: Bits of a place in a packed row, which has so many counts at most.
PACK = 13
#: Features of a tile that travel as one compressed row, if they are so many at least.
BUNDLE = 16
#: What a bundle holds of each feature.
FEATURE = ("start", "end", "name", "blocks")


class _Tile:
    """The features of one tile: rows of `columns`, and their targets by start."""

    def __init__(self, columns: list[pa.Array], blocks: pa.Array):
        self.columns, self.many = columns, len(blocks)
        start, end, self.of = _flat(blocks)
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.of = start[order], end[order], self.of[order]
        self.reach = np.maximum.accumulate(self.end) if len(start) else self.end
        self.longest = int((end - start).max(initial=0))
        order = np.argsort(self.end, kind="stable")
        self.ends, self.rank = self.end[order], np.empty_like(order)
        self.rank[order] = np.arange(len(order))
        self.same = self.many == len(self.of) and bool((self.of == np.arange(self.many)).all())

    def candidates(self, start: np.ndarray, end: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of targets that each block, in order of starts for each read, may be the first of
        its read to overlap. They start before the block's end, and not before an earlier block's."""
        low = np.maximum(np.searchsorted(self.start, start - self.longest, "right"), np.searchsorted(self.reach, start, "right"))
        later = np.flatnonzero(read[1:] == read[:-1]) + 1
        if len(later):  # a target that ends past this block's start ends past those of the earlier blocks
            lift = read * (int(end.max()) - int(end.min()) + 1)  # no read's ends reach those of the next
            latest = np.maximum.accumulate(end + lift) - lift
            low[later] = np.maximum(low[later], np.searchsorted(self.start, latest[later - 1], "left"))
        return low, np.maximum(np.searchsorted(self.start, end, "left"), low)

    def counts(self, cell: np.ndarray, cells: int, blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cell * features + feature, count) of the reads whose blocks these are, in order."""
        start, end, read = _flat(blocks)
        if ((read[1:] == read[:-1]) & (start[1:] < start[:-1])).any():
            order = np.lexsort((start, read))
            start, end = start[order], end[order]
        low, high = self.candidates(start, end, read)
        own = cell[read].astype(np.int64)
        dense = np.bincount(own, high - low, minlength=cells) > DENSE + len(self.start) / 7
        codes, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, last in _runs([dense]):
            at, stop = np.searchsorted(own, (first, last)).tolist()
            if not dense[first]:
                some = slice(at, stop)
                for code, total in self._by_pairs(start[some], own[some] * self.many, low[some], high[some]):
                    codes.append(code)
                    sums.append(total)
                continue
            bounds = np.searchsorted(own, np.arange(first, last + 1)).tolist()
            for k, some in enumerate(map(slice, bounds[:-1], bounds[1:]), first):
                total = self._by_ranks(start[some], end[some], read[some], low[some], high[some])
                found = np.flatnonzero(total)
                codes.append(found + k * self.many)
                sums.append(total[found])
        return np.concatenate(codes), np.concatenate(sums)

    def _by_pairs(self, start: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own + feature, count) of blocks, each pair of a block and a target looked at."""
        for at, stop, n, target in _pairs(low, high):
            hit = np.flatnonzero(self.end[target] > np.repeat(start[at:stop], n))
            code = np.repeat(own[at:stop] - own[at], n)[hit] + self.of[target[hit]]
            size = int(own[stop - 1] - own[at]) + self.many
            if size <= 8 * len(code) + 1024:
                total = np.bincount(code, minlength=size)
                code = np.flatnonzero(total)
                total = total[code]
            else:
                code, total = np.unique(code, return_counts=True)
            yield code + own[at], total

    def _by_ranks(self, start: np.ndarray, end: np.ndarray, read: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Counts by feature of one cell's blocks: of each target the reads that start before its end, less
        those that end before its start, less those with a gap that holds it."""
        many, by_pairs = len(self.start), None
        odd = np.isin(read, read[end <= start]) if (end <= start).any() else None  # empty blocks meet what holds them
        if odd is not None:
            by_pairs = self._by_pairs(start[odd], np.zeros(odd.sum(), np.int64), low[odd], high[odd])
            start, end, read = start[~odd], end[~odd], read[~odd]
        later = read[1:] == read[:-1]
        left, right = start, end
        if later.any():
            lift = (read - read[0]) * (int(end.max()) - int(end.min()) + 1)
            right = np.maximum.accumulate(end + lift) - lift
            gaps = np.flatnonzero(later & (start[1:] > right[:-1]))
            gap_low, gap_high = right[gaps], start[gaps + 1]
            left, right = start[np.append(True, ~later)], right[np.append(~later, True)]
        total = np.cumsum(np.bincount(np.searchsorted(self.ends, left, "right"), minlength=many + 1))[self.rank]
        total -= np.cumsum(np.bincount(np.searchsorted(self.start, right, "left"), minlength=many + 1))[:many]
        if later.any():
            for at, stop, n, target in _pairs(np.searchsorted(self.start, gap_low, "left"), np.searchsorted(self.start, gap_high, "left")):
                held = target[self.end[target] <= np.repeat(gap_high[at:stop], n)]
                if len(held):
                    total -= np.bincount(held, minlength=many)
        if not self.same:
            total = np.bincount(self.of, total, minlength=self.many).astype(np.int64)
        for code, more in by_pairs or ():
            total[code] += more
        return total


def _pairs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Passes over the ranges from low to high: from and to, sizes of these ranges, and all that lies in them, PAIRS at
    most unless one range has more."""
    ends = np.cumsum(high - low)
    at = 0
    while at < len(low):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = high[at:stop] - low[at:stop]
        yield at, stop, n, np.arange(n.sum()) + np.repeat(low[at:stop] - np.cumsum(n) + n, n)
        at = stop


def _flat(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all blocks of a list array, and whose they are."""
    many = np.diff(blocks.offsets.to_numpy())
    flat = blocks.flatten()
    return flat.field("start").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(many)), many)


def _runs(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """From and to of the rows between which no column changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new).tolist()
    return zip(starts, [*starts[1:], len(new)][: len(starts)], strict=True)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features sorted by tile: those of a tile in a batch as one row with a compressed `bundle`, few as they are."""
    for b in batches:
        kinds, places = b.schema, ("chrom", "step", "tile")
        chrom = b.column("chrom").dictionary_encode().indices.to_numpy()
        plain, rows, bundles = [], [], []
        for at, stop in _runs([chrom, b.column("step").to_numpy(), b.column("tile").to_numpy()]):
            if stop - at < BUNDLE:
                plain.extend(range(at, stop))
            else:
                rows.append(at)
                whole = b.slice(at, stop - at).select(FEATURE).serialize()
                bundles.append(whole.size.to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True))
        few, many = b.take(pa.array(plain, pa.int64())), b.select(places).take(pa.array(rows, pa.int64()))
        none = lambda kind, x: pa.nulls(x.num_rows, kind)
        names = [*places, *FEATURE, "bundle"]
        for x, found in ((few, [*(few.column(c) for c in FEATURE), none(pa.binary(), few)]), (many, [*(none(kinds.field(c).type, many) for c in FEATURE), pa.array(bundles, pa.binary())])):
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in places), *found], names=names)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with each bundle replaced by its features."""
    for b in batches:
        bundles, kinds = b.column("bundle"), b.schema.remove(b.schema.get_field_index("bundle"))
        b = b.select(kinds.names)
        at = 0
        for k in np.flatnonzero(bundles.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if k > at:
                yield b.slice(at, k - at)
            bundle = bundles[k].as_buffer()
            whole = pa.decompress(bundle[8:], int.from_bytes(bundle[:8].to_pybytes(), "little"), "zstd")
            held = pa.ipc.read_record_batch(whole, pa.schema([kinds.field(c) for c in FEATURE]))
            same = [0] * held.num_rows
            row = b.slice(k, 1)
            yield pa.RecordBatch.from_arrays([held.column(c) if c in FEATURE else row.column(c).take(pa.array(same)) for c in kinds.names], schema=kinds)
            at = k + 1
        if at < b.num_rows:
            yield b.slice(at)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Tile, pa.Array, np.ndarray, np.ndarray]]:
    """Rows sorted by tile, the tile's features before its reads and these by cell: the tile, names of
    cells, and in ascending order cell * features + feature with its count. A cell's counts are held until its last read."""
    key, features, tile = None, [], None
    held: tuple | None = None  # the last cell seen: its name, its counts by feature

    def rest() -> Iterator[tuple[_Tile, pa.Array, np.ndarray, np.ndarray]]:
        nonlocal held
        if held is not None:
            found = np.flatnonzero(held[1])
            yield tile, held[0], found, held[1][found]
        held = None

    for b in batches:
        chrom = b.column("chrom").dictionary_encode()
        parts = [chrom.indices.to_numpy(), *(b.column(c).to_numpy() for c in ("step", "tile", "part"))]
        reads = b.column("is_read").to_numpy(zero_copy_only=False)
        for at, stop in _runs([*parts, reads]):
            own = (chrom.dictionary[parts[0][at]].as_py(), *(x[at].item() for x in parts[1:]))
            if own != key:
                yield from rest()
                key, features, tile = own, [], None
            piece = b.slice(at, stop - at)
            if not reads[at]:
                features.append(piece)
                continue
            if not features:
                continue
            if tile is None:
                whole = pa.Table.from_batches(features)
                whole = whole.take(pc.sort_indices(whole, [("start", "ascending")])).combine_chunks()  # features met together lie together
                tile = _Tile([whole.column(c).combine_chunks() for c in ("chrom", "start", "end", "name")], whole.column("blocks").combine_chunks())
            cells = piece.column("cell_id").dictionary_encode("encode")
            names, cell = cells.dictionary, cells.indices.to_numpy()
            code, total = tile.counts(cell, len(names), piece.column("blocks"))
            if held is not None and names[0] != held[0][0]:
                yield from rest()
            if held is None:
                held = names.slice(0, 1), np.zeros(tile.many, np.int64)
            # Parts of a cell that several passes counted are summed; the last cell may go on.
            first = code < tile.many
            np.add.at(held[1], code[first], total[first])
            if len(names) > 1:
                yield from rest()
                last = code >= (len(names) - 1) * tile.many
                held = names.slice(len(names) - 1, 1), np.zeros(tile.many, np.int64)
                np.add.at(held[1], code[last] - (len(names) - 1) * tile.many, total[last])
                code, total = code[~first & ~last], total[~first & ~last]
                if (np.diff(code) <= 0).any():
                    code, place = np.unique(code, return_inverse=True)
                    total = np.bincount(place, total).astype(np.int64)
                yield tile, names, code, total
    yield from rest()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell_id, chrom, start, end, name, count of the sorted rows that _sums takes."""
    for tile, names, code, total in _sums(batches):
        for k in range(0, len(code), BATCH_ROWS):
            part = code[k : k + BATCH_ROWS]
            feature = pa.array(part % tile.many)
            columns = [c.take(feature) for c in tile.columns]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(part // tile.many)), *columns, pa.array(total[k : k + BATCH_ROWS].astype(np.float64))], names=["cell_id", "chrom", "start", "end", "name", "count"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, up to 2 ** PACK counts to a row: chrom, the cells and features that they name, each
    once, and each count above PACK bits of the place of its cell and PACK of that of its feature."""
    size = 1 << PACK
    for tile, names, code, total in _sums(batches):
        chrom, *columns = tile.columns
        for k in range(0, len(code), 8 * size):
            rows = []
            for at in range(k, min(k + 8 * size, len(code)), size):
                cell, feature = np.divmod(code[at : at + size], tile.many)
                # A row names no more cells and features than it has counts.
                named = columns
                if tile.many > len(feature):
                    own, feature = np.unique(feature, return_inverse=True)
                    named = [c.take(pa.array(own)) for c in columns]
                new = np.append(True, cell[1:] != cell[:-1])
                packed = ((total[at : at + size] << PACK) + np.cumsum(new) - 1 << PACK) + feature
                rows.append((names.take(pa.array(cell[new])), *named, pa.array(packed)))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.concat_arrays(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([chrom.slice(0, 1).take(pa.array([0] * len(rows))), *lists], names=["chrom", "cells", "starts", "ends", "names", "packed"])


def count_features(reads: DataFrame, regions: DataFrame, exons: bool = False, binarize: bool = False, tile: int = TILE) -> DataFrame:  # J2, A4
    """cell_id, chrom, start, end, name, count. A read counts once in each feature that
    one of its blocks overlaps; with `exons`, once in each such exon, summed.

    A feature belongs to the tile of its first base, with tiles at least SHARE times as long as
    it (some lengths of tiles, each STEPS times the one before); a read goes to the tiles of its
    blocks and, if the longest feature of that length of tiles can reach it from there, to those
    before, so most reads travel once for each length. The features of a tile travel to its parts
    in bundles. All reads of a cell that a feature meets thus come together,
    and each tile is counted where its sorted rows stream by: the pairs are neither shuffled
    nor aggregated, only the result leaves. With `exons` it leaves Python packed, with each cell
    and feature named once for many counts, and is spread out by Spark.
    """
    spark = reads.sparkSession
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    targets = F.coalesce("exons", F.array()) if exons else F.array(span)
    f = regions.filter("chrom is not null").select("chrom", "start", "end", "name", targets.alias("blocks"))
    # Dealt by place, so that the features of a tile lie in few partitions however many there are; grouping needs no other shuffle.
    f = f.withColumn("zone", F.floor(F.col("start") / (tile * STEPS))).repartition("chrom", "zone")
    f = f.groupBy("chrom", "zone", "start", "end", "name").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    f = f.withColumn("blocks", _whole(F.filter("blocks", lambda b: b["end"] > b["start"]))).filter(F.size("blocks") > 0)
    low, high = F.array_min(F.transform("blocks", lambda b: b["start"])), F.array_max(F.transform("blocks", lambda b: b["end"]))
    steps = [tile * STEPS**k for k in range(1, 12)]
    step = F.lit(steps[-1])
    for s in reversed(steps[:-1]):
        step = F.when(high - low <= s // SHARE, s).otherwise(step)
    f = f.withColumn("step", step.cast("long")).withColumn("tile", F.floor(low / F.col("step")))
    # As many rows as there are lengths of tiles; no read is sent where there are no features.
    present = f.groupBy("step").agg(F.min("tile").alias("_low"), F.max("tile").alias("_high"), F.max(high - low).alias("_longest"))
    f = f.select("chrom", "step", "tile", *FEATURE).sortWithinPartitions("chrom", "step", "tile", "start")
    f = f.mapInArrow(_bundled, T.StructType([*(T.StructField(c.name, c.dataType) for c in f.schema), T.StructField("bundle", T.BinaryType())]))
    f = f.withColumn("is_read", F.lit(False)).withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(CELL_PARTS)])))
    r = reads.filter("chrom is not null").select(cell_id().alias("cell_id"), "chrom", _whole(_known("blocks")).alias("blocks"))
    r = r.filter(F.size("blocks") > 0).withColumn("part", F.pmod(F.xxhash64("cell_id"), F.lit(CELL_PARTS)).cast("int")).withColumn("is_read", F.lit(True))
    r = r.crossJoin(F.broadcast(present))

    def touched(b: Column) -> Column:
        return F.sequence(F.floor((b["start"] - F.col("_longest") + 1) / F.col("step")), F.floor((F.greatest(b["end"], b["start"] + 1) - 1) / F.col("step")))

    tiles = F.when(F.size("blocks") == 1, touched(F.get("blocks", F.lit(0)))).otherwise(F.array_distinct(F.flatten(F.transform("blocks", touched))))
    r = r.withColumn("tile", F.explode(tiles)).filter("tile between _low and _high").drop("_low", "_high", "_longest")
    x = f.unionByName(r, allowMissingColumns=True)
    places = ["chrom", "step", "tile", "part"]
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    x = x.repartition(many, *places).sortWithinPartitions(*places, "is_read", "cell_id")
    kinds = regions.schema
    types = [T.StringType(), *[kinds[c].dataType for c in ("chrom", "start", "end", "name")], T.DoubleType()]
    if exons:
        cells, chrom, *of_features, _ = types
        arrays = [T.StructField(c, T.ArrayType(t)) for c, t in zip(("cells", "starts", "ends", "names"), (cells, *of_features), strict=True)]
        out = x.mapInArrow(lambda rows: _packed(_opened(rows)), T.StructType([T.StructField("chrom", chrom), *arrays, T.StructField("packed", T.ArrayType(T.LongType(), False))])).withColumn("_p", F.explode("packed"))
        places = F.lit((1 << PACK) - 1)
        feature, cell = F.col("_p").bitwiseAND(places).cast("int"), F.shiftright("_p", PACK).bitwiseAND(places).cast("int")
        of = {"start": F.get("starts", feature), "end": F.get("ends", feature), "name": F.get("names", feature), "count": F.shiftright("_p", 2 * PACK).cast("double")}
        out = out.select(F.get("cells", cell).alias("cell_id"), "chrom", *[v.alias(c) for c, v in of.items()])
    else:
        out = x.mapInArrow(lambda rows: _counted(_opened(rows)), T.StructType(list(map(T.StructField, ("cell_id", "chrom", "start", "end", "name", "count"), types))))
    return out.withColumn("count", F.lit(1.0)) if binarize else out


def _known(blocks: str) -> Column:
    """The blocks whose start and end are known; one block, as most reads have, needs no loop."""
    one = F.get(blocks, F.lit(0))
    whole = (F.size(blocks) == 1) & one["start"].isNotNull() & one["end"].isNotNull()
    return F.when(whole, F.col(blocks)).otherwise(F.filter(blocks, lambda b: b["start"].isNotNull() & b["end"].isNotNull()))


def _whole(blocks: Column) -> Column:
    return blocks.cast("array<struct<start:bigint,end:bigint>>")


def sum_bases(reads: DataFrame, size: int) -> DataFrame:  # A3
    """cell_id, chrom, bin, bases: covered bases of each bin, by exact overlap."""
    x = reads.withColumn("b", F.explode("blocks"))
    x = x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("b.start") / size), F.floor((F.col("b.end") - 1) / size))))
    shared = F.least(F.col("b.end"), (F.col("bin") + 1) * size) - F.greatest(F.col("b.start"), F.col("bin") * size)
    return x.groupBy(cell_id().alias("cell_id"), "chrom", "bin").agg(F.sum(shared).cast("long").alias("bases"))


def zero_filled(counts: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:  # A6
    """Every (cell, feature); on request only, as it has cells x features rows."""
    grid = cells.select("cell_id").distinct().crossJoin(features.select("feature_id").distinct())
    return grid.join(counts, ["cell_id", "feature_id"], "left").fillna(0.0, ["count"])


def zeros_to_nan(counts: DataFrame, column: str = "count") -> DataFrame:  # A7
    return counts.withColumn(column, F.when(F.col(column) == 0, F.lit(float("nan"))).otherwise(F.col(column)))


def without_zero_rows(counts: DataFrame) -> DataFrame:  # A8
    """Features whose counts are not all zero or NaN."""
    total = counts.groupBy("feature_id").agg(F.sum(F.nanvl(F.col("count"), F.lit(0.0))).alias("_s")).filter("_s <> 0")
    return counts.join(total, "feature_id", "left_semi")


def size_factors(counts: DataFrame) -> DataFrame:  # A18
    """cell_id, size_factor: exp(-median over features of ln count - mean ln count).

    Only features counted in every cell enter, as the geometric mean of the others is 0.
    """
    nz = counts.filter("count > 0")
    cells = nz.select("cell_id").distinct().count()
    per = nz.groupBy("feature_id").agg(F.avg(F.ln("count")).alias("g"), F.count("*").alias("n")).filter(F.col("n") == cells)
    x = nz.join(per, "feature_id")
    return x.groupBy("cell_id").agg(F.exp(-F.percentile(F.ln("count") - F.col("g"), F.lit(0.5))).alias("size_factor"))


def matrix(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # K1
    """(counts, obs, var) of a bin or feature count table."""
    name = F.col("name") if "name" in counts.columns else F.lit(None).cast("string")
    x = counts.withColumn("name", name).withColumn("feature_id", feature_id(name="name") if "name" in counts.columns else feature_id())
    obs = x.select("cell_id", F.split("cell_id", "::")[0].alias("sample"), F.split("cell_id", "::")[1].alias("barcode")).distinct()
    return x.select("cell_id", "feature_id", "count"), obs, x.select("feature_id", "chrom", "start", "end", "name").distinct()


def top_features(counts: DataFrame, n: int) -> DataFrame:  # O3
    """The n features of the greatest median count over the cells that have them."""
    m = counts.groupBy("feature_id").agg(F.percentile("count", F.lit(0.5)).alias("median"))
    return m.orderBy(F.desc("median"), "feature_id").limit(n)


def rank_within(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
