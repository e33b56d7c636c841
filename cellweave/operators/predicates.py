"""Filters and projections on reads (P1-P25). Each predicate is a Column; `read_filter`
chains them cheap-first, as Catalyst does not reorder conjuncts by cost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DUPLICATE, MATE_REVERSE, MATE_UNMAPPED, PAIRED, PROPER, READ2, REVERSE, UNMAPPED, has, lacks


def mapped() -> Column:  # P1
    return lacks(UNMAPPED)


def min_mapq(least: int | None) -> Column:  # P2
    return F.lit(True) if not least else F.col("mapq") >= least


def flag_include(mask: int | Sequence[int] | None) -> Column:  # P3
    return F.lit(True) if not mask else has(_or(mask))


def flag_exclude(mask: int | Sequence[int] | None) -> Column:  # P4
    return F.lit(True) if not mask else lacks(_or(mask))


def _or(mask: int | Sequence[int]) -> int:
    out = 0
    for m in [mask] if isinstance(mask, int) else mask:
        out |= m
    return out


def read_length() -> Column:  # F11
    """Aligned query bases: operations that consume the query (M, I, =, X)."""
    return F.aggregate(F.filter("cigar", lambda c: c["op"].isin(0, 1, 7, 8)), F.lit(0), lambda a, c: a + c["len"])


def fragment_length() -> Column:
    """|template length| of a pair; the read's own length without one."""
    return F.when(has(PAIRED) & (F.col("tlen") != 0), F.abs("tlen")).otherwise((F.col("end") - F.col("start")).cast("int"))


def fragment_bounds(least: int = 0, most: int = 0) -> Column:  # P5
    out = F.lit(True)
    if least > 0:
        out = out & (fragment_length() >= least)
    if most > 0:
        out = out & (fragment_length() <= most)
    return out


def gc_content(seq: str | Column = "fwd_seq") -> Column:
    """Share of C and G, upper case only, N counted in the length; null for no bases."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.length(F.regexp_replace(s, "[^CG]", "")) / F.nullif(F.length(s), F.lit(0))


def gc_between(low: float, high: float) -> Column:  # P7
    return gc_content().between(low, high)


def aligned_fraction() -> Column:
    matched = F.aggregate(F.filter("cigar", lambda c: c["op"] == 0), F.lit(0), lambda a, c: a + c["len"])
    return matched / F.nullif(F.col("query_len"), F.lit(0))


def min_aligned_fraction(least: float | None) -> Column:  # P8
    return F.lit(True) if not least else aligned_fraction() >= least


def has_tag(tag: str = "bc") -> Column:  # P9
    return F.col(tag).isNotNull()


def strand(which: str) -> Column:  # P12
    """dUTP libraries: the transcript's strand is the second mate's."""
    f = F.col("flag")
    masked = lambda mask, value: f.bitwiseAND(F.lit(mask)) == value
    paired = {
        "forward": masked(READ2 | REVERSE, READ2) | masked(64 | MATE_REVERSE, 64),
        "reverse": masked(READ2 | REVERSE, READ2 | REVERSE) | masked(64 | MATE_REVERSE, 64 | MATE_REVERSE),
    }
    single = {"forward": has(REVERSE), "reverse": lacks(REVERSE)}
    return F.when(has(PAIRED), paired[which]).otherwise(single[which])


def duplicate_mark() -> Column:  # P13
    return has(DUPLICATE)


def singleton() -> Column:  # P14
    return has(PAIRED | MATE_UNMAPPED)


def not_chroms(names: Sequence[str]) -> Column:  # P16
    return ~F.col("chrom").isin(*names) if names else F.lit(True)


def proper_pair(most: int) -> Column:  # P17
    """Marked proper, same contig, short enough, mates on opposite strands facing inward."""
    rev, mate_rev = has(REVERSE), has(MATE_REVERSE)
    inward = F.when(rev, F.col("mate_start") <= F.col("start")).otherwise(F.col("mate_start") >= F.col("start"))
    return has(PROPER) & (F.col("mate_chrom") == F.col("chrom")) & (F.abs("tlen") <= most) & (rev != mate_rev) & inward


def in_sample(bin_size: int, distance: int) -> Column:  # P18
    """Start within the counted head of its chunk of bin_size + distance bases. Needs
    `length` of the contig: a last chunk shorter than both sizes is counted whole."""
    chunk = bin_size + distance
    begin = F.floor(F.col("start") / chunk) * chunk
    end = F.least(begin + chunk, F.col("length"))
    head = F.when((end - begin > bin_size) & (end - begin > distance), end - distance).otherwise(end)
    return F.col("start") < head


def motif(reads: DataFrame, genome: DataFrame, pairs: Sequence[tuple[str, str]], tile: int = 1000) -> DataFrame:  # P6
    """Adds `motif_ok`: for some (read motif, reference motif), the read begins with the
    one and the reference has the other around its 5' end: the bases up to and with
    the first one; for reverse reads the last base and those after it. The genome
    comes in tiles; a context takes one or two, looked up by an equi-join each."""
    rev = has(REVERSE)
    size = max(len(r) for _, r in pairs)
    at = F.when(rev, F.col("end") - 1).otherwise(F.col("start") - (size - 1))
    x = reads.withColumn("_from", F.greatest(at, F.lit(0))).withColumn("_tile", F.floor(F.col("_from") / tile))
    g = genome.select(F.col("chrom").alias("_c"), F.col("tile").alias("_t"), F.col("seq"))
    here = g.withColumnRenamed("seq", "_s0")
    after = g.select(F.col("_c").alias("_c1"), (F.col("_t") - 1).alias("_t1"), F.col("seq").alias("_s1"))
    x = x.join(here, (F.col("chrom") == F.col("_c")) & (F.col("_tile") == F.col("_t")), "left")
    x = x.join(after, (F.col("chrom") == F.col("_c1")) & (F.col("_tile") == F.col("_t1")), "left")
    span = F.concat(F.coalesce("_s0", F.lit("")), F.coalesce("_s1", F.lit("")))
    ok = F.lit(False)
    for read, ref in pairs:
        begin = F.when(rev, F.col("end") - 1).otherwise(F.col("start") - (len(ref) - 1))
        context = F.when(begin >= 0, F.substring(span, (begin - F.col("_tile") * tile + 1).cast("int"), F.lit(len(ref)))).otherwise("")
        ok = ok | ((F.substring("fwd_seq", 1, len(read)) == read) & (context == ref))
    return x.withColumn("motif_ok", F.coalesce(ok, F.lit(False))).select(*reads.columns, "motif_ok")


@dataclass(frozen=True)
class ReadFilter:
    """Options of the read filters; `column()` is their conjunction, cheap-first."""

    min_mapq: int | None = None
    flag_include: int | tuple[int, ...] | None = None
    flag_exclude: int | tuple[int, ...] | None = None
    min_fragment: int = 0
    max_fragment: int = 0
    gc: tuple[float, float] | None = None
    min_aligned: float | None = None
    strand: str | None = None
    skip_chroms: tuple[str, ...] = ()
    tag: str = "bc"

    def column(self) -> Column:
        tests = [
            mapped(), not_chroms(self.skip_chroms), min_mapq(self.min_mapq), flag_include(self.flag_include), flag_exclude(self.flag_exclude),
            fragment_bounds(self.min_fragment, self.max_fragment), has_tag(self.tag),
        ]
        if self.strand:
            tests.append(strand(self.strand))
        if self.gc:
            tests.append(gc_between(*self.gc))
        if self.min_aligned:
            tests.append(min_aligned_fraction(self.min_aligned))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def read_filter(reads: DataFrame, options: ReadFilter) -> DataFrame:
    return reads.filter(options.column())


def whitelisted(reads: DataFrame, barcodes: DataFrame, on: str = "bc") -> DataFrame:  # P10
    return reads.join(barcodes.select(F.col("bc").alias(on)).distinct(), on, "left_semi")


def in_groups(reads: DataFrame, labels: DataFrame) -> DataFrame:  # P11
    """labels: (grp, bc)."""
    return reads.join(labels.select("grp", "bc").distinct(), ["grp", "bc"], "left_semi")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def hamming_barcodes(observed: DataFrame, whitelist: DataFrame, most: int) -> DataFrame:  # P19
    """Distinct observed barcodes (bc) within `most` substitutions of a listed one:
    bc, nearest (least distance, then name), distance.

    Not a cross join: with d substitutions one of d + 1 pieces is unchanged, so pairs
    meet by (length, piece number, piece) and are verified.
    """

    def pieces(c: str) -> Column:
        n = F.length(c)
        parts = [
            F.struct(F.lit(k).alias("k"), n.alias("n"), F.substring(c, F.floor(n * k / (most + 1)).cast("int") + 1, (F.floor(n * (k + 1) / (most + 1)) - F.floor(n * k / (most + 1))).cast("int")).alias("piece"))
            for k in range(most + 1)
        ]
        return F.explode(F.array(*parts))

    left = observed.select("bc").distinct().select("bc", pieces("bc").alias("x"))
    right = whitelist.select(F.col("bc").alias("listed")).distinct().select("listed", pieces("listed").alias("x"))
    pairs = left.join(right, "x").select("bc", "listed").distinct().withColumn("distance", hamming(F.col("bc"), F.col("listed")))
    best = pairs.filter(F.col("distance") <= most).groupBy("bc").agg(F.min(F.struct("distance", "listed")).alias("b"))
    return best.select("bc", F.col("b.listed").alias("nearest"), F.col("b.distance").alias("distance"))


def observed_barcodes(reads: DataFrame) -> DataFrame:  # P20
    return reads.filter(has_tag()).select("bc").distinct()


def shift_reads(reads: DataFrame, contigs: DataFrame, plus: tuple[int, int] = (4, -5), minus: tuple[int, int] | None = None) -> DataFrame:  # P21
    """Moves both ends of proper pairs' fragments, clipped to the contig; reads left
    without a base go. The cigar becomes one match. ATAC: 4 at the fragment's start, -5
    at its end. `minus` are the shifts for fragments whose first mate is reverse."""
    minus = minus or plus
    rev, second = has(REVERSE), has(READ2)
    flipped = rev != second  # the first mate of the fragment is the reverse one
    head, tail = F.when(flipped, minus[0]).otherwise(plus[0]), F.when(flipped, minus[1]).otherwise(plus[1])
    x = reads.filter(has(PROPER | PAIRED) & mapped()).join(F.broadcast(contigs.select("chrom", "length")), "chrom")
    begin = F.when(rev, F.col("start")).otherwise(F.col("start") + head)
    end = F.when(rev, F.col("end") + tail).otherwise(F.col("end"))
    x = x.withColumn("_s", F.greatest(begin, F.lit(0))).withColumn("_e", F.least(end, F.col("length"))).filter("_e > _s")
    sign = F.signum("tlen").cast("int")
    out = {
        "start": F.col("_s"), "end": F.col("_e"), "tlen": (F.col("tlen") + sign * (tail - head)).cast("int"),
        "mate_start": F.when(rev, F.greatest(F.col("mate_start") + head, F.lit(0))).otherwise(F.col("mate_start")),
        "cigar": F.array(F.struct(F.lit(0).alias("op"), (F.col("_e") - F.col("_s")).cast("int").alias("len"))),
        "blocks": F.array(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"))),
    }
    return x.select(*[out.get(c, F.col(c)).alias(c) for c in reads.columns])


def tag_groups(reads: DataFrame, groups: DataFrame) -> DataFrame:  # P22, J18
    """Adds `cluster` by (sample, barcode); reads without a group go."""
    g = groups.select("sample", F.col("barcode").alias("bc"), "cluster")
    return reads.join(g, ["sample", "bc"])


def bedpe(reads: DataFrame, contigs: DataFrame) -> DataFrame:  # P23
    """One row for each fragment, from its leftmost mate, cut at the contig's end."""
    x = reads.filter("tlen > 0").join(F.broadcast(contigs.select("chrom", "length")), "chrom")
    return x.select("chrom", "start", F.least(F.col("start") + F.col("tlen"), F.col("length")).alias("end"), "query_name", "bc")


def selected_barcodes(barcode_table: DataFrame) -> DataFrame:  # P24
    return barcode_table.filter("selected").select(F.col("barcode").alias("bc"))


def pass_fail(reads: DataFrame, options: ReadFilter) -> tuple[DataFrame, DataFrame]:  # K9
    """(reads that pass, reads that do not)."""
    ok = F.coalesce(options.column(), F.lit(False))
    return reads.filter(ok), reads.filter(~ok)


def tag_missing(reads: DataFrame, tag: str = "bc", probe: int = 1000) -> DataFrame:  # S15
    """`found`: whether any of the first `probe` reads has the tag."""
    return reads.limit(probe).agg(F.coalesce(F.bool_or(F.col(tag).isNotNull()), F.lit(False)).alias("found"))


def first_in_file(by: Sequence[str] = ("sample", "chrom")) -> Window:
    return Window.partitionBy(*by).orderBy("start", "read_seq", "query_name")
