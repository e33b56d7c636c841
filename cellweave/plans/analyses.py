"""The command-line tools' analyses as functions: each is one lazy plan of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import combine, counts, coverage, dedup, fragments, graph, intervals, qc, reduction, signal, stats
from ..operators import predicates as P
from ..schema import cell_id
from ..storage import checkpointed


def prepared(
    reads: DataFrame, options: P.ReadFilter, barcodes: DataFrame | None = None, dedup_key: str | None = None, blacklist: DataFrame | None = None,
    motif: tuple[DataFrame, Sequence[tuple[str, str]]] | None = None, fragment: Column | None = None, offset: tuple[int, int] | None = None,
) -> DataFrame:
    """Filter, whitelist, drop adjacent duplicates, then replace blocks by fragments."""
    x = P.read_filter(reads, options)
    if motif:
        x = P.motif(x, *motif).filter("motif_ok").drop("motif_ok")
    if barcodes is not None:
        x = P.whitelisted(x, barcodes)
    if dedup_key:
        x = dedup.drop_adjacent(x, dedup_key)
    chosen = fragments.strand_offset(options.strand, offset)
    x = fragments.with_fragments(x, fragments.offset(*chosen) if chosen else fragment)
    if blacklist is not None:
        spans = x.select("sample", "chrom", "read_seq", "query_name", F.explode("blocks").alias("b")).select("sample", "chrom", "read_seq", "query_name", F.col("b.start").alias("start"), F.col("b.end").alias("end"))
        bad = intervals.overlap_join(spans, blacklist.select("chrom", "start", "end"), "left_semi").select("sample", "read_seq", "query_name").distinct()
        x = x.join(bad, ["sample", "read_seq", "query_name"], "left_anti")
    return x


def count_reads(reads: DataFrame, contigs: DataFrame, bin_size: int = 10_000, distance: int = 0, regions: DataFrame | None = None, exons: bool = False, binarize: bool = False, **options) -> DataFrame:
    """Counts per cell and bin, spaced bin or feature. `options` go to `prepared`."""
    x = prepared(reads, options.pop("filter", P.ReadFilter()), **options)
    if regions is not None:
        return counts.count_features(x, regions, exons, binarize)
    if distance:
        y = intervals.to_spaced_bins(x, bin_size, distance, contigs).groupBy(cell_id().alias("cell_id"), "chrom", "bin").agg(F.count("*").cast("double").alias("count"))
        return intervals.bin_regions(y, contigs, bin_size, bin_size + distance)
    return counts.count_bins(x, bin_size, contigs, binarize)


def filter_stats(reads: DataFrame, cells: DataFrame, options: P.ReadFilter, contigs: DataFrame, bin_size: int = 100_000, distance: int = 1_000_000, percent: bool = True, **more) -> DataFrame:
    """The 13 counters of each cell over sampled chunks, as counts or percentages."""
    table = stats.filter_statistics(reads, cells, options, sampling=(contigs, bin_size, distance), **more)
    return stats.as_percent(table) if percent else table


def filter_barcodes(reads: DataFrame, contigs: DataFrame, bin_size: int = 100_000, min_count: int = 0, min_mapq: int | None = None, whitelist: DataFrame | None = None, distance: int = 0, blacklist: DataFrame | None = None) -> DataFrame:
    """bc, count, selected, rank, log10_count."""
    x = reads.filter(P.mapped() & P.has_tag() & P.min_mapq(min_mapq))
    if blacklist is not None:
        x = intervals.without_blacklisted(intervals.read_span(x.select("bc", "chrom", "start", "end", "query_len")), blacklist)
    if whitelist is not None:
        near = P.hamming_barcodes(x, whitelist, distance).select("bc")
        x = x.join(near, "bc", "left_semi")
    per = stats.bins_per_barcode(x, bin_size)
    bins = contigs.agg(F.sum(F.ceil(F.col("length") / bin_size))).first()[0] or 0
    return stats.select_barcodes(per, min_count, bins).join(stats.knee(per).drop("count"), "bc")


def jensen_shannon(reads: DataFrame, contigs: DataFrame, samples: int = 100_000, bin_size: int = 10_000, filter: P.ReadFilter | None = None) -> DataFrame:
    """Distance of each cell's coverage over about `samples` bins from a Poisson cell's."""
    stride = max(intervals.sample_stride(contigs, samples), bin_size)
    x = P.read_filter(reads, filter or P.ReadFilter())
    covered = counts.sum_bases(intervals_in(x, stride, bin_size), stride).filter("bases > 0")
    bins = contigs.agg(F.sum(F.ceil(F.col("length") / stride))).first()[0] or 0
    return signal.jensen_shannon(covered, int(bins))


def intervals_in(reads: DataFrame, stride: int, size: int) -> DataFrame:
    """Blocks cut to the first `size` bases of each stride."""
    if stride == size:
        return reads
    cut = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                F.sequence(F.floor(b["start"] / stride), F.floor((b["end"] - 1) / stride)),
                lambda k: F.struct(F.greatest(b["start"], k * stride).alias("start"), F.least(b["end"], k * stride + size).alias("end")),
            ),
        )
    )
    return reads.withColumn("blocks", F.filter(cut, lambda b: b["end"] > b["start"]))


def bulk_coverage(reads: DataFrame, groups: DataFrame, bin_size: int = 100, normalize: str = "CPM", scale: float = 1.0, smooth: int = 0, ignore: Sequence[str] = (), skip_zeros: bool = True, **options) -> DataFrame:
    """cluster, chrom, start, end, value: run-length merged tracks of each group.
    normalize: CPM, Mean, Frequency or None."""
    x = prepared(reads, options.pop("filter", P.ReadFilter()), **options)
    c = coverage.group_coverage(counts.count_bins(x, bin_size, binarize=normalize == "Frequency"), groups)
    if normalize == "CPM":
        c = coverage.cpm(c, ignore)
    elif normalize in ("Mean", "Frequency"):
        c = coverage.mean(c, groups)
    c = coverage.smoothed(c, smooth) if smooth > 1 else c
    c = coverage.scaled(c, scale) if scale != 1 else c
    c = coverage.without_zero_bins(c) if skip_zeros else c
    c = c.withColumn("start", F.col("bin") * bin_size).withColumn("end", (F.col("bin") + 1) * bin_size)
    return intervals.run_length(c, ["cluster", "chrom"])


def count_qc(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell metrics with gini, feature metrics)."""
    return qc.cell_metrics(matrix).join(qc.gini(matrix), "cell_id", "left"), qc.feature_metrics(matrix)


def combine_counts(tables: dict[str, DataFrame], method: str = "multi-sample") -> DataFrame:
    return combine.stack(tables) if method == "multi-sample" else combine.with_modality(tables)


def embedded(matrix: DataFrame, method: str = "LSA", k: int = 20, family: str = "poisson", binarize: bool = False) -> DataFrame:
    """cell_id, vector by logPCA, LSA, LDA or glmPCA."""
    x = reduction.binarized(matrix) if binarize else matrix
    if method == "logPCA":
        return reduction.pca(reduction.log1p(reduction.normalized(x)), k)
    if method == "LSA":
        return reduction.lsa(reduction.tfidf(x), k)
    if method == "LDA":
        return reduction.cell_topics(reduction.lda(x, k), k)
    if method == "glmPCA":
        return reduction.GLMPCA(k, family).fit(x).transform()
    raise ValueError(method)


def cluster_cells(matrix: DataFrame, method: str = "LSA", k: int = 20, neighbours: int = 30, resolution: float = 1.0, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, labels, cluster graph)."""
    vectors = embedded(matrix, method, k, **options)
    edges = checkpointed(graph.symmetric(graph.nearest_by_lists(vectors, neighbours)))
    labels = graph.clusters(edges, resolution)
    return vectors, labels, graph.abstracted(edges, labels)


def cluster_multimodal(modalities: dict[str, DataFrame], method: str = "logPCA", k: int = 20, neighbours: int = 30, resolution: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """node, label from all modalities, over the cells that each of them has."""
    common = combine.common_cells(combine.with_modality(modalities))
    layers = {}
    for name, m in modalities.items():
        vectors = embedded(m.join(common, "cell_id", "left_semi"), method, k)
        layers[name] = (checkpointed(graph.symmetric(graph.nearest_by_lists(vectors, neighbours))), (weights or {}).get(name, 1.0))
    return graph.clusters(layers, resolution)
