"""The tools' analyses end to end on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from cellweave import views as V
from cellweave.operators import predicates as P
from cellweave.operators import qc
from cellweave.plans import analyses as A
from cellweave.sources import sinks

D = "/root/testdata/sf0.001"
KEEP = P.ReadFilter(min_mapq=3, flag_exclude=256)


def test_counting(spark, tmp_path):
    from cellweave.operators import counts

    reads, contigs = V.reads(spark, D), V.contigs(spark, D)
    bins = A.count_reads(reads, contigs, 1000, filter=KEEP, barcodes=V.barcodes(spark, D), dedup_key="start_bc_umi", blacklist=V.blacklist(spark, D))
    assert bins.count() > 0 and bins.filter("count <= 0").count() == 0
    once = A.count_reads(reads, contigs, 1000, filter=KEEP, binarize=True).agg(F.sum("count")).first()[0]
    assert once <= A.count_reads(reads, contigs, 1000, filter=KEEP).agg(F.sum("count")).first()[0]
    features = A.count_reads(reads, contigs, regions=V.regions(spark, D), filter=KEEP)
    assert set(features.columns) == {"cell_id", "chrom", "start", "end", "name", "count"}
    spaced = A.count_reads(reads, contigs, 500, distance=500, filter=KEEP)
    assert {r[0] % 1000 for r in spaced.select("start").distinct().collect()} == {0}
    parts = counts.matrix(bins)
    sinks.write_matrix(*parts, str(tmp_path / "m"))
    assert [x.count() for x in sinks.read_matrix(spark, str(tmp_path / "m"))] == [x.count() for x in parts]


def test_statistics(spark):
    reads, contigs = V.reads(spark, D), V.contigs(spark, D)
    cells = reads.select("sample", "bc").distinct()
    x = A.filter_stats(reads, cells, KEEP, contigs, 1000, 500, dedup_key="start_bc", blacklist=V.blacklist(spark, D), motif=(V.genome(spark, D), [("A", "TA")]))
    r = x.agg(F.min("Filtered"), F.max("Filtered"), F.max("Wrong_motif")).first()
    assert 0 <= r[0] <= r[1] <= 100 and r[2] > 50
    b = A.filter_barcodes(reads, contigs, 1000, min_count=5, min_mapq=2, whitelist=V.barcodes(spark, D), distance=1, blacklist=V.blacklist(spark, D))
    assert b.filter("selected").count() > 0 and b.agg(F.min("rank")).first()[0] == 1
    j = A.jensen_shannon(reads, contigs, 60, 500, KEEP)
    assert 0 <= j.agg(F.min("jsd")).first()[0] <= j.agg(F.max("jsd")).first()[0] <= 1


@pytest.mark.parametrize("how", ["CPM", "Mean", "Frequency", "None"])
def test_tracks(spark, how):
    x = A.bulk_coverage(V.reads(spark, D), V.groups(spark, D), 500, how, scale=2.0, filter=KEEP, dedup_key="start_bc").filter("start < 0 or end <= start or value <= 0")
    assert x.count() == 0
    y = A.bulk_coverage(V.reads(spark, D), V.groups(spark, D), 500, how, smooth=3, filter=P.ReadFilter(strand="forward"))
    assert y.count() > 0


def test_quality_and_clusters(spark):
    matrix = V.counts(spark, D)
    cells, features = A.count_qc(matrix)
    assert {"gini", "total_counts"} <= set(cells.columns) and "mean_counts" in features.columns
    assert qc.totals(matrix).first()[0] == cells.count()
    both = A.combine_counts({"a": matrix, "b": matrix})
    assert both.count() == 2 * matrix.count()
    vectors, labels, graph = A.cluster_cells(matrix, "logPCA", k=3, neighbours=4)
    assert vectors.count() == labels.count() == cells.count() and graph.columns == ["a", "b", "weight"]
    joint = A.cluster_multimodal({"x": matrix, "y": matrix.filter("count > 1").unionByName(matrix.filter("count = 1"))}, "logPCA", 3, 4)
    assert joint.count() == cells.count()
