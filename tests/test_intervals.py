"""Overlap joins against nested loops; tiles, runs, coverage."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellweave.operators import counts, coverage, intervals, qc

PLAIN = "chrom string, start bigint, end bigint, id int"
one = st.tuples(st.sampled_from("12"), st.integers(0, 60), st.integers(1, 90))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(one, max_size=12), st.lists(one, max_size=12))
def test_overlap_equals_nested_loops(spark, a, b):
    a = [(c, s, s + n, k) for k, (c, s, n) in enumerate(a)]
    b = [(c, s, s + n, k) for k, (c, s, n) in enumerate(b)]
    left, right = spark.createDataFrame(a, PLAIN), spark.createDataFrame(b, PLAIN)
    pairs = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1]}
    got = [(r["id"], r["r_id"]) for r in intervals.overlap_join(left, right, tile=2).collect()]
    assert sorted(got) == sorted(pairs)
    hit = {p[0] for p in pairs}
    assert {r["id"] for r in intervals.overlap_join(left, right, "left_semi", tile=2).collect()} == hit
    assert {r["id"] for r in intervals.overlap_join(left, right, "left_anti", tile=2).collect()} == {x[3] for x in a} - hit
    outer = [(r["id"], r["r_id"]) for r in intervals.overlap_join(left, right, "left", tile=2).collect()]
    assert sorted(outer, key=str) == sorted([*pairs, *((x[3], None) for x in a if x[3] not in hit)], key=str)


def test_region_snaps_down():
    assert intervals.region_bins("chr1", 23365000, 23385000, 10000) == (23360000, 23385000)


def test_run_length_leaves_out_nulls(spark):
    x = spark.createDataFrame([("g", "1", 0, 10, 1.0), ("g", "1", 10, 20, 1.0), ("g", "1", 20, 30, float("nan")), ("g", "1", 30, 40, 1.0), ("g", "1", 50, 60, 1.0)], "cluster string, chrom string, start bigint, end bigint, value double")
    assert [(r["start"], r["end"]) for r in intervals.run_length(x, ["cluster", "chrom"]).orderBy("start").collect()] == [(0, 20), (30, 40), (50, 60)]


def test_free_space(spark):
    contigs = spark.createDataFrame([("1", 100, 0), ("2", 50, 1)], "chrom string, length bigint, chrom_idx int")
    black = spark.createDataFrame([("1", 10, 20), ("1", 15, 30), ("1", 90, 100)], "chrom string, start bigint, end bigint")
    assert rows(intervals.free_space(contigs, black)) == [("1", 0, 10), ("1", 30, 90), ("2", 0, 50)]
    assert ("1", 30, 70) in rows(intervals.free_bins(contigs, black, 40)) and ("1", 70, 90) in rows(intervals.free_bins(contigs, black, 40))


def test_a_read_counts_once_in_each_bin(spark):
    x = spark.createDataFrame([("s", "A", "1", [(5, 15), (18, 25)])], "sample string, bc string, chrom string, blocks array<struct<start:bigint,end:bigint>>")
    got = rows(counts.count_bins(x, 10))
    assert got == [("s::A", "1", 0, 1.0), ("s::A", "1", 1, 1.0), ("s::A", "1", 2, 1.0)]
    assert {(r["bin"], r["bases"]) for r in counts.sum_bases(x, 10).collect()} == {(0, 5), (1, 7), (2, 5)}


def matrix(spark, cells):
    return spark.createDataFrame([(f"c{j}", f"f{i}", float(v)) for j, col in enumerate(cells) for i, v in enumerate(col) if v], "cell_id string, feature_id string, count double")


def test_gini(spark):
    m = matrix(spark, [[1, 1, 1, 1], [1, 0, 0, 3], [5, 0, 0, 0]])
    assert {r[0]: r[1] for r in qc.gini(m).collect()} == {"c0": 0.0, "c1": pytest.approx(0.25), "c2": None}


def test_size_factors_scale_inversely(spark):
    m = matrix(spark, [[1, 2, 3], [2, 4, 6], [0, 2, 3]])
    got = {r[0]: r[1] for r in counts.size_factors(m).collect()}
    assert got["c0"] / got["c1"] == pytest.approx(2)


def test_smoothing_window(spark):
    c = spark.createDataFrame([("g", "1", k, float(v)) for k, v in enumerate([0, 4, 0, 0])], "cluster string, chrom string, bin long, value double")
    assert [r["value"] for r in coverage.smoothed(c, 4).orderBy("bin").collect()] == [1.0, 1.0, 1.0, 1.0]
    assert coverage.smoothed(c, 1).orderBy("bin").collect()[1]["value"] == 4.0


def test_ranges():
    assert qc.parse_ranges("a: 1, 2; b : 0.5, 3") == {"a": (1.0, 2.0), "b": (0.5, 3.0)}


def test_hidden_order_does_not_matter(spark):
    rng = random.Random(3)
    a = [("1", s, s + rng.randint(1, 500), k) for k, s in enumerate(rng.sample(range(5000), 80))]
    left = spark.createDataFrame(a, PLAIN)
    assert rows(intervals.overlap_join(left, left, tile=50)) == rows(intervals.overlap_join(left.repartition(7), left.repartition(3), tile=11))


def test_windows_are_clipped_at_the_nearest_interval(spark):
    rng = random.Random(5)
    a = [("12"[k % 2], s, s + rng.randint(1, 900), k) for k, s in enumerate(rng.sample(range(6000), 60))] + [("3", 5, 9, 60), ("1", 0, 2, 61), ("1", 0, 2, 61)]
    b = [(rng.choice("12"), s, s + rng.randint(0, 60), k) for k, s in enumerate(rng.choices(range(7000), k=90))] + [(None, 4, 5, 0), ("1", 2, 512, 1), ("3", 300, None, 2)]
    for ext in (10, 300, 1200):
        want = set()
        for c, s, e, k in a:
            low = max((y[2] for y in b if y[0] == c and y[2] is not None and y[2] <= s), default=0)
            high = min((y[1] for y in b if y[0] == c and y[1] >= e), default=e + ext)
            want.add((c, max(0, s - ext, low), min(e + ext, high), k))
        got = intervals.clip_windows(spark.createDataFrame(a, PLAIN), spark.createDataFrame(b, PLAIN), ext).select("chrom", "start", "end", "id")
        assert rows(got) == sorted(want, key=lambda r: tuple((True, str(v)) for v in r))


def test_windows_join_no_pairs(spark):
    """The regions never meet all intervals that their windows touch."""
    x = spark.createDataFrame([("1", k % 50, k % 50 + 400, k) for k in range(200)], PLAIN)
    plan = intervals.clip_windows(x, x, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


BLOCKS = "array<struct<start:bigint,end:bigint>>"


def _spliced(rng, n, most):
    """Reads of one to three blocks, few of them long."""
    for _ in range(n):
        at, blocks = rng.randint(-20, most), []
        for _ in range(rng.choice((1, 1, 2, 3))):
            at += rng.randint(0, 30)
            blocks.append((at, at + rng.choice((1, 5, 40, 300))))
            at = blocks[-1][1]
        yield blocks


def _meets(blocks, s, e):
    return any(b[0] < e and b[1] > s for b in blocks)


@pytest.mark.parametrize("exons", [False, True])
def test_feature_counts_equal_nested_loops(spark, exons):
    rng = random.Random(7)
    reads = [("s", f"B{rng.randint(0, 5)}", rng.choice("12"), b) for b in _spliced(rng, 150, 900)] + [("s", "B9", "1", [(0, 3000)]), ("s", "B9", None, [(0, 3000)]), ("s", "B9", "2", [])]
    regions = []
    for k in range(60):
        s, n = rng.randint(0, 900), rng.choice((1, 3, 9, 70, 600))
        regions.append((rng.choice("12"), s, s + n, f"g{k}", [(s, s + n // 3), (s + n // 2, s + n)]))
    regions += [regions[0], regions[5], (None, 5, 90, "n", [(5, 90)])]  # a feature given twice is one
    want = {}
    for sample, bc, chrom, blocks in reads:
        for c, s, e, name, parts in {(*r[:4], tuple(r[4])) for r in regions if r[0] is not None}:
            n = sum(_meets(blocks, *x) for x in set(parts) if x[0] < x[1]) if exons else _meets(blocks, s, e)
            if c == chrom and n:
                key = (f"{sample}::{bc}", c, s, e, name)
                want[key] = want.get(key, 0) + n
    x = spark.createDataFrame(reads, f"sample string, bc string, chrom string, blocks {BLOCKS}")
    f = spark.createDataFrame(regions, f"chrom string, start bigint, end bigint, name string, exons {BLOCKS}")
    for tile in (4, 512):
        got = {tuple(r)[:5]: r["count"] for r in counts.count_features(x, f, exons, tile=tile).collect()}
        assert got == want
    assert {r["count"] for r in counts.count_features(x, f, exons, binarize=True).collect()} == {1.0}


def test_features_meet_reads_without_a_shuffle_of_pairs(spark):
    x = spark.createDataFrame([("s", "A", "1", [(5, 15)])], f"sample string, bc string, chrom string, blocks {BLOCKS}")
    f = spark.createDataFrame([("1", 0, 10, "g")], "chrom string, start bigint, end bigint, name string")
    plan = counts.count_features(x, f)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.strip().startswith("MapInArrow")


@pytest.mark.parametrize("pairs", [1, 40, 1_000_000])
def test_counts_of_one_tile_in_small_passes(monkeypatch, pairs):
    """Counts are right however few pairs are looked at in one go and however rows are cut into batches."""
    monkeypatch.setattr(counts, "PAIRS", pairs)
    rng = random.Random(3)
    reads = sorted((f"c{rng.randint(0, 4)}", b) for b in _spliced(rng, 80, 400))
    features = [(s, s + rng.choice((2, 50, 400))) for s in rng.choices(range(400), k=25)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def batch(is_read, cells, blocks, bounds):
        n = len(blocks)
        same = {c: pa.array(np.zeros(n, t)) for c, t in (("step", np.int64), ("tile", np.int64), ("part", np.int32))}
        listed = pa.array([[{"start": a, "end": z} for a, z in b] for b in blocks], kind)
        return pa.RecordBatch.from_pydict({
            "chrom": pa.array(["1"] * n), "start": pa.array([b[0] for b in bounds], pa.int64()), "end": pa.array([b[1] for b in bounds], pa.int64()),
            "name": pa.array([f"g{k}" for k in range(n)]), "blocks": listed, **same, "is_read": pa.array([is_read] * n), "cell_id": pa.array(cells, pa.string()),
        })

    given = [batch(False, [None] * 25, [[f] for f in features], features)]
    for at in range(0, 80, 7):
        some = reads[at : at + 7]
        given.append(batch(True, [c for c, _ in some], [b for _, b in some], [(None, None)] * len(some)))
    got = [r for b in counts._counted(iter(given)) for r in b.to_pylist()]
    want = {(c, f"g{k}"): n for c in {c for c, _ in reads} for k, f in enumerate(features) if (n := sum(_meets(b, *f) for x, b in reads if x == c))}
    assert {(r["cell_id"], r["name"]): r["count"] for r in got} == want and len(got) == len(want)


def _one_tile(features, reads):
    """Sorted rows of one tile as counts._sums takes them: features are (name, blocks), reads (cell, blocks)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for is_read, rows in ((False, features), (True, sorted(reads))):
        n, none = len(rows), [None] * len(rows)
        same = {c: pa.array(np.zeros(n, t)) for c, t in (("step", np.int64), ("tile", np.int64), ("part", np.int32))}
        ends = none if is_read else [max(z for _, z in b) for _, b in rows]
        yield pa.RecordBatch.from_pydict({
            "chrom": pa.array(["1"] * n), "start": pa.array(none if is_read else [b[0][0] for _, b in rows], pa.int64()), "end": pa.array(ends, pa.int64()),
            "name": pa.array(none if is_read else [x for x, _ in rows], pa.string()), "blocks": pa.array([[{"start": a, "end": z} for a, z in b] for _, b in rows], kind),
            **same, "is_read": pa.array([is_read] * n), "cell_id": pa.array([x for x, _ in rows] if is_read else none, pa.string()),
        })


@pytest.mark.parametrize("bits", [1, 5, 13])
def test_exon_counts_leave_packed(monkeypatch, bits):
    """Packed rows hold the counts of nested loops, in less than a third of the bytes of plain ones when they are large."""
    monkeypatch.setattr(counts, "PACK", bits)
    rng = random.Random(11)
    features = [(f"gene-{k:05d}", [(s, s + 40), (s + rng.choice((20, 60)), s + 90)]) for k, s in enumerate(rng.choices(range(400), k=120))]
    reads = [(f"s::BC{rng.randint(0, 9):07d}", b) for b in _spliced(rng, 150, 400)]
    # Blocks that overlap, contain each other, are empty or out of order still meet an exon once.
    reads += [(f"s::BC{k:07d}", [(200, 260), (100, 400), (90, 110), (300, 300), (250, 255)]) for k in range(3)]
    got = {}
    packed = list(counts._packed(_one_tile(features, reads)))
    for r in (r for b in packed for r in b.to_pylist()):
        assert max(len(r["packed"]), len(r["cells"])) <= 1 << bits and len(r["names"]) <= 1 << bits
        for p in r["packed"]:
            feature, cell = p % (1 << bits), (p >> bits) % (1 << bits)
            key = r["cells"][cell], r["names"][feature], r["starts"][feature], r["ends"][feature]
            assert key not in got
            got[key] = p >> 2 * bits
    want = {(c, n, x[0][0], max(z for _, z in x)): k for c in {c for c, _ in reads} for n, x in features if (k := sum(_meets(b, *e) for d, b in reads if d == c for e in x))}
    assert got == want
    if bits == 13:
        assert sum(b.nbytes for b in packed) * 3 < sum(b.nbytes for b in counts._counted(_one_tile(features, reads)))


def test_exons_are_spread_out_by_spark(spark):
    x = spark.createDataFrame([("s", "A", "1", [(5, 15), (None, 3)])], f"sample string, bc string, chrom string, blocks {BLOCKS}")
    f = spark.createDataFrame([("1", 0, 10, "g", [(0, 6), (8, 10)])], f"chrom string, start bigint, end bigint, name string, exons {BLOCKS}")
    out = counts.count_features(x, f, exons=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.index("Generate explode") < plan.index("MapInArrow")
    assert [tuple(r) for r in out.collect()] == [("s::A", "1", 0, 10, "g", 2.0)]


@pytest.mark.parametrize(("exons", "parts"), [(False, "4"), (True, "4"), (True, "64")])
def test_features_and_reads_travel_little(spark, exons, parts):
    """Nearly all reads travel once, not to each tile near them, and the parts of a tile get its features in bundles."""
    rng = random.Random(13)
    n, m = 4_000, 1_000
    reads = [("s", f"B{rng.randint(0, 9)}", "1", [(s, s + 30)]) for s in rng.choices(range(25_000), k=n)]
    regions = [("1", s, s + 400 + k % 300, f"gene-{k}" if k % 9 else None, [(s, s + 100), (s + 200, s + 400 + k % 300)]) for k, s in enumerate(rng.choices(range(25_000), k=m))]
    x = spark.createDataFrame(reads, f"sample string, bc string, chrom string, blocks {BLOCKS}")
    f = spark.createDataFrame(regions, f"chrom string, start bigint, end bigint, name string, exons {BLOCKS}")

    def sent():
        found = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(k).shuffleWriteRecords() for k in range(found.size()))

    before = sent()
    conf = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        got = {tuple(r)[:5]: r["count"] for r in counts.count_features(x, f, exons).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = {}
    for sample, bc, _, blocks in reads:
        for c, s, e, name, parts in regions:
            if k := sum(_meets(blocks, *p) for p in (parts if exons else [(s, e)])):
                key = (f"{sample}::{bc}", c, s, e, name)
                want[key] = want.get(key, 0) + k
    assert got == want
    assert sent() - before < 1.5 * n + m + 1_000


def test_bundles_hold_what_they_were_made_of():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    of = [("1", 8, 0)] * 20 + [("1", 8, 1)] * 3 + [("2", 8, 1)] * 16 + [("2", 128, 1)] * 15  # two tiles of at least BUNDLE
    columns = {"chrom": pa.array([c for c, _, _ in of]), "step": pa.array([s for _, s, _ in of]), "tile": pa.array([t for _, _, t in of])}
    columns |= {"start": pa.array([k if k % 7 else None for k in range(54)]), "end": pa.array(range(54)), "name": pa.array([f"g{k}" if k % 5 else None for k in range(54)])}
    given = pa.RecordBatch.from_pydict(columns | {"blocks": pa.array([[{"start": k, "end": k + 5}] * (k % 4) for k in range(54)], kind)})
    made = list(counts._bundled(iter([given, given.slice(0, 0)])))
    assert sum(b.num_rows for b in made) == 3 + 15 + 2
    got = [r for b in counts._opened(iter(made)) for r in b.to_pylist()]
    key = lambda r: r["end"]
    assert sorted(got, key=key) == given.to_pylist()


@pytest.mark.parametrize("exons", [False, True])
def test_full_cells_are_counted_by_ranks(monkeypatch, exons):
    """Where a cell meets much of a tile its pairs are not looked at; spliced, empty and overlapping blocks count as ever."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rng = random.Random(17)
    one = lambda s: (s, s + rng.choice((1, 9, 60, 300)))
    features = [[one(s), one(s + 5)] if exons else [one(s)] for s in sorted(rng.choices(range(400), k=90))]
    tile = counts._Tile([], pa.array([[{"start": a, "end": z} for a, z in f] for f in features], kind))

    def check(reads):
        cells = np.array([c for c, _ in reads])
        got, sums = tile.counts(cells, cells.max() + 1, pa.array([[{"start": a, "end": z} for a, z in b] for _, b in reads], kind))
        want = {}
        for c, b in reads:
            for k, f in enumerate(features):
                if n := sum(_meets(b, *e) for e in f):
                    want[c * len(features) + k] = want.get(c * len(features) + k, 0) + n
        assert dict(zip(got.tolist(), sums.tolist(), strict=True)) == want and (np.diff(got) > 0).all()

    reads = [(c, b) for c in range(4) for b in _spliced(rng, 200 if c != 2 else 1, 400)]
    reads += [(3, [(200, 260), (100, 400), (90, 110)]), (3, [(10, 60), (90, 95), (95, 120)]), (3, [])]
    check([*reads, (4, [(200, 260), (300, 300), (250, 255)]), *[(4, b) for b in _spliced(rng, 200, 400)]])
    some = counts._Tile._by_pairs

    def few(self, start, *rest):
        assert len(start) <= 3, "pairs of a full cell"
        return some(self, start, *rest)

    monkeypatch.setattr(counts._Tile, "_by_pairs", few)
    check(reads)
