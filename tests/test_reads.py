"""Filters, duplicates, fragments on small hand-made reads."""

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.operators import dedup, fragments
from cellweave.operators import predicates as P
from cellweave.schema import READS


def read(**k):
    base = {
        "sample": "s", "read_seq": 0, "query_name": "q", "flag": 0, "chrom": "1", "start": 100, "end": 110, "mapq": 30, "cigar": [(0, 10)], "blocks": [(100, 110)],
        "mate_chrom": "1", "mate_start": 0, "tlen": 0, "fwd_seq": "ACGTACGTAC", "query_len": 10, "bc": "A", "grp": None, "umi": "u",
    }
    base |= k
    if "start" in k and "end" not in k:
        base["end"] = k["start"] + 10
    if "start" in k and "blocks" not in k:
        base["blocks"] = [(base["start"], base["end"])]
    return tuple(base.values())


def reads(spark, *given):
    return spark.createDataFrame([read(**{"read_seq": n, "query_name": f"q{n}"} | k) for n, k in enumerate(given)], READS)


def names(df):
    return sorted(r[0] for r in df.select("query_name").collect())


def test_filters(spark):
    x = reads(spark, {"flag": 4}, {"mapq": 5}, {"flag": 64}, {"flag": 256 | 64}, {"bc": None}, {})
    assert names(P.read_filter(x, P.ReadFilter())) == ["q1", "q2", "q3", "q5"]
    assert names(P.read_filter(x, P.ReadFilter(min_mapq=10, flag_include=64, flag_exclude=(256, 512)))) == ["q2"]
    assert names(P.read_filter(x, P.ReadFilter(min_mapq=0))) == ["q1", "q2", "q3", "q5"]


def test_gc_counts_upper_case_and_n(spark):
    x = reads(spark, {"fwd_seq": "CGcgNA"}, {"fwd_seq": ""})
    assert [r[0] for r in x.select(P.gc_content()).collect()] == [pytest.approx(2 / 6), None]


@pytest.mark.parametrize(("flag", "forward", "reverse"), [(1 | 128, True, False), (1 | 128 | 16, False, True), (1 | 64, True, False), (1 | 64 | 32, False, True), (16, True, False), (0, False, True)])
def test_strand(spark, flag, forward, reverse):
    r = reads(spark, {"flag": flag}).select(P.strand("forward"), P.strand("reverse")).first()
    assert tuple(r) == (forward, reverse)


def test_adjacent_and_positional_duplicates_differ_on_aba(spark):
    x = reads(spark, {"bc": "A"}, {"bc": "B"}, {"bc": "A"}, {"bc": "A"})
    assert names(dedup.drop_adjacent(x, "start_bc")) == ["q0", "q1", "q2"]
    assert names(dedup.drop_positional(x, "start_bc")) == ["q0", "q1"]


def test_missing_umi_is_a_value_of_its_own(spark):
    x = reads(spark, {"umi": None}, {"umi": None}, {"umi": "u"})
    assert names(dedup.drop_adjacent(x, "start_bc_umi")) == ["q0", "q2"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from("AB"), st.booleans()), min_size=1, max_size=25))
def test_adjacent_equals_the_state_machine(spark, items):
    items = sorted(items, key=lambda x: x[0])
    x = reads(spark, *[{"start": s, "bc": b, "flag": 16 if r else 0, "tlen": 0} for s, b, r in items])
    kept, last = [], None
    for n, (s, b, r) in enumerate(items):
        key = (b, s if not r else None, s if r else None, r)
        if key != last:
            kept.append(f"q{n}")
        last = key
    assert names(dedup.drop_adjacent(x, "start_bc", tile=7)) == sorted(kept)


def test_distance_to_previous(spark):
    x = dedup.mark_positional(reads(spark, {"start": 5}, {"start": 5}, {"start": 5, "bc": "B"}, {"start": 9}), "start_bc")
    got = {r["query_name"]: r["distance"] for r in dedup.distance_to_previous(x).collect()}
    assert got == {"q0": 0, "q1": 0, "q2": None, "q3": 4}


def blocks(df, column):
    return [[(b["start"], b["end"]) for b in r[0]] for r in df.select(column).collect()]


def test_extension(spark):
    pair = {"flag": 1 | 2 | 32, "mate_start": 250, "tlen": 160}
    x = reads(spark, pair, {"flag": 16}, {}, pair | {"mate_chrom": "2"})
    assert blocks(x, fragments.extended(50)) == [[(100, 260)], [(60, 110)], [(100, 150)], [(100, 150)]]


def test_mnase(spark):
    base = {"flag": 1 | 2 | 32, "mate_start": 250}
    x = reads(spark, base | {"tlen": 150}, base | {"tlen": 151}, base | {"tlen": 400}, {"tlen": 150})
    assert blocks(x, fragments.mnase()) == [[(174, 176)], [(174, 177)], [], []]


@pytest.mark.parametrize(("first", "last"), [(1, -1), (1, 1), (-1, -1), (2, 9), (3, -3), (-4, -2), (8, 30), (40, 50)])
def test_offset_equals_spreading_into_bases(spark, first, last):
    rng = random.Random(first * 100 + last)
    given = []
    for _ in range(10):
        a = rng.randint(0, 50)
        cut = [(a, a + rng.randint(1, 8))]
        for _ in range(rng.randint(0, 2)):
            s = cut[-1][1] + rng.randint(1, 9)
            cut.append((s, s + rng.randint(1, 8)))
        given.append({"blocks": cut, "start": a, "end": cut[-1][1], "flag": rng.choice([0, 16])})
    x = reads(spark, *given).withColumn("o", fragments.offset(first, last))
    for g, got in zip(given, blocks(x, "o"), strict=True):
        bases = [p for s, e in g["blocks"] for p in range(s, e)]
        if g["flag"] & 16:
            bases = bases[::-1]
        n = len(bases)
        a = first - 1 if first > 0 else n + first
        z = last if last > 0 else n + last + 1
        want = sorted(bases[max(a, 0) : z]) if abs(first) <= n else []
        assert sorted(p for s, e in got for p in range(s, e)) == want


def test_shift(spark):
    contigs = spark.createDataFrame([("1", 1000, 0)], "chrom string, length bigint, chrom_idx int")
    x = reads(spark, {"flag": 1 | 2 | 64}, {"flag": 1 | 2 | 16 | 128}, {"flag": 0})
    got = {r["query_name"]: (r["start"], r["end"]) for r in P.shift_reads(x, contigs).collect()}
    assert got == {"q0": (104, 110), "q1": (100, 105)}


def test_motif_at_edges(spark):
    genome = spark.createDataFrame([("1", 0, "TACGT"), ("1", 1, "AGGGG")], "chrom string, tile bigint, seq string")
    x = reads(spark, {"start": 1, "fwd_seq": "AC"}, {"start": 0, "fwd_seq": "AC"}, {"start": 5, "fwd_seq": "AC"}, {"start": 2, "end": 5, "flag": 16, "fwd_seq": "AC"})
    got = {r["query_name"] for r in P.motif(x, genome, [("A", "TA")], tile=5).filter("motif_ok").collect()}
    assert got == {"q0", "q2", "q3"}


def test_hamming(spark):
    a = spark.createDataFrame([("AAAA",), ("AAAT",), ("TTTT",), ("AAA",)], "bc string")
    w = spark.createDataFrame([("AAAA",), ("TTTA",)], "bc string")
    assert rows(P.hamming_barcodes(a, w, 1)) == [("AAAA", "AAAA", 0), ("AAAT", "AAAA", 1), ("TTTT", "TTTA", 1)]


def test_default_length(spark):
    x = reads(spark, *[{"flag": 3, "tlen": t} for t in (100, 200, 300, 5000)])
    assert fragments.default_length(x).first()[0] == 200
    assert F.col("x") is not None
