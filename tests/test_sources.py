"""Text and binary formats, sinks, streams."""

import struct
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cellweave.functions.text import label_of
from cellweave.sources import binary, sinks, text
from cellweave.streaming.windows import bin_counts


def test_bed(spark, tmp_path):
    p = tmp_path / "x.bed"
    p.write_text("chr1\t10\t50\tsome text +\nchr1\t10\t 30\tx\ty\nchr1\t10\t30\tother - more\n")
    got = {r["name"]: r["strand"] for r in text.read_bed(spark, str(p)).collect()}
    assert set(got) == {"chr1:10-50", "chr1:10-30", "chr1:10-30_r1"}


def test_gtf(spark, tmp_path):
    p = tmp_path / "x.gtf"
    row = "\t".join(["chr1", "src", "{f}", "{s}", "{e}", ".", "-", ".", 'gene_id "g"; transcript_id "t1"; tag "a"; tag "b";'])
    p.write_text("##x\n" + "\n".join(row.format(f=f, s=s, e=e) for f, s, e in (("transcript", 11, 90), ("exon", 11, 20), ("exon", 80, 90))))
    assert rows(text.read_gtf(spark, str(p))) == [("chr1", 10, 90, "t1", "-")]
    x = text.read_gtf(spark, str(p), keep_exons=True).first()
    assert [(e["start"], e["end"]) for e in x["exons"]] == [(10, 20), (79, 90)]
    assert text.read_gtf_records(spark, str(p)).first()["attributes"]["tag"] == "a"


def test_region_argument():
    assert text.parse_region("chr1:1,000-2000") == ("chr1", 1000, 2000)
    assert text.parse_region("chr1") == ("chr1", None, None)
    with pytest.raises(ValueError):
        text.parse_region("")


def test_groups_of_three_and_four_columns(spark, tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.tsv"
    a.write_text("sample\tbarcode\tcluster\ns\tx\t1\n#c\n")
    b.write_text("Cell_ID\tu1\tu2\tcluster\ns::x\t0.1\t0.2\t1\n")
    assert rows(text.read_groups(spark, str(a))) == rows(text.read_groups(spark, str(b))) == [("s", "x", "1")]


def test_munging(spark):
    contigs = spark.createDataFrame([("chr1", 10)], "chrom string, length bigint")
    x = spark.createDataFrame([("1", 1)], "chrom string, start bigint")
    assert rows(text.munged(x, contigs)) == [("chr1", 1)]
    with pytest.raises(ValueError):
        text.munged(x.withColumn("chrom", F.lit("9")), contigs)


def test_matrix_market_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("b", "y", 2.0), ("a", "x", 1.0), ("a", "z", 5.0)], "cell_id string, feature_id string, count double")
    sinks.write_matrix_market(c, str(tmp_path / "m"))
    assert rows(text.read_matrix_market(spark, str(tmp_path / "m"))) == rows(c)


def test_bedgraph(spark, tmp_path):
    runs = spark.createDataFrame([("a", "1", 0, 5, 1234567.0), ("a", "1", 5, 9, 0.5)], "cluster string, chrom string, start bigint, end bigint, value double")
    sinks.write_bedgraph(runs, str(tmp_path / "t"))
    got = sorted(p.read_text() for p in (tmp_path / "t" / "cluster=a").glob("*.csv"))
    assert "".join(got).splitlines() == ["1\t0\t5\t1.23457e+06", "1\t5\t9\t0.5"]


def test_label():
    assert label_of("/a/b.c.bam") == "b.c"


def bgzf(data: bytes) -> bytes:
    out = b""
    for k in range(0, len(data) or 1, 50):
        part = data[k : k + 50]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    name, cigar, seq = b"r1\0", [(5, 0), (20, 3), (3, 0), (2, 4)], "ACGTACGTAC"
    codes = [binary.BASES.index(c) for c in seq]
    packed = bytes((codes[k] << 4) | codes[k + 1] for k in range(0, 10, 2))
    tags = b"BCZAACC\0" + b"NMi" + struct.pack("<i", 3) + b"RXZTT\0" + b"XBBS" + struct.pack("<I2H", 2, 1, 2)
    body = struct.pack("<iiBBHHHIiiii"[:-1], 0, 100, len(name), 37, 0, len(cigar), 16, 10, 0, 50, -78) + name
    body += b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + packed + b"\xff" * 10 + tags
    head = b"BAM\1" + struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", 5) + b"chr1\0" + struct.pack("<I", 1000)
    p = tmp_path / "x.bam"
    p.write_bytes(bgzf(head + struct.pack("<I", len(body)) + body) + bgzf(b""))
    r = binary.read_bam(spark, {"s": str(p)}).first()
    assert (r["query_name"], r["chrom"], r["start"], r["end"], r["mapq"], r["bc"], r["umi"], r["sample"]) == ("r1", "chr1", 100, 128, 37, "AACC", "TT", "s")
    assert [(b["start"], b["end"]) for b in r["blocks"]] == [(100, 105), (125, 128)]
    assert r["fwd_seq"] == "GTACGTACGT" and r["query_len"] == 10


def test_two_bit(spark, tmp_path):
    seq = "ACGTNNacgtA"
    codes = [binary.TWO_BIT.index(c if c in "ACGT" else "T") for c in seq.upper().replace("N", "T")]
    codes += [0] * (-len(codes) % 4)
    packed = bytes(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, len(codes), 4))
    record = struct.pack("<I", len(seq)) + struct.pack("<III", 1, 4, 2) + struct.pack("<III", 1, 6, 4) + struct.pack("<I", 0) + packed
    p = tmp_path / "x.2bit"
    p.write_bytes(struct.pack("<4I", 0x1A412743, 0, 1, 0) + b"\1c" + struct.pack("<I", 22) + record)
    assert rows(binary.read_two_bit(spark, str(p), tile=8)) == [("c", 0, "ACGTNNac"), ("c", 1, "gtA")]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(k, k % 3) for k in range(200)], "s int, t int").selectExpr("timestamp_seconds(s * 60) AS ts", "cast(t AS string) AS event_type", "cast(s AS double) AS value")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = bin_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "1 hour")
    q = s.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows")) == rows(bin_counts(e, "1 hour"))
