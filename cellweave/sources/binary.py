"""Decoders of BAM and 2bit files, written from the formats' public descriptions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Letters of the 4-bit and 2-bit base codes, and the sizes of tag types.
BASES = "=ACMGRSVTWYHKDBN"
TWO_BIT = "TCAG"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
COMPLEMENT = str.maketrans("ACGTN", "TGCAN")
QUERY_OPS, REFERENCE_OPS = (0, 1, 4, 7, 8), (0, 2, 3, 7, 8)

SCHEMA = (
    "read_seq bigint, query_name string, flag int, chrom string, start bigint, end bigint, mapq int, cigar array<struct<op:int,len:int>>, "
    "blocks array<struct<start:bigint,end:bigint>>, mate_chrom string, mate_start bigint, tlen int, fwd_seq string, query_len int, bc string, grp string, umi string"
)


def _open(path: str):
    """A binary stream on any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_stream(inner, compression=None)


def inflated(stream) -> Iterator[bytes]:
    """The blocks of a BGZF stream, one at a time (64 KB at most)."""
    while head := stream.read(12):
        extra = stream.read(struct.unpack("<H", head[10:12])[0])
        size, at = None, 0
        while at < len(extra):
            a, b, n = struct.unpack("<BBH", extra[at : at + 4])
            if (a, b) == (66, 67):
                size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("not a BGZF file")
        rest = stream.read(size - 12 - len(extra))
        yield zlib.decompress(rest[:-8], -15)


class _Bytes:
    """Reads exact lengths from an iterator of blocks."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.at = blocks, b"", 0

    def take(self, n: int) -> bytes | None:
        while len(self.held) - self.at < n:
            block = next(self.blocks, None)
            if block is None:
                return None
            self.held, self.at = self.held[self.at :] + block, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def numbers(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))


def _tags(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack("<I", data[at + 1 : at + 5])[0]
            at += 5 + n * TAG_SIZES[sub]
        else:
            n = TAG_SIZES[kind]
            out[name] = data[at : at + 1].decode() if kind == "A" else struct.unpack("<" + {"c": "b", "C": "B", "s": "h", "S": "H"}.get(kind, kind), data[at : at + n])[0]
            at += n
    return out


def contigs_of(source: _Bytes) -> list[tuple[str, int]]:
    magic, n = source.take(4), source.numbers("I")[0]
    if magic != b"BAM\1":
        raise ValueError("not a BAM file")
    source.take(n)
    out = []
    for _ in range(source.numbers("I")[0]):
        name = source.take(source.numbers("I")[0])[:-1].decode()
        out.append((name, source.numbers("I")[0]))
    return out


def records(path: str, cell: str = "BC", group: str | None = None, umi: str = "RX") -> Iterator[tuple]:
    with _open(path) as stream:
        source = _Bytes(inflated(stream))
        names = [c for c, _ in contigs_of(source)]
        k = 0
        while (head := source.take(4)) is not None:
            data = source.take(struct.unpack("<I", head)[0])
            ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack("<iiBBHHHIiii", data[:32])
            at = 32 + n_name
            name = data[32 : at - 1].decode()
            cigar = [(c & 15, c >> 4) for c in struct.unpack(f"<{n_cigar}I", data[at : at + 4 * n_cigar])]
            at += 4 * n_cigar
            packed = data[at : at + (n_seq + 1) // 2]
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
            tags = _tags(data[at + len(packed) + n_seq :])
            end, blocks = pos, []
            for op, n in cigar:
                if op in (0, 7, 8):
                    blocks.append((end, end + n))
                end += n if op in REFERENCE_OPS else 0
            if flag & 16:
                seq = seq[::-1].translate(COMPLEMENT)
            text = lambda t: None if t is None or t not in tags else str(tags[t])  # noqa: B023, E731
            yield (
                k, name, flag, names[ref] if ref >= 0 else None, pos, max(end, pos + 1), mapq, cigar, blocks, names[mate] if mate >= 0 else None, mate_pos, tlen, seq,
                sum(n for op, n in cigar if op in QUERY_OPS) or n_seq, text(cell), text(group), text(umi),
            )
            k += 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_File(p) for p in self.options["path"].split(",")]

    def read(self, partition):
        o = self.options
        yield from records(partition.path, o.get("celltag", "BC"), o.get("grouptag"), o.get("umitag", "RX"))


class BamDataSource(DataSource):  # S1
    """spark.read.format("bam").load(path): one streaming task for each file, which holds
    a block and a record at a time. Options: cellTag, groupTag, umiTag."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_bam(spark: SparkSession, paths: dict[str, str], **options: str) -> DataFrame:  # S1, S3
    """Reads of several files, labelled by sample."""
    spark.dataSource.register(BamDataSource)
    out = None
    for label, path in paths.items():
        x = spark.read.format("bam").options(**options).load(path).withColumn("sample", F.lit(label))
        out = x if out is None else out.unionByName(x)
    return out


def chromosome_statistics(reads: DataFrame) -> DataFrame:  # S1
    """sample, chrom, mapped, unmapped."""
    un = F.col("flag").bitwiseAND(4) != 0
    return reads.groupBy("sample", "chrom").agg(F.count_if(~un).alias("mapped"), F.count_if(un).alias("unmapped"))


def two_bit(data: bytes) -> dict[str, str]:
    """Sequences of a 2bit file; blocks of unknown bases as N, masked ones in lower case."""
    order = "<" if struct.unpack("<I", data[:4])[0] == 0x1A412743 else ">"
    signature, _, n, _ = struct.unpack(order + "4I", data[:16])
    if signature != 0x1A412743:
        raise ValueError("not a 2bit file")
    at, offsets = 16, {}
    for _ in range(n):
        size = data[at]
        offsets[data[at + 1 : at + 1 + size].decode()] = struct.unpack(order + "I", data[at + 1 + size : at + 5 + size])[0]
        at += 5 + size
    out = {}
    for name, p in offsets.items():
        length, runs = struct.unpack(order + "I", data[p : p + 4])[0], []
        p += 4
        for _ in range(2):
            k = struct.unpack(order + "I", data[p : p + 4])[0]
            pairs = struct.unpack(f"{order}{2 * k}I", data[p + 4 : p + 4 + 8 * k])
            runs.append(list(zip(pairs[:k], pairs[k:], strict=True)))
            p += 4 + 8 * k
        p += 4
        seq = list("".join(TWO_BIT[b >> 6] + TWO_BIT[b >> 4 & 3] + TWO_BIT[b >> 2 & 3] + TWO_BIT[b & 3] for b in data[p : p + (length + 3) // 4])[:length])
        for s, m in runs[0]:
            seq[s : s + m] = "N" * m
        for s, m in runs[1]:
            seq[s : s + m] = "".join(seq[s : s + m]).lower()
        out[name] = "".join(seq)
    return out


def read_two_bit(spark: SparkSession, path: str, tile: int = 1000) -> DataFrame:  # S11
    """chrom, tile, seq."""

    def each(frames):
        import pandas as pd

        for f in frames:
            rows = [(c, k // tile, s[k : k + tile]) for data in f["content"] for c, s in two_bit(bytes(data)).items() for k in range(0, len(s), tile)]
            yield pd.DataFrame(rows, columns=["chrom", "tile", "seq"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(each, "chrom string, tile long, seq string")
