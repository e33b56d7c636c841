"""Token ids in fixed-width bit-packed files.

A store is a Parquet folder whose rows are blocks of whole documents in ascending
order of doc_id (nulls first, repeated ids by text hash). Each id takes
ceil(log2(vocabulary)) bits in `payload`; `doc_ids` and `doc_starts` say where in
the block each document begins, `shard` and `shard_start` where the block stands
in its shard. So any document, or any range of ids, is unpacked with numpy from
one block without touching the others, and Parquet's statistics on
first_doc_id / last_doc_id find the block. Parquet is the container because
Spark's committers then make each file appear whole or not at all on any store,
also when an executor is lost or a task runs twice.

Null and empty texts hold only the end id. Repeated rows are written once each.
An empty table gives an empty store. Extra columns are ignored. A block closes at
BLOCK_IDS ids, so memory is bounded by that or by the longest single document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import body, new_path, worker_cache

END_ID = 2
BLOCK_IDS = 65_536
#: Pieces a worker remembers at most.
CACHE_PIECES = 1_500_000

STORE = (
    "shard int, block long, shard_start long, first_doc_id long, last_doc_id long, n_docs int, n_ids long, width int, "
    "doc_ids array<bigint>, doc_starts array<bigint>, payload binary"
)


def width_of(vocabulary: int) -> int:
    """Bits that the ids 0 .. vocabulary - 1 need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive little-endian bit fields."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count - 1 of a payload, reading only their bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    first = start * width
    piece = np.frombuffer(payload, np.uint8, (first + count * width + 7) // 8 - first // 8, first // 8)
    bits = np.unpackbits(piece, bitorder="little")[first % 8 :][: count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level BPE with the library's own pattern never joins a blank that a
    non-blank follows to what precedes it, so a text may be cut before each such
    blank and the pieces encoded apart: the ids are the same, and pieces that
    came before need no second encoding. Other tokenizers, and texts that hold
    an added token's string or a blank before white space, are encoded whole.
    """

    #: A blank before white space (of any Unicode version) or at the end.
    _blank_run = r" ([\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]|$)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            spec["model"]["type"] == "BPE"
            and spec.get("normalizer") is None
            and not spec["model"].get("ignore_merges")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        #: Bytes of each id's token: byte-level strings have one character for each.
        self.lengths = np.zeros(self.vocabulary, np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[number] = len(token)
        self.known, self.values = pa.array([], pa.string()), pa.array([], pa.binary())
        self.marks = dict(zip(",.", self._encode([",", "."]), strict=True)) if self.cuts else {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian 32-bit bytes; no nulls."""
        apart = pc.match_substring_regex(texts, self._blank_run)
        for string in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, string))
        apart = apart.to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        if apart.any():
            rows = np.flatnonzero(apart)
            for k, x in zip(rows.tolist(), self._encode(texts.take(pa.array(rows)).to_pylist()), strict=True):
                out[k] = x
        if not apart.all():
            rows = np.flatnonzero(~apart)
            for k, x in zip(rows.tolist(), self._cut(texts.take(pa.array(rows)) if apart.any() else texts), strict=True):
                out[k] = x
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Cuts at every blank, looks each distinct piece up once, and lays the ids out
        by Arrow's take, whose data buffer is their concatenation."""
        lists = pc.split_pattern(texts, " ")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = self._looked_up(coded.dictionary)
        # A first piece has no blank before it, so it is encoded each time.
        heads = cuts[:-1]
        first = self._encode(coded.dictionary.take(pa.array(at[heads])).to_pylist())
        at[heads] = len(values) + np.arange(len(heads))
        laid = pa.concat_arrays([values, pa.array(first, pa.binary())]).take(pa.array(at))
        ends = np.frombuffer(laid.buffers()[1], np.int32, len(laid) + 1)[cuts].tolist()
        data = laid.buffers()[2].to_pybytes() if laid.buffers()[2] else b""
        return [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]

    def _looked_up(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """Values of distinct pieces that stand after a blank. What is remembered lies in
        two Arrow arrays, some 40 bytes a piece; the oldest half goes when they are full."""
        if len(self.known) > CACHE_PIECES:
            half = len(self.known) // 2
            self.known, self.values = pa.concat_arrays([self.known.slice(half)]), pa.concat_arrays([self.values.slice(half)])
        at = pc.index_in(pieces, value_set=self.known)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if missing.any():
            new = pieces.filter(pa.array(missing))
            at[missing] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.values = pa.concat_arrays([self.values, pa.array(self._fresh(new.to_pylist()), pa.binary())])
        return self.values.take(pa.array(at))

    def _fresh(self, new: list[str]) -> list[bytes]:
        """Values of pieces that are not remembered. Letters followed by one comma or
        stop are two tokens of the pattern, so that mark is encoded apart; letters
        stand here for those below U+0250, on which all Unicode versions agree."""
        bases = [p[:-1] if p[-1:] in self.marks and p[:-1].isalpha() and max(p) < "\u0250" else p for p in new]
        names = list(dict.fromkeys(bases))
        found = dict(zip(names, self._encode_pieces(names), strict=True))
        return [found[b] if b is p else found[b] + self.marks[p[-1]] for p, b in zip(new, bases, strict=True)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Values of pieces, each after a blank. They go as one text, which the library
        cuts at each blank itself; as a byte-level token is as long as its string,
        running byte lengths tell which ids are whose."""
        out = []
        for k in range(0, len(pieces), 500):
            part = [" " + p for p in pieces[k : k + 500]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum([len(p.encode()) for p in part])
            upto = np.cumsum(self.lengths[ids])
            last = np.searchsorted(upto, ends)
            if len(upto) and last[-1] < len(upto) and (upto[last] == ends).all():
                held, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
                out += [held[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
            else:  # a tokenizer that cuts elsewhere
                out += self._encode(part)
        return out


def encoder(path: str) -> Encoder:
    kept = worker_cache()
    if ("encoder", path) not in kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept["encoder", path] = Encoder(path)
    return kept["encoder", path]


#: Bytes of text that a worker encodes at once.
CHUNK_BYTES = 4_000_000


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    texts = batch.column(1)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield batch.column(0).slice(at, end - at).to_pylist(), texts.slice(at, end - at)
        at = end


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode docs.text and write the store at `path`, which must be new.

    One range shuffle of (doc_id, text); everything after it is a stream
    within each partition.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int64()), ("shard_start", pa.int64()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()),
            ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("payload", pa.binary()),
        ])
        width = width_of(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        done, block, ids, starts, parts, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            real = [x for x in ids if x is not None]
            row = {
                "shard": shard, "block": block, "shard_start": done, "first_doc_id": min(real, default=None), "last_doc_id": max(real, default=None),
                "n_docs": len(ids), "n_ids": size, "width": width, "doc_ids": ids, "doc_starts": starts, "payload": pack(np.frombuffer(b"".join(parts), "<u4"), width),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for chunk_ids, texts in _chunks(b):
                for i, x in zip(chunk_ids, enc.batch(texts), strict=True):
                    ids.append(i)
                    starts.append(size)
                    parts += (x, end)
                    size += len(x) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield close()
                        done, block, ids, starts, parts, size = done + size, block + 1, [], [], [], 0
        if ids:
            yield close()

    key = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .select("doc_id", "text")
    )
    placed.mapInArrow(blocks, STORE).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks with `start`: the ids in the whole store before the block.

    Only the shards' totals, a row for each writing task, are summed in one place.
    """
    blocks = spark.read.schema(STORE).parquet(path)
    # A row for each writing task, tens of bytes: always small enough to broadcast.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_before"))
    return blocks.join(F.broadcast(totals), "shard").withColumn("start", F.col("_before") + F.col("shard_start")).drop("_before")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the store."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                x = b.slice(row, 1).to_pylist()[0]
                edges = [*x["doc_starts"], x["n_ids"]]
                ids = unpack(x["payload"], x["width"], 0, x["n_ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(x["doc_ids"], pa.int64()),
                    pa.array([x["start"] + s for s in x["doc_starts"]], pa.int64()),
                    pa.array(np.diff(edges).astype(np.int64)),
                    pa.array([zlib.crc32(ids[a:z].tobytes()) for a, z in zip(edges, edges[1:], strict=False)], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = read(spark, path).select("doc_ids", "doc_starts", "n_ids", "width", "payload", "start")
    return found.mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Random access: the ids of a few documents. Blocks whose range of doc_ids
    holds none of them are skipped by the scan."""
    wanted = sorted(set(doc_ids))
    blocks = spark.read.schema(STORE).parquet(path)
    near = [(F.col("first_doc_id") <= i) & (F.col("last_doc_id") >= i) for i in wanted]
    hit = near[0]
    for x in near[1:]:
        hit = hit | x
    out = {}
    for x in blocks.filter(hit).select("doc_ids", "doc_starts", "n_ids", "width", "payload").toLocalIterator():
        edges = [*x.doc_starts, x.n_ids]
        for k, i in enumerate(x.doc_ids):
            if i in wanted:
                out[i] = unpack(bytes(x.payload), x.width, edges[k], edges[k + 1] - edges[k]).tolist()
    return out


def op9_token_output(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the store, at `path` or a new folder of the shared one, and returns what
    `documents` reads from it. The store is the product and stays."""
    path = path or new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return documents(spark, path)
