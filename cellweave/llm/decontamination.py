"""Benchmark decontamination with a positional inverted index.

The index is split by documents: each row is a block of whole documents with its
different words, in order of their hashes, and for each of them the ascending positions at
which it stands in the block. A position is a word's number in the block plus the
number of documents before it, so that no phrase can run from one document into the
next. The index is built in one pass without a shuffle and stored. Words are found by
hash and told apart by their bytes, in the index as in a search, so matches are exact.

A search meets the test windows in every block. The windows that miss a word are dropped at
once; for the others the posting lists are intersected, shifted by each word's offset,
from the word that is rarest in the block. Exact matching asks for every word at its
place; `slop` lets each stand that many words away (proximity).

The test set is the query side. It is read in blocks of QUERY_WORDS words at most (or one
item); one block at a time is on the driver and in the tasks, and each makes a pass over
the index. What the passes find is put together by document.

Null texts and items have no words. Items of fewer than `size` words are one window.
Repeated rows count each by itself; a repeated item_id is one item; items with a
null id mark words but are not counted or named. Empty tables: an empty
benchmark hits nothing, an empty corpus gives no rows. Extra columns are ignored, and
kept by `clean`. A document is never cut: a block holds at least one, so a task's
memory is bounded by BLOCK_BYTES or the longest document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, new_path, scratch, small_batches, stored
from .tokens import gathered, word_spans

SIZE = 10
BLOCK_BYTES = 4_000_000
QUERY_WORDS = 2_000_000

#: Candidates of one step of the intersection.
CANDIDATES = 200_000

INDEX = "block long, doc_ids array<bigint>, n_words array<bigint>, terms binary, words binary, word_ends binary, ends binary, postings binary"


def _told_apart(order: np.ndarray, hashes: np.ndarray, whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of occurrences in order of hash, whether each is the last of its word.

    Words of one hash are compared with the first of them, byte by byte. Where some
    differ, `order` is changed within the hash so that equal words stand together.
    """
    new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    same = lengths[order] == lengths[first]
    again = np.flatnonzero(same & (order != first))
    size = lengths[order[again]]
    if len(again):
        equal = gathered(whole, starts[order[again]], size) == gathered(whole, starts[first[again]], size)
        same[again] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    last = np.append(new[1:], True) if len(new) else new
    word = lambda k: whole[starts[k] : starts[k] + lengths[k]].tobytes()
    for h in np.unique(hashes[~same]).tolist():
        group = np.flatnonzero(hashes == np.uint64(h))
        by_word: dict[bytes, list[int]] = {}
        for k in order[group].tolist():
            by_word.setdefault(word(k), []).append(k)
        order[group] = [k for own in by_word.values() for k in own]
        last[group] = [k == own[-1] for own in by_word.values() for k in own]
    return last


def _index_row(ids: list, texts: list[bytes]) -> dict:
    hashes, counts, whole, starts, lengths = word_spans(texts)
    at = np.arange(len(hashes), dtype=np.uint32) + np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    last = np.flatnonzero(_told_apart(order, hashes, whole, starts, lengths))
    terms = order[last]
    gaps = np.diff(at[order], prepend=np.uint32(0))  # modulo 2 ** 32, undone by a running sum
    return {
        "block": uuid.uuid4().int >> 65, "doc_ids": ids, "n_words": counts.tolist(), "terms": hashes[last].astype("<u8").tobytes(),
        "words": gathered(whole, starts[terms], lengths[terms]).tobytes(), "word_ends": np.cumsum(lengths[terms]).astype("<u4").tobytes(),
        "ends": (last + 1).astype("<u4").tobytes(), "postings": gaps.astype("<u4").tobytes(),
    }


def build_index(docs: DataFrame, path: str) -> None:
    """Store the index of docs.text at `path`, which must be new."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(c, pa.binary()) for c in ("terms", "words", "word_ends", "ends", "postings")]
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), *parts])
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([_index_row(ids, texts)], schema=schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_index_row(ids, texts)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Rows are megabytes, so the writer must look at the size of a row group after each.
    small = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "zstd"}
    small_batches(rows.sparkSession)
    rows.mapInArrow(blocks, INDEX).write.options(**small).parquet(path)


class Queries:
    """Windows of test items: the distinct words, in order of hash, and for each window the
    numbers of its words, its length, its item and its place in the item."""

    def __init__(self, items: list[tuple], size: int = SIZE):
        hashes, counts, whole, starts, lengths = word_spans([(t or "").encode() for _, t in items])
        self.names = [None if i is None else str(i) for i, _ in items]
        order = np.argsort(hashes, kind="stable")
        last = np.flatnonzero(_told_apart(order, hashes[order], whole, starts, lengths))
        terms = order[last]
        self.terms = hashes[terms]
        self.words_of_terms = [whole[starts[k] : starts[k] + lengths[k]].tobytes() for k in terms.tolist()]
        number = np.zeros(len(hashes), np.int64)
        number[order] = np.searchsorted(last, np.arange(len(order)))
        firsts, item, length = [], [], []
        start = 0
        for k, n in enumerate(counts.tolist()):
            here = max(1, n - size + 1) if n else 0
            firsts += range(start, start + here)
            item += [k] * here
            length += [min(n, size)] * here
            start += n
        self.item, self.length = np.array(item, np.int64), np.array(length, np.int64)
        first = np.array(firsts, np.int64)
        self.place = first - np.concatenate(([0], np.cumsum(counts)))[self.item] if len(first) else first
        column = np.arange(size)
        inside = column < self.length[:, None]
        padded = np.concatenate((number, np.zeros(size, number.dtype)))
        self.words = np.where(inside, padded[first[:, None] + column], len(self.terms))


class Block:
    """One row of the index, unpacked."""

    def __init__(self, row: dict):
        self.block, self.ids = row["block"], row["doc_ids"]
        self.counts = np.array(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.words, self.word_ends = row["words"], np.frombuffer(row["word_ends"], "<u4")
        self.ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
        self.postings = np.cumsum(np.frombuffer(row["postings"], "<u4"), dtype=np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.counts + 1) - self.counts - 1

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def _found(self, q: Queries) -> np.ndarray:
        """Which of the block's words each of the test set's is; -1: none."""
        at = np.searchsorted(self.terms, q.terms)
        out = np.full(len(q.terms), -1)
        for k in np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == q.terms).tolist():
            t = int(at[k])
            while t < len(self.terms) and self.terms[t] == q.terms[k]:
                if self.words[self.word_ends[t - 1] if t else 0 : self.word_ends[t]] == q.words_of_terms[k]:
                    out[k] = t
                    break
                t += 1
        return out

    def matches(self, q: Queries, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, positions at which they start), for the windows that occur."""
        if not len(self.terms) or not len(q.item):
            return
        term = self._found(q)
        begin = np.where(term > 0, self.ends[term - 1], 0)
        many = np.where(term >= 0, self.ends[term] - begin, 0)
        never = np.iinfo(np.int64).max
        counts = np.append(many, never)[q.words]
        least = counts.min(axis=1)
        there = np.flatnonzero(least > 0)
        # Offsets from the rarest word on; those beyond a window's length come last.
        orders = np.argsort(counts[there], axis=1, kind="stable")
        size = int((self.counts + 1).sum())
        own_term = np.full(size, -1)
        own_term[self.postings] = np.repeat(np.arange(len(self.terms)), np.diff(self.ends, prepend=0))
        sums = np.cumsum(least[there])
        at = 0
        while at < len(there):
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CANDIDATES, side="right")))
            windows, order = there[at:end], orders[at:end]
            rare = q.words[windows, order[:, 0]]
            n = least[windows]
            listed = self.postings[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rare], n)]
            w = np.repeat(np.arange(len(windows)), n)
            start = listed - order[w, 0]
            low = self.starts[self.document(listed)]
            keep = start >= low
            w, start = w[keep], start[keep]
            for k in range(1, q.words.shape[1]):
                if not len(w):
                    break
                offset = order[w, k]
                wanted = q.words[windows[w], offset]
                real = offset < q.length[windows[w]]
                if slop == 0:
                    place = np.minimum(start + offset, size - 1)
                    ok = own_term[place] == term[np.minimum(wanted, len(term) - 1)]
                else:
                    doc = self.document(start)
                    ok = np.zeros(len(w), bool)
                    for step in range(-slop, slop + 1):
                        place = start + offset + step
                        inside = (place >= self.starts[doc]) & (place < self.starts[doc] + self.counts[doc])
                        ok |= inside & (own_term[np.clip(place, 0, size - 1)] == term[np.minimum(wanted, len(term) - 1)])
                keep = ok | ~real
                w, start = w[keep], start[keep]
            if len(w):
                yield windows[w], start
            at = end


def _query_blocks(benchmark: DataFrame, size: int) -> Iterator[Queries]:
    """The test items, QUERY_WORDS words (or one item) at most at a time."""
    items, words, some = [], 0, False
    for r in benchmark.select("item_id", "text").toLocalIterator():
        items.append((r[0], r[1]))
        words += len(r[1] or "") // 2 + 1  # a word and its gap take two characters at least
        if words >= QUERY_WORDS:
            yield Queries(items, size)
            items, words, some = [], 0, True
    if items or not some:
        yield Queries(items, size)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block(b.slice(k, 1).to_pylist()[0])


def _passes(spark: SparkSession, path: str, benchmark: DataFrame, size: int, each, schema: str) -> DataFrame:
    """each(block, queries) -> record batch, for every block of the index and each block
    of queries; the passes run one after another and are stored."""
    out = None
    for q in _query_blocks(benchmark, size):
        sent = spark.sparkContext.broadcast(q)
        one = spark.read.schema(INDEX).parquet(path).mapInArrow(lambda batches, sent=sent: (x for b in _blocks(batches) for x in each(b, sent.value)), schema)
        one = stored(one, "contaminated")
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def matches(spark: SparkSession, path: str, benchmark: DataFrame, size: int = SIZE, slop: int = 0) -> DataFrame:
    """doc_id, doc_pos, item_id (string), item_pos, n_words: every occurrence of a window."""

    def each(block: Block, q: Queries) -> Iterator[pa.RecordBatch]:
        for w, at in block.matches(q, slop):
            doc = block.document(at)
            yield pa.RecordBatch.from_arrays([
                pa.array([block.ids[d] for d in doc.tolist()], pa.int64()), pa.array(at - block.starts[doc], pa.int64()),
                pa.array([q.names[i] for i in q.item[w].tolist()], pa.string()), pa.array(q.place[w]), pa.array(q.length[w]),
            ], names=["doc_id", "doc_pos", "item_id", "item_pos", "n_words"])

    return _passes(spark, path, benchmark, size, each, "doc_id long, doc_pos long, item_id string, item_pos long, n_words long")


def hits(spark: SparkSession, path: str, benchmark: DataFrame, size: int = SIZE, slop: int = 0) -> DataFrame:
    """block, ordinal (which document of the block), doc_id, runs (of covered words, as
    [first, end)), items: a row for each hit document and pass."""
    run = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("runs", pa.list_(run)), ("items", pa.list_(pa.string()))])

    def each(block: Block, q: Queries) -> Iterator[pa.RecordBatch]:
        change = np.zeros(int((block.counts + 1).sum()) + size + 1, np.int32)
        pairs = []
        for w, at in block.matches(q, slop):
            own = block.document(at)
            np.add.at(change, at, 1)
            np.add.at(change, np.minimum(at + q.length[w], block.starts[own] + block.counts[own]), -1)
            pairs.append(np.unique(own * len(q.names) + q.item[w]))
        if not pairs:
            return
        items: dict[int, set[str]] = {}
        for p in np.unique(np.concatenate(pairs)).tolist():
            own = items.setdefault(p // len(q.names), set())
            if (name := q.names[p % len(q.names)]) is not None:
                own.add(name)
        covered = np.concatenate(([0], np.cumsum(change) > 0, [0])).astype(np.int8)
        edges = np.diff(covered)
        first, end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        runs: dict[int, list] = {}
        for d, a, z in zip(block.document(first).tolist(), first.tolist(), end.tolist(), strict=True):
            runs.setdefault(d, []).append({"first": a - int(block.starts[d]), "end": z - int(block.starts[d])})
        rows = [{"block": block.block, "ordinal": d, "doc_id": block.ids[d], "runs": runs[d], "items": sorted(own)} for d, own in sorted(items.items())]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _passes(spark, path, benchmark, size, each, "block long, ordinal int, doc_id long, runs array<struct<first:bigint,end:bigint>>, items array<string>")


def report(spark: SparkSession, path: str, benchmark: DataFrame, size: int = SIZE, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = hits(spark, path, benchmark, size, slop).groupBy("block", "ordinal")
    found = found.agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Runs of one pass do not overlap, those of several may: count each word once.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    more = lambda a, r: F.greatest(r["end"] - F.greatest(r["first"], a["upto"]), F.lit(0))
    n_hit = F.aggregate("runs", start, lambda a, r: F.struct((a["n"] + more(a, r)).alias("n"), F.greatest(a["upto"], r["end"]).alias("upto")), lambda a: a["n"])
    found = found.select("block", "ordinal", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    index = spark.read.schema(INDEX).parquet(path).select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ordinal", "d"))
    rows = index.join(found, ["block", "ordinal"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns.

    An id that is contaminated in one row goes in all; rows without an id that is
    contaminated go as one group too.
    """
    with scratch(spark) as made:
        path = new_path(spark, "postings")
        build_index(docs, path)
        bad = kept(hits(spark, path, benchmark, size).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated-ids", made)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_bad")), "left_anti")


def op7_decontamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    with scratch(spark) as made:
        path = new_path(spark, "postings")
        build_index(docs, path)
        return kept(report(spark, path, benchmark), "contamination", made)


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), {SIZE}) AS size, array_to_string(w[i:i + {SIZE - 1}], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM q),
g AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM (SELECT rid, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM t, sizes)),
h AS (SELECT g.rid, g.i, q.size, q.item_id FROM g JOIN q ON g.size = q.size AND g.gram = q.gram),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS j FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
