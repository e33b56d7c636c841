"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles (fewer words: one shingle of
all of them). A shingle weighs tf * idf. Document frequencies are counted over all
rows in DF_BUCKETS hash buckets, a fixed 1 MB however large the corpus; idf =
1 + ln((N + 1) / (df + 1)) / ln(N + 1), at least 1, so that what everybody shares
weighs half of what is rare.

1. Equal texts are one node, named by the MD5 of the text.
2. Improved consistent weighted sampling draws SAMPLES samples of each document; the
   chance that two documents draw the same one is their weighted Jaccard
   similarity. The random numbers of a (shingle, sample) come from a table indexed by
   a hash, so a sample costs a few array operations. ROWS samples make a band.
3. In each band, documents with equal keys form a bucket. A bucket is not expanded
   into pairs: its members are first compared with one leader, the document that meets
   most others over all bands (the centre of a group of edited copies does), and linked
   ones become one class. Then, in every bucket that holds several classes, the members
   outside its largest class are compared with all members, so every pair of a bucket
   whose ends are still in different classes is compared, in one pass. Buckets with the same
   members count once. The comparison runs in tiles of TILE_OTHERS x TILE_MEMBERS texts,
   each a row group of its own however large the bucket, as a product of two matrices of
   shingles; a tile returns pairs of classes, not of documents.
4. A pair is verified on the whole texts: a link needs a weighted Jaccard similarity
   of `threshold` with the TF-IDF weights or with the plain counts (which the same
   sampling finds; in a large group of copies idf alone would punish every edit).
5. Connected components by alternating large-star and small-star steps.

Recall is that of the banding, measured against brute force in the tests: a pair at
0.8 shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS > 0.9999, and at
0.65, where a TF-IDF similarity can fall for 0.8 of plain counts, 0.994.

Null texts count as empty. Texts without words are near nothing but equal to equal
ones. Class ids are the least doc_id of the class, null if it has none. Rows with a
null or repeated id are rows of their own. Empty tables give empty results. Extra
columns are ignored, and kept by `deduplicated`. Whole texts count, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, kept, likely, salted_join, scratch, small_batches, stored
from .tokens import mixed, powers, windows, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
DF_BUCKETS = 1 << 17
TABLE_BITS = 16
#: Texts and bytes of the two sides of a tile, and columns of its matrices at once.
TILE_OTHERS, TILE_MEMBERS, TILE_BYTES, TILE_COLUMNS = 256, 1_024, 2_000_000, 2_048
CHUNK_BYTES, CHUNK_DOCS = 800_000, 4_000
#: Members that one copy of a leader's text serves in the verification join.
SALT_ROWS = 256

_rng = np.random.Generator(np.random.PCG64(20240707))
_R = _rng.gamma(2.0, 1.0, 1 << TABLE_BITS).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, 1 << TABLE_BITS)).astype(np.float32)
_BETA = _rng.random(1 << TABLE_BITS).astype(np.float32)
_ODD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def shingles(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (52-bit ids ascending within a text, counts,
    the text's number). 4,096 texts at most."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) >= size:
        whole = np.arange(len(hashes) - size + 1) + size <= ends[of[: len(hashes) - size + 1]]
        ids, of = windows(hashes, size)[whole], of[: len(whole)][whole]
    else:
        ids, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        p = powers(size, np.uint64(0xA0761D6478BD642F))
        short = [mixed((hashes[ends[d] - counts[d] : ends[d]] * p[: counts[d]]).sum(keepdims=True, dtype=np.uint64))[0] for d in few.tolist()]
        ids, of = np.concatenate((ids, np.array(short, np.uint64))), np.concatenate((of, few))
    both = np.sort((of.astype(np.uint64) << np.uint64(52)) | (ids >> np.uint64(12)))
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(both)))
    both = both[first]
    return both & np.uint64((1 << 52) - 1), tf, (both >> np.uint64(52)).astype(np.int64)


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint64(DF_BUCKETS - 1)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for b in batches:
        for k, t in zip(b.column(0), b.column(1), strict=True):
            keys.append(k.as_py())
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES or len(texts) >= CHUNK_DOCS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and in each hash bucket of shingles the documents that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DF_BUCKETS, np.int64), 0
        for _, chunk in _chunks(batches):
            total += np.bincount(bucket_of(shingles(chunk)[0]), minlength=DF_BUCKETS)
            rows += len(chunk)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(total[held], rows))], names=["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # DF_BUCKETS + 1 rows at most
    found = dict(zip(sums["bucket"].tolist(), sums["n"].tolist(), strict=True))
    out = np.zeros(DF_BUCKETS, np.int64)
    rows = found.pop(-1, 0)
    out[list(found)] = list(found.values())
    return rows, out


def idf_of(rows: int, df: np.ndarray) -> np.ndarray:
    return (1 + np.maximum(0, np.log((rows + 1) / (df + 1))) / np.log(rows + 2)).astype(np.float32)


def band_keys(ids: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Band keys (n x BANDS) of n texts, given their shingles in order of text."""
    out = np.zeros((n, BANDS), np.uint64)
    if not len(ids):
        return out
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    lengths = np.diff(np.append(starts, len(of)))
    ln_w = np.log(weights).astype(np.float32)
    scattered = mixed(ids)
    own = np.zeros((len(starts), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        at = ((scattered * _ODD[k]) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        r = _R[at]
        b = _BETA[at]
        t = np.floor(ln_w / r + b)
        ln_a = _LN_C[at] - r * (t - b + np.float32(1))
        least = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, starts), lengths))
        text = of[least]
        least = least[np.concatenate(([True], text[1:] != text[:-1]))]
        own[:, k] = mixed(ids[least] + (t[least].astype(np.int64).astype(np.uint64) << np.uint64(52)))
    banded = own.reshape(len(starts), BANDS, ROWS) * powers(ROWS, np.uint64(0xE7037ED1A0B428DB))
    out[of[starts]] = mixed(banded.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return out


def sketches(texts: DataFrame, idf) -> DataFrame:
    """key, bands (array of long; empty without words) for each row of (key, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = idf.value
        for keys, chunk in _chunks(batches):
            ids, tf, of = shingles(chunk)
            bands = band_keys(ids, tf * weigh[bucket_of(ids)], of, len(chunk)).view(np.int64)
            has = np.bincount(of, minlength=len(chunk)) > 0
            ends = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[has].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], names=["key", "bands"])

    return texts.mapInArrow(each, "key binary, bands array<bigint>")


def similarities(a: tuple, b: tuple, weigh: np.ndarray) -> tuple[float, float]:
    """The weighted Jaccard similarities with tf and with tf * idf."""
    (x, m), (y, n) = a, b
    at = np.minimum(np.searchsorted(y, x), len(y) - 1) if len(y) else np.zeros(0, np.int64)
    if not len(x) or not len(y):
        return 0.0, 0.0
    both = y[at] == x
    least = np.minimum(m[both], n[at[both]])
    plain = least.sum()
    w = (least * weigh[bucket_of(x[both])]).sum()
    of_x, of_y = (m * weigh[bucket_of(x)]).sum(), (n * weigh[bucket_of(y)]).sum()
    return float(plain / (m.sum() + n.sum() - plain)), float(w / (of_x + of_y - w))


def _verified(pairs: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, linked) from (a, b, text_a, text_b)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = idf.value
        for b in batches:
            sizes = pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at, found = 0, []
            while at < b.num_rows:
                reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right"))
                end = min(max(at + 1, reach), at + CHUNK_DOCS // 2)
                left, right = (b.column(c).slice(at, end - at).to_pylist() for c in (2, 3))
                number = {t: k for k, t in enumerate(dict.fromkeys([*left, *right]))}
                ids, tf, of = shingles(list(number))
                cuts = np.searchsorted(of, np.arange(len(number) + 1)).tolist()
                part = lambda t: slice(cuts[number[t]], cuts[number[t] + 1])  # noqa: B023, E731
                for x, y in zip(left, right, strict=True):
                    x, y = part(x), part(y)
                    found.append(similarities((ids[x], tf[x]), (ids[y], tf[y]), weigh))
                at = end
            both = np.array(found, np.float64).reshape(-1, 2)
            linked = both.max(axis=1, initial=0) >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return pairs.mapInArrow(each, "a binary, b binary, linked boolean")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of pairs (a, b, n): b is a leader, whose text is copied
    once for each SALT_ROWS members of its buckets, so no task gets all of a group."""
    salts = lambda n: F.ceil(n / F.lit(SALT_ROWS)).cast("int")
    leaders = pairs.groupBy("b").agg(F.max("n").alias("n"))
    leaders = leaders.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("n")) - 1))).drop("n")
    members = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), salts(F.col("n"))).cast("int"))
    members = members.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return members.join(leaders, ["b", "salt"]).select("a", "b", "text_a", "text_b")


def _by_band(members: DataFrame, bands: DataFrame) -> DataFrame:
    """members (with their band's size n) joined with `bands` (one row a band, with n): a
    band's row is copied once for each SALT_ROWS members, so none meets in one task."""
    salts = F.ceil(F.col("n") / F.lit(SALT_ROWS)).cast("int")
    copies = bands.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return members.withColumn("_salt", F.pmod(F.xxhash64("key"), salts).cast("int")).join(copies, ["band", "_salt"]).drop("_salt")


def links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): edges between different texts whose components are those of all verified
    links; `texts` is (key, text)."""
    spark = texts.sparkSession
    small_batches(spark)
    rows, df = document_frequencies(texts)
    idf = spark.sparkContext.broadcast(idf_of(rows, df))
    nodes = stored(sketches(texts, idf).dropDuplicates(["key"]), "near-sketches")
    members = nodes.select("key", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(salted_join(members, sizes, "band", "inner"), "near-members")
    scores = members.groupBy("key").agg(F.sum("n").alias("score"))
    wanted = stored(likely(texts, scores.select("key"), "key").dropDuplicates(["key"]), "near-texts")
    scored = members.join(scores, "key")
    best = scored.groupBy("band", "n").agg(F.max(F.struct("score", "key"))["key"].alias("b"))
    facing = _by_band(members, best).filter(F.col("key") != F.col("b"))
    facing = facing.groupBy(F.col("key").alias("a"), "b").agg(F.max("n").alias("n"))
    first = stored(_verified(_with_texts(facing, wanted), idf, threshold).filter("linked").select("a", "b"), "near-first")
    roots = components(first)
    edges = roots.select(F.col("key").alias("a"), F.col("root").alias("b"))
    return edges.unionByName(_closing(members, roots, wanted, idf, threshold))


def _closing(members: DataFrame, roots: DataFrame, wanted: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): pairs of roots whose classes have linked members in one bucket."""
    classed = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lengths = wanted.select("key", F.octet_length("text").cast("long").alias("bytes"))
    classed = stored(classed.join(lengths, "key"), "near-classed")
    h = F.xxhash64("key")
    groups = classed.groupBy("band", "n", "root").agg(
        F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("y")
    )
    bands = groups.groupBy("band", "n").agg(
        F.max(F.struct("size", "root", "bytes")).alias("top"), F.count("*").alias("classes"), F.sum("bytes").alias("bytes"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")
    )
    bands = bands.filter("classes > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "top", "bytes")).alias("s"))
    blocks = lambda rows, size, most: F.greatest(F.lit(1), F.ceil(rows / F.lit(most)), F.ceil(size / F.lit(TILE_BYTES))).cast("int")
    bands = bands.select(
        F.col("s.band").alias("band"), "n", F.col("s.top.root").alias("largest"),
        blocks(F.col("n") - F.col("s.top.size"), F.col("s.bytes") - F.col("s.top.bytes"), TILE_OTHERS).alias("n_o"), blocks(F.col("n"), F.col("s.bytes"), TILE_MEMBERS).alias("n_m"),
    )
    open_ = _by_band(classed.select("key", "band", "n", "root"), bands)
    place = lambda n: F.pmod(F.xxhash64("key", F.lit(1)), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    others = open_.filter("root <> largest").select("key", "root", "band", place("n_o").alias("o"), F.explode(all_of("n_m")).alias("m"), F.lit(True).alias("other"))
    all_members = open_.select("key", "root", "band", F.explode(all_of("n_o")).alias("o"), place("n_m").alias("m"), F.lit(False).alias("other"))
    placed = others.unionByName(all_members).join(wanted, "key")
    tiled = placed.select(F.struct("band", "o", "m").alias("tile"), "other", "key", "root", "text").repartition(F.col("tile")).sortWithinPartitions("tile")
    tiled = tiled.select(F.concat_ws(",", "tile.band", "tile.o", "tile.m").alias("tile"), "other", "root", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = idf.value
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = _tile_links(held, weigh, threshold)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # Tiles are held whole, several small ones together.
                if held and row[0] != held[-1][0] and (size >= CHUNK_BYTES or len(held) >= CHUNK_DOCS // 2):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield out()

    return tiled.mapInArrow(each, "a binary, b binary")


def _tile_links(rows: list[tuple], weigh: np.ndarray, threshold: float) -> set[tuple[bytes, bytes]]:
    """Linked pairs of roots from rows (tile, other, root, text) in order of tile."""
    texts = list(dict.fromkeys(r[3] for r in rows))
    number = {t: k for k, t in enumerate(texts)}
    parts = [shingles(texts[k : k + CHUNK_DOCS]) for k in range(0, len(texts), CHUNK_DOCS)]
    ids, tf = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    of = np.concatenate([p[2] + k * CHUNK_DOCS for k, p in enumerate(parts)])
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    starts = np.flatnonzero([True, *(x[0] != y[0] for x, y in zip(rows, rows[1:], strict=False))]).tolist()
    found: set[tuple[bytes, bytes]] = set()
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        sides = [[(number[t], root) for _, o, root, t in rows[start:end] if o == other] for other in (True, False)]
        if not all(sides) or len({r for side in sides for _, r in side}) < 2:
            continue
        close = _close_pairs([[(ids[cuts[k] : cuts[k + 1]], tf[cuts[k] : cuts[k + 1]]) for k, _ in side] for side in sides], weigh, threshold)
        names = [[r for _, r in side] for side in sides]
        found.update((max(p), min(p)) for p in {(names[0][i], names[1][j]) for i, j in zip(*(x.tolist() for x in np.nonzero(close)), strict=True)} if p[0] != p[1])
    return found


def _close_pairs(sides: list[list[tuple[np.ndarray, np.ndarray]]], weigh: np.ndarray, threshold: float) -> np.ndarray:
    """Whether text i of the first side and j of the second have the similarity; texts are
    (shingle ids, counts). A shingle that comes n times counts as n different tokens,
    so a product of 0/1 matrices sums the lesser counts."""
    tokens, docs, weights, plain, weighted = [], [], [], [], []
    for side in sides:
        ids = np.concatenate([x for x, _ in side])
        tf = np.concatenate([n for _, n in side])
        doc = np.repeat(np.arange(len(side)), [len(x) for x, _ in side])
        w = weigh[bucket_of(ids)].astype(np.float64)
        plain.append(np.bincount(doc, tf, len(side)))
        weighted.append(np.bincount(doc, tf * w, len(side)))
        again = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        tokens.append(mixed(np.repeat(ids, tf) + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        docs.append(np.repeat(doc, tf))
        weights.append(np.repeat(w, tf))
    shared, first = np.unique(tokens[0], return_index=True)
    there = np.isin(shared, tokens[1])
    shared, w = shared[there], weights[0][first[there]]
    both, both_w = np.zeros((len(sides[0]), len(sides[1]))), np.zeros((len(sides[0]), len(sides[1])))
    columns = [np.searchsorted(shared, t) for t in tokens]
    known = [(c < len(shared)) & (shared[np.minimum(c, len(shared) - 1)] == t) if len(shared) else np.zeros(len(t), bool) for c, t in zip(columns, tokens, strict=True)]
    for at in range(0, len(shared), TILE_COLUMNS):
        halves = []
        for side, c, k, d in zip(sides, columns, known, docs, strict=True):
            inside = k & (c >= at) & (c < at + TILE_COLUMNS)
            x = np.zeros((len(side), min(TILE_COLUMNS, len(shared) - at)))
            x[d[inside], c[inside] - at] = 1
            halves.append(x)
        both += halves[0] @ halves[1].T
        both_w += (halves[0] * w[at : at + TILE_COLUMNS]) @ halves[1].T
    own = both / (plain[0][:, None] + plain[1] - both)
    return np.maximum(own, both_w / (weighted[0][:, None] + weighted[1] - both_w)) >= threshold - 1e-9


def components(edges: DataFrame) -> DataFrame:
    """(key, root): for each node of an edge the least node of its component.

    Large-star and small-star steps until nothing changes. Both take least
    neighbours by a combining aggregate, so a node's neighbours never meet in a task.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        """e: (a, b) from each node a to its neighbours b of interest."""
        least = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        out = e.join(least, "a")
        if larger:
            return out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(down(edges.filter(F.col("a") != F.col("b"))).distinct(), "near-edges")
    # Done when every edge leads straight to a root: no node is both an a and a b, and no a has two.
    while not _is_stars(edges):
        edges = stored(star(down(star(both(edges), larger=True)), larger=False), "near-stars")
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))


def _is_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key (of the text), class_id, class_size: one row for each document. It is
    stored; the folders of the steps before it are gone when this returns."""
    with scratch(docs.sparkSession) as made:
        return kept(_classes(docs, threshold), "near-classes", made)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    texts = docs.select(key_of(body()).alias("key"), body().cast("binary").alias("text"))
    roots = components(links(texts, threshold))
    ids = stored(docs.select("doc_id", key_of(body()).alias("key")), "near-ids")
    keys = ids.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    keys = keys.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = keys.groupBy("root").agg(F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size"))
    # Only classes of several documents are looked up, each in SALTS copies, so that one
    # class or text with many documents does not meet in one task.
    large = salted_join(keys.select("key", "root"), sizes.filter("class_size > 1"), "root", "inner").select("key", "class_id", "class_size")
    found = salted_join(ids, large, "key", "left")
    return found.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its columns."""
    found = classes(docs, threshold)
    drop = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    # Of rows with the same least id, one stays; ids are nearly always unique, so look first.
    again = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("key"))).count().filter("count > 1")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key_of(body()).alias("_k"))
    stays = keyed.join(drop, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left_anti")
    if not again.isEmpty():
        stays = stays.withColumn("_one", F.coalesce(F.col("row.doc_id").cast("string"), F.hex("_k"))).dropDuplicates(["_one"])
    return stays.select("row.*")


def op5_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "class_size")
