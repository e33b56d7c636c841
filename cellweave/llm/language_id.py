"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ORDER over the letters of single words (lower
case; a word starts with blanks and ends with a mark, so texts need no context across
words). All n-grams of one length lie in one sorted array of 64-bit hashes; beside
each stand, for every language that has it, the discounted probability of the n-gram and
the interpolation weight of the n-gram as a context. A text's cross-entropy in a language
is the mean of -log2 p over its symbols; the lowest wins. The margin to the second,
in bits a symbol, gives the score by a logistic curve, and a text whose score is under
`reject_below` is marked `rejected`.

Counts are taken over all learning rows as a combining aggregate. Discounts (from the counts
of counts), context totals and the continuation counts of the lower orders are all computed
from the full counts, in DataFrames. What is sent to the tasks is bounded by MODEL_ENTRIES
(n-gram, language) pairs of all orders and the single symbols, some 50 MB. Of a model that has
more, the most frequent contexts are sent, each with all that follows it in any language, so
what is sent has its exact values and every distribution sums to one. The rest stays in
a stored table. A word that needs any of it is known by its contexts: the distinct words of
this kind are joined with the table, valued in full and added to their texts' sums. The
bound decides where a word is valued, not what its value is.

The curve is fitted on rows that its model has not learnt from: learning rows
in one of FOLDS folds by text hash are left out of a second model, and up to about
CALIBRATION_ROWS of them are scored with it. Only a histogram of margins is gathered.

A word's log probabilities do not depend on its text, so a worker remembers them.

Null texts and texts without letters (Unicode letters; other numbers are none) are `und`
with score 0. Rows with a null lang are not learnt from but predicted. Repeated rows and null
ids give a row each. Without learning rows every text is `und`. An empty table gives none.
Extra columns are ignored. Of equal cross-entropies the first language by name wins.
Whole texts count.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LETTERS, Scratch, fold, kept, lowered, scratch, stored, worker_cache
from .tokens import mixed, powers

ORDER = 5
MODEL_ENTRIES = 2_000_000
CALIBRATION_ROWS = 4_000
#: One in FOLDS learning texts is held out for the curve.
FOLDS = 10
#: Bins of a bit of margin, and the last bin.
MARGIN_BINS, LAST_BIN = 256, 4_096
CHUNK_CHARS = 3_000_000
#: Word values a worker remembers before it starts anew.
CACHE_VALUES = 2_000_000
UNKNOWN = "und"
START, END = "\x02", "\x03"

#: Places x languages that `word_bits` holds at once.
PLACES = 4_000_000


def words_of(text: str) -> list[str]:
    return LETTERS.findall(lowered(text))


def _padded(words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All words with their marks in one string; which word each symbol is of;
    whether it is an event (not a start mark)."""
    lead = START * (ORDER - 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    whole = "".join([f"{lead}{w}{END}" for w in words])
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return whole, word, place >= ORDER - 1


def _hashes(whole: str, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place (0 where fewer precede)."""
    codes = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64)
    out = np.zeros(len(codes), np.uint64)
    if len(codes) >= n:
        total = np.full(len(codes) - n + 1, n, np.uint64)
        for k, p in enumerate(powers(n + 1)[1:]):
            total += mixed(codes[k : len(codes) - n + 1 + k] * p)
        out[n - 1 :] = mixed(total)
    return out


def _hash_of(grams: list[str], n: int) -> np.ndarray:
    return _hashes("".join(grams), n)[n - 1 :: n] if grams else np.zeros(0, np.uint64)


def _held_out(text) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n, n_learnt: occurrences of each ORDER-gram over all rows (lang, text),
    and over those that are not held out for the curve."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = defaultdict(Counter)
        seen: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def grams() -> None:
            for key, words in seen.items():
                names = list(words)
                if not names:
                    continue
                whole, word, event = _padded(names)
                many = np.fromiter(words.values(), np.int64, len(names))[word[event]]
                ends = np.flatnonzero(event)
                distinct, first, of = np.unique(_hashes(whole, ORDER)[event], return_index=True, return_inverse=True)
                sums = np.bincount(of, many, len(distinct)).astype(np.int64)
                held[key].update({whole[e - ORDER + 1 : e + 1]: s for e, s in zip(ends[first].tolist(), sums.tolist(), strict=True)})
            seen.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, left_out), c in held.items():
                n = pa.array(list(c.values()), pa.int64())
                none = pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), n, none if left_out else n], names=["lang", "gram", "n", "n_learnt"])
            held.clear()

        for b in batches:
            for lang, text, left_out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                t = text.as_py() or ""
                seen[lang, left_out].update(words_of(t))
                size += len(t)
                if size >= CHUNK_CHARS:
                    grams()
                    size = 0
                    if sum(map(len, held.values())) > 1_000_000:
                        yield from out()
        grams()
        yield from out()

    found = rows.select("lang", "text", _held_out("text").alias("left_out")).mapInArrow(count, "lang string, gram string, n long, n_learnt long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_learnt").alias("n_learnt"))


def _among(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of `own` are in the sorted `hashes`."""
    if not len(hashes):
        return np.zeros(len(own), bool)
    return hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own


def _tables(entries: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """For each order the distinct hashes, where each one's entries start, and the entries."""
    out = []
    for hashes, lang, gain, weight in entries:
        order = np.lexsort((lang, hashes))
        distinct, first = np.unique(hashes[order], return_index=True)
        out.append((distinct, np.append(first, len(hashes)), lang[order].astype(np.int32), gain[order].astype(np.float32), weight[order].astype(np.float32)))
    return out


class Model:
    """Tables of all languages; see the module's text.

    entries: for each order from 1 the arrays (hash of the n-gram, number of the language,
    probability, weight as a context); base: each language's weight of no context.
    contexts: for each order None if it is whole, else the hashes of the contexts whose n-grams
    are here. rest: all entries as a DataFrame (order, number, hash, gain, weight) if
    any order is not whole; it stays on the driver.
    """

    def __init__(
        self, langs: list[str], floor: float, base: np.ndarray, entries: list[tuple[np.ndarray, ...]], contexts: list[np.ndarray | None] | None = None, rest: DataFrame | None = None
    ):
        self.uid = uuid.uuid4().hex
        self.langs, self.floor, self.base = langs, floor, base.astype(np.float32)
        self.tables = _tables(entries)
        self.contexts, self.rest = contexts, rest

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def known(self, whole: str) -> list[np.ndarray]:
        """For each order, whether the tables tell all about each place of a padded string: the
        context's n-grams are here, or it has none. An n-gram is unseen if its end is, or
        if it is not among the n-grams of a context that are here."""
        start = np.frombuffer(whole.encode("utf-32-le"), "<u4") == ord(START)
        unseen, out = np.zeros(len(whole), bool), []
        for n, ((hashes, *_), contexts) in enumerate(zip(self.tables, self.contexts, strict=True), 1):
            told = np.ones(len(whole), bool)
            if contexts is not None:
                told[1:] = (_among(contexts, _hashes(whole, n - 1)) | unseen)[:-1]
            unseen = unseen | (told & ~start & ~_among(hashes, _hashes(whole, n)))
            out.append(told)
        return out

    def symbol_probabilities(self, whole: str, more: list[tuple[np.ndarray, ...]] | None = None) -> np.ndarray:
        """P of each symbol of a padded string after those before it, in each language.
        `more`: tables that count before the model's own."""
        p = np.broadcast_to(self.base * np.float32(self.floor), (len(whole), len(self.langs)))
        for n in range(1, len(self.tables) + 1):
            gain = np.zeros((len(whole), len(self.langs)), np.float32)
            weight = np.ones((len(whole), len(self.langs)), np.float32)
            own = _hashes(whole, n)
            for hashes, first, lang, gains, weights in [self.tables[n - 1]] + ([more[n - 1]] if more else []):
                if not len(hashes):
                    continue
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                place = np.flatnonzero(hashes[at] == own)
                at = at[place]
                many = first[at + 1] - first[at]
                entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at], many)
                place = np.repeat(place, many)
                gain[place, lang[entry]] = gains[entry]
                weight[place, lang[entry]] = weights[entry]
            p = gain + p
            if n < ORDER:
                # Seen as a context, the n symbols before a place weigh what is below.
                weight[1:] = weight[:-1].copy()
                weight[0] = 1
                p = p * weight
        return p

    def word_bits(self, words: list[str], more: list[tuple[np.ndarray, ...]] | None = None) -> np.ndarray:
        """Bits of each word in each language (len(words) x languages). Without `more`, those
        of words that need the rest are NaN."""
        out = []
        most = max(1, PLACES // max(1, len(self.langs)))
        ends = np.cumsum([len(w) + ORDER for w in words])
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            whole, word, event = _padded(words[at:end])
            p = self.symbol_probabilities(whole, more)[event]
            out.append(np.add.reduceat(-np.log2(np.maximum(p, 1e-12)), np.flatnonzero(np.diff(word[event], prepend=-1))))
            if self.contexts and more is None:
                out[-1][np.unique(word[event & ~np.logical_and.reduce(self.known(whole))])] = np.nan
            at = end
        return np.concatenate(out)

    def sums(self, texts: list[str], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bits in each language, number of symbols) of each text; the words that need the
        rest, whose bits are left out, as (text, word, how often)."""
        each = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        flat = [w for x in each for w in x]
        bits, symbols = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        lacking = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)
        if flat and self.langs:
            codes, names = pd.factorize(np.array(flat, object))
            values = self._remembered(names.tolist(), {} if cache is None else cache)
            lengths = np.fromiter(map(len, names), np.int64, len(names)) + 1
            if self.contexts:
                open_ = np.isnan(values[:, 0])
                values = np.where(open_[:, None], np.float32(0), values)
                at = np.flatnonzero(open_[codes])
                pair, times = np.unique(np.repeat(np.arange(len(texts)), counts)[at] * len(names) + codes[at], return_counts=True)
                lacking = pair // len(names), names[pair % len(names)], times
            has = counts > 0
            starts = (np.cumsum(counts) - counts)[has]
            bits[has] = np.add.reduceat(values[codes], starts, dtype=np.float64)
            symbols[has] = np.add.reduceat(lengths[codes], starts)
        return bits, symbols, lacking

    def entropies(self, texts: list[str], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(mean bits a symbol in each language, number of symbols) of each text."""
        bits, symbols, _ = self.sums(texts, cache)
        return bits / np.maximum(symbols, 1)[:, None], symbols

    def _remembered(self, words: list[str], cache: dict) -> np.ndarray:
        known = cache.setdefault("rows", {})
        if len(known) * len(self.langs) > CACHE_VALUES or "values" not in cache:
            known.clear()
            cache["values"] = np.zeros((0, len(self.langs)), np.float32)
        new = [w for w in words if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            cache["values"] = np.concatenate((cache["values"], self.word_bits(new).astype(np.float32)))
        return cache["values"][list(map(known.__getitem__, words))]


def _orders(counts: DataFrame) -> DataFrame:
    """model, order, lang, gram, v: what Kneser-Ney counts for the n-grams of every order.

    Model 0 is of all rows, model 1 of those that are not held out. v is the number of
    occurrences at the full order and of different symbols before the n-gram below it.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("v")) for m, c in enumerate(("n", "n_learnt"))]))
    level = counts.select("lang", "gram", each.alias("x")).select("x.model", F.lit(ORDER).alias("order"), "lang", "gram", "x.v").filter("v > 0")
    out = level
    for n in range(ORDER - 1, 0, -1):
        level = stored(level.groupBy("model", "lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("v")), "language-order")
        level = level.select("model", F.lit(n).alias("order"), "lang", "gram", "v")
        out = out.unionByName(level)
    return out


def learn(rows: DataFrame) -> tuple[Model, Model]:
    """The model of all rows (lang, text) whose lang is not null, and the one for the curve."""
    with scratch(rows.sparkSession) as made:
        return _learn(stored(gram_counts(rows.filter("lang is not null and text is not null")), "language-grams"), made)


def _learn(counts: DataFrame, made: Scratch) -> tuple[Model, Model]:
    spark = counts.sparkSession
    grams = _orders(counts)
    # A row for each order, language and model.
    spread = grams.groupBy("model", "order", "lang").agg(F.sum((F.col("v") == 1).cast("long")).alias("once"), F.sum((F.col("v") == 2).cast("long")).alias("twice"), F.count("*").alias("n")).collect()
    langs = [sorted({r["lang"] for r in spread if r["model"] == m}) for m in (0, 1)]
    if not langs[0]:
        return (Model([], 1.0, np.zeros(0), []),) * 2
    grams = grams.withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)"))
    least = {m: _least(grams, [r for r in spread if r["model"] == m], m) for m in (0, 1)}
    cut = {m: [n for n in range(1, ORDER + 1) if least[m][n]] for m in (0, 1)}
    facts = [
        (r["model"], r["order"], r["lang"], langs[r["model"]].index(r["lang"]), r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5, least[r["model"]][r["order"]])
        for r in spread
    ]
    facts = spark.createDataFrame(facts, "model int, order int, lang string, number int, discount double, least long")
    context = Window.partitionBy("model", "order", "lang", "h")
    gains = grams.withColumn("total", F.sum("v").over(context))
    heat = F.sum("v").over(Window.partitionBy("model", "order", "h")) if cut[0] or cut[1] else F.lit(0)
    gains = gains.withColumn("heat", heat).join(F.broadcast(facts), ["model", "order", "lang"]).withColumn("gain", (F.col("v") - F.col("discount")) / F.col("total"))
    gains = gains.withColumn("sent", F.col("heat") >= F.col("least"))
    weights = gains.groupBy("model", (F.col("order") - 1).alias("order"), "number", F.col("h").alias("gram")).agg((1 - F.sum("gain")).alias("weight"), F.first("sent").alias("below"))
    none, no = F.lit(None).cast("double"), F.lit(False)
    sides = gains.select("model", "order", "number", "gram", "gain", none.alias("weight"), "sent", no.alias("below"))
    sides = sides.unionByName(weights.withColumn("gain", none).withColumn("sent", no))
    merged = sides.groupBy("model", "order", "number", "gram").agg(*[F.max(c).alias(c) for c in ("gain", "weight", "sent", "below")])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, names = b.column(1).to_numpy(), b.column(3).to_pylist()
            hashes = np.zeros(len(names), np.uint64)
            for n in np.unique(order).tolist():
                own = np.flatnonzero(order == n)
                if n:
                    hashes[own] = _hash_of([names[k] for k in own.tolist()], n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hashes.view(np.int64)), *b.columns[4:]], names=["model", "order", "number", "hash", *b.schema.names[4:]])

    found = merged.mapInArrow(hashed, "model int, order int, number int, hash long, gain double, weight double, sent boolean, below boolean")
    rest = None
    if cut[0] or cut[1]:
        found = kept(found, "language-rest", made)
        rest = found
    # MODEL_ENTRIES rows at most for each model, the single symbols, and the contexts of these.
    sent = found.filter("sent or below").select("model", "order", "number", "hash", F.when(F.col("sent"), F.col("gain")).alias("gain"), F.when(F.col("below"), F.col("weight")).alias("weight"))
    found = sent.toArrow()
    model, order, number = (found.column(c).to_numpy() for c in ("model", "order", "number"))
    hashes = found.column("hash").to_numpy().view(np.uint64)
    is_context = pc.is_valid(found.column("weight")).to_numpy()
    gain, weight = (pc.fill_null(found.column(c), x).to_numpy() for c, x in (("gain", 0.0), ("weight", 1.0)))
    out = []
    for m in (0, 1):
        of = [np.flatnonzero((model == m) & (order == n)) for n in range(ORDER + 1)]
        base = np.ones(len(langs[m]))
        base[number[of[0]]] = weight[of[0]]
        floor = 1.0 / (len(np.unique(hashes[of[1]][gain[of[1]] > 0])) + 1)
        contexts = [np.unique(hashes[of[n - 1]][is_context[of[n - 1]]]) if n in cut[m] else None for n in range(1, ORDER + 1)]
        entries = [(hashes[k], number[k], gain[k], weight[k]) for k in of[1:]]
        own = {"contexts": contexts, "rest": rest.filter(F.col("model") == m).select("order", "number", "hash", "gain", "weight")} if cut[m] else {}
        out.append(Model(langs[m], floor, base, entries, **own))
    return out[0], out[1]


def _least(grams: DataFrame, spread: list, model: int) -> dict[int, int]:
    """For each order how often the contexts occur at least that are sent, 0 for all, so that
    MODEL_ENTRIES bound what is sent. Single symbols are always sent; each further order may
    take an equal part of what the shorter ones have left."""
    own = {n: sum(r["n"] for r in spread if r["order"] == n) for n in range(1, ORDER + 1)}
    left, out = MODEL_ENTRIES - own[1], {1: 0}
    for n in range(2, ORDER + 1):
        share = max(left, 0) // (ORDER + 1 - n)
        if own[n] <= share:
            out[n], left = 0, left - own[n]
            continue
        out[n] = 1 << 62
        # Powers of two and a half: some sixty classes of counts, whatever there is.
        contexts = grams.filter((F.col("model") == model) & (F.col("order") == n)).groupBy("h").agg(F.sum("v").alias("heat"), F.count("*").alias("n"))
        classes = contexts.groupBy(F.floor(F.log2("heat") * 2).alias("c")).agg(F.min("heat").alias("least"), F.sum("n").alias("n"))
        for r in sorted(classes.collect(), key=lambda r: -r["least"]):
            if r["n"] > share:
                break
            out[n], share, left = r["least"], share - r["n"], left - r["n"]
    return out


def margins(bits: np.ndarray) -> np.ndarray:
    if bits.shape[1] < 2:
        return np.ones(len(bits))
    two = np.sort(bits, axis=1)[:, :2]
    return two[:, 1] - two[:, 0]


def calibrated(model: Model, rows: DataFrame) -> tuple[float, float]:
    """(a, b) of score = 1 / (1 + exp(-(a * margin + b))), by logistic regression with
    smoothed targets on about CALIBRATION_ROWS held-out rows, chosen by a hash of the text."""
    if len(model.langs) < 2:
        return 1.0, 0.0
    rows = rows.filter("lang is not null and text is not null").filter(_held_out("text"))
    share = int(min(1.0, CALIBRATION_ROWS / max(rows.count(), 1)) * (1 << 30))
    some = rows.filter(F.pmod(F.xxhash64("text", F.lit("curve")), F.lit(1 << 30)) < share).withColumn("doc_id", F.lit(None).cast("long"))
    bins = predict(some, model, keep=("lang",)).filter(F.col("lang_pred") != UNKNOWN)
    bins = bins.groupBy(F.least(F.floor(F.col("margin") * MARGIN_BINS), F.lit(LAST_BIN)).alias("bin"), (F.col("lang") == F.col("lang_pred")).alias("right")).count().toPandas()
    if not len(bins):
        return 1.0, 0.0
    bins = bins.sort_values(["bin", "right"])
    right, many = bins["right"].to_numpy(bool), bins["count"].to_numpy(float)
    y = np.where(right, (many[right].sum() + 1) / (many[right].sum() + 2), 1 / (many[~right].sum() + 2))
    w = np.zeros(2)
    design = np.column_stack(((bins["bin"].to_numpy(float) + 0.5) / MARGIN_BINS, np.ones(len(bins))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (many * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(hessian, design.T @ (many * (y - p)) - 1e-2 * w)
    return max(float(w[0]), 1e-3), float(w[1])


def predict(docs: DataFrame, model: Model, curve: tuple[float, float] = (1.0, 0.0), reject_below: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, bits (of the language told), margin, rejected, and the
    string columns named in `keep`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    a, b = curve

    def answers(first: list[pa.Array], bits: np.ndarray, symbols: np.ndarray, more: list[pa.Array]) -> pa.RecordBatch:
        langs = sent.value.langs
        bits = bits / np.maximum(symbols, 1)[:, None]
        told = (symbols > 0) & (len(langs) > 0)
        best = bits.argmin(axis=1) if langs else np.zeros(len(symbols), int)
        score = np.where(told, 1 / (1 + np.exp(-np.clip(a * margins(bits) + b, -30, 30))), 0.0) if langs else np.zeros(len(symbols))
        names = [langs[k] if t else UNKNOWN for k, t in zip(best.tolist(), told.tolist(), strict=True)]
        own = bits[np.arange(len(symbols)), best] if langs else np.zeros(len(symbols))
        return pa.RecordBatch.from_arrays(
            [*first, pa.array(names), pa.array(score), pa.array(own), pa.array(margins(bits)), pa.array(score < reject_below), *more],
            names=["doc_id", "lang_pred", "score", "bits", "margin", "rejected", *keep],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        caches = worker_cache()
        if caches.get("language_id_model") != m.uid:
            caches["language_id_model"], caches["language_id"] = m.uid, {}
        cache = caches["language_id"]
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                chunk, size, start = [], 0, at
                while at < len(texts) and size < CHUNK_CHARS:
                    chunk.append(texts[at].as_py() or "")
                    size += len(chunk[-1])
                    at += 1
                bits, symbols, (of, words, times) = m.sums(chunk, cache)
                first, more = [batch.column(0).slice(start, at - start)], [batch.column(2 + k).slice(start, at - start) for k in range(len(keep))]
                if not m.contexts:
                    yield answers(first, bits, symbols, more)
                    continue
                ends = np.searchsorted(of, np.arange(len(chunk) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(words, pa.string()), pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*first, pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(symbols), *lists, *more], names=["doc_id", "sums", "symbols", "words", "times", *keep])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield answers([batch.column("doc_id")], bits, batch.column("symbols").to_numpy(), [batch.column(c) for c in keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kinds = [f"{c} string" for c in keep]
    schema = ", ".join(["doc_id long, lang_pred string, score double, bits double, margin double, rejected boolean", *kinds])
    if model.rest is None:
        return rows.mapInArrow(each, schema)
    some = rows.mapInArrow(each, ", ".join(["doc_id long, sums array<double>, symbols long, words array<string>, times array<long>", *kinds]))
    some = stored(some.withColumn("_row", F.monotonically_increasing_id()), "language-sums")
    uses = some.select("_row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("_row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    values = stored(_valued(uses.select("word").distinct(), model, sent), "language-words")
    langs = range(len(model.langs))
    added = uses.join(values, "word").groupBy("_row").agg(F.array(*[F.sum(F.col("times") * F.col("value")[k]) for k in langs]).alias("added"))
    some = some.join(added, "_row", "left").withColumn("sums", F.array(*[F.col("sums")[k] + F.coalesce(F.col("added")[k], F.lit(0.0)) for k in langs]))
    return some.select("doc_id", "sums", "symbols", *keep).mapInArrow(last, schema)


def _valued(words: DataFrame, model: Model, sent) -> DataFrame:
    """word, value: the bits in each language of words that need the rest. Only what the
    sent tables do not tell is looked up."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0)
            if not len(names):
                continue
            whole, word, event = _padded(names.to_pylist())
            told = sent.value.known(whole)
            for n in range(2, ORDER + 1):
                place = np.flatnonzero(event & ~told[n - 1])
                for order, at in ((n, place), (n - 1, place - 1)):
                    asks = pa.array(_hashes(whole, order)[at].view(np.int64))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(word[place])), pa.array(np.full(len(at), order, np.int32)), asks], names=["word", "order", "hash"])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten()
            order, number, hashes, gain, weight = (x.field(k) for k in range(5))
            order, number, hashes = order.to_numpy(), number.to_numpy(), hashes.to_numpy().view(np.uint64)
            gain, weight = (pc.fill_null(c, v).to_numpy() for c, v in ((gain, 0.0), (weight, 1.0)))
            of = [np.flatnonzero(order == n) for n in range(1, ORDER + 1)]
            more = _tables([(hashes[k], number[k], gain[k], weight[k]) for k in of])
            bits = sent.value.word_bits(b.column(0).to_pylist(), more).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.tolist(), pa.list_(pa.float64()))], names=["word", "value"])

    asks = words.mapInArrow(asked, "word string, order int, hash long").distinct()
    found = F.when(F.col("number").isNotNull(), F.struct("order", "number", "hash", "gain", "weight"))
    found = asks.join(model.rest, ["order", "hash"], "left").groupBy("word").agg(F.collect_list(found).alias("found"))
    return found.mapInArrow(valued, "word string, value array<double>")


def op2_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = docs.filter(fold(F.col("doc_id"), 3) != 1).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as made:
        model, other = learn(rows)
        found = predict(docs, model, calibrated(other, rows))
        found = found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "bits", "margin", "rejected")
        return found if model.rest is None else kept(found, "languages", made)
