"""Toxicity: a Levenshtein automaton over a lexicon trie, and context windows.

1. Lexicon. From labelled rows, words and word beginnings that stand in toxic
   texts far more often than in others. A term's evidence is in how many different contexts
   (the word and its neighbours) it stands there, one for each text, so that copies of one
   text count once; against it speaks every other text that holds the term. A term enters by its own evidence alone: LEAST_CONTEXTS, LEAST_RATIO
   and a log-likelihood ratio that makes a chance find among all candidates unlikely
   (CHANCE). No share of the toxic rows and no size of the lexicon is asked for, so more
   rows only add terms. What bounds it is the labelled rows that are fitted on.
2. Automaton. The trie of the terms, where words of FUZZY_WORD letters and beginnings of
   FUZZY_BEGINNING letters or more allow one edit and beginnings accept any ending, is
   intersected with the Levenshtein automaton by subset construction into one table of
   states and character classes. All distinct words of a batch run through it side by side
   in numpy.
3. Context. Around each hit, a window of WINDOW characters tells quotation from abuse:
   inside quotation marks, or after a word of saying, the hit counts as quoted.
   The words of saying are a fixed list of four languages.
4. Score. Logistic regression over abusive, quoted and misspelled hits and their
   density. It and the lexicon are fitted on about FIT_ROWS labelled rows (a
   documented bound), chosen by a hash of the id.

Null and empty texts are scored like texts without hits. Of several labels for one
id the least counts, of several texts the least by code point. Without toxic learning rows
the lexicon is empty and scores are the base rate. Null ids and repeated rows give a row
each. An empty table gives none. Extra columns are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, fold, lowered, scratch, stored
from .quality_model import labelled

FIT_ROWS = 60_000
FUZZY_WORD, FUZZY_BEGINNING = 5, 6
PREFIXES = (4, 5, 6, 7, 8)
#: A term has this many contexts in toxic rows, and this often more than in others; terms
#: that get in by chance are expected to be fewer than CHANCE.
LEAST_CONTEXTS, LEAST_RATIO, CHANCE = 4, 30.0, 0.1
#: A longer beginning stands in for a shorter one where it has this share of its contexts.
SAME_SHARE = 0.9
#: Bits of the filter that keeps other rows' terms from being counted, 2 MB.
FILTER_BITS = 1 << 24
WINDOW = 60
CHUNK_CHARS = 3_000_000
THRESHOLD = 0.5

# Quotation marks, and words of saying in English, German, French and Spanish.
QUOTES = "\"“”„«»‹›‘‚`"
SAYING = frozenset(
    "said says say called calling word words term quote quoted wrote writes means "
    "sagte sagt nannte heißt wort begriff zitat schrieb dit disait appelé mot terme citation écrit dijo dice llamó palabra término cita escribió".split()
)

NONE, EXACT, FUZZY = 0, 1, 2
#: Marks in the automaton's subsets, beside the numbers of trie nodes.
TAKEN, OPENED = -1, -2


def words_of(text: str) -> list[str]:
    return LETTERS.findall(lowered(text))


@dataclass
class Automaton:
    """step[state, class] is the next state; accept[state] is NONE, EXACT or FUZZY.
    State 0 is dead, 1 the start; class 0 is any letter outside the lexicon."""

    classes: dict[str, int]
    step: np.ndarray
    accept: np.ndarray

    def run(self, words: list[str]) -> np.ndarray:
        """What each word is to the lexicon."""
        state = np.ones(len(words), np.int32)
        if not words or len(self.accept) < 3:
            return np.zeros(len(words), np.int8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        of = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)
        for c, k in self.classes.items():
            if ord(c) < len(of):
                of[ord(c)] = k
        kinds = of[codes]
        alive, at = np.arange(len(words)), 0
        while len(alive):
            alive = alive[(lengths[alive] > at) & (state[alive] > 0)]
            state[alive] = self.step[state[alive], kinds[starts[alive] + at]]
            at += 1
        return self.accept[state]


def automaton(terms: list[tuple[str, bool]]) -> Automaton:
    """From (term, whether it is a beginning). Subsets are {trie node: least edits}, and
    OPENED once the word begins with a beginning but for an edit."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]  # edits that a word which ends here may have
    opens: list[int] = [-1]  # edits that a beginning which ends here may have
    limit: list[int] = [0]  # the most edits of any term below
    for term, beginning in terms:
        edits = int(len(term) >= (FUZZY_BEGINNING if beginning else FUZZY_WORD))
        node = 0
        limit[0] = max(limit[0], edits)
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
                opens.append(-1)
                limit.append(0)
            node = children[node][c]
            limit[node] = max(limit[node], edits)
        if beginning:
            opens[node] = max(opens[node], edits)
        else:
            ends[node] = max(ends[node], edits)

    def closed(subset: dict[int, int]) -> frozenset:
        todo = [x for x in subset.items() if x[0] >= 0]
        while todo:
            node, e = todo.pop()
            for child in children[node].values():  # a letter of the term is missing
                if e + 1 <= limit[child] and subset.get(child, 9) > e + 1:
                    subset[child] = e + 1
                    todo.append((child, e + 1))
        if OPENED in subset or any(0 < e <= opens[n] for n, e in subset.items()):
            # Whatever follows, the word is a fuzzy hit; only exact ones can better it.
            subset = {n: e for n, e in subset.items() if e == 0} | {OPENED: 1}
        return frozenset(subset.items())

    def accepts(subset: frozenset) -> int:
        if any(e == 0 and max(opens[n], ends[n]) >= 0 for n, e in subset if n >= 0):
            return EXACT
        return FUZZY if any(n == OPENED or e <= ends[n] for n, e in subset) else NONE

    letters = sorted({c for t, _ in terms for c in t})
    classes = {c: k + 1 for k, c in enumerate(letters)}
    start = closed({0: 0})
    numbers: dict[frozenset, int] = {frozenset(): 0, start: 1}
    rows, accept, todo = [np.zeros(len(letters) + 1, np.int32)], [NONE], [start]
    taken = numbers.setdefault(frozenset({(TAKEN, 0)}), 2)  # a beginning was met: any ending will do
    table: dict[int, np.ndarray] = {taken: np.full(len(letters) + 1, taken, np.int32)}
    said = {taken: EXACT, 1: accepts(start)}
    while todo:
        subset = todo.pop()
        row = np.zeros(len(letters) + 1, np.int32)
        # Any letter: a letter too many, or one in place of another.
        other: dict[int, int] = {}
        for node, e in subset:
            if node == OPENED:
                other[node] = e
                continue
            if e + 1 <= limit[node]:
                other[node] = min(other.get(node, 9), e + 1)
            for child in children[node].values():
                if e + 1 <= limit[child]:
                    other[child] = min(other.get(child, 9), e + 1)
        by_letter: dict[str, dict[int, int]] = {}
        for node, e in subset:
            for c, child in children[node].items() if node >= 0 else ():
                own = by_letter.setdefault(c, dict(other))
                own[child] = min(own.get(child, 9), e)
        for c in ["", *by_letter]:
            target = closed(dict(by_letter[c] if c else other))
            if any(n >= 0 and e == 0 and opens[n] >= 0 for n, e in target):
                number = taken
            else:
                if target not in numbers:
                    numbers[target] = len(numbers)
                    said[numbers[target]] = accepts(target)
                    todo.append(target)
                number = numbers[target]
            if c:
                row[classes[c]] = number
            else:
                row[:] = number
        table[numbers[subset]] = row
    for k in range(1, len(numbers)):
        rows.append(table[k])
        accept.append(said[k])
    return Automaton(classes, np.array(rows), np.array(accept, np.int8))


def terms_of(text: str) -> dict[str, int]:
    """Each word ("word ") and beginning of a text, with a hash of where it first stands."""
    words = words_of(text)
    out: dict[str, int] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if word + " " not in out:
            context = zlib.crc32(f"{before} {word} {after}".encode())
            out[word + " "] = context
            for k in PREFIXES:
                if len(word) >= k:
                    out.setdefault(word[:k], context)
    return out


def _place(term: str) -> int:
    return zlib.crc32(term.encode()) % FILTER_BITS


def _contexts(rows: DataFrame) -> DataFrame:
    """term, n: different contexts of the term in the rows, a word ("word ") or a beginning."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], None] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([c for _, c in held], pa.int64())], names=["term", "context"])

        for b in batches:
            for t in b.column(0):
                held.update(dict.fromkeys(terms_of(t.as_py() or "").items()))
                if len(held) > 500_000:
                    yield out()
                    held.clear()
        yield out()

    found = rows.select("text").mapInArrow(each, "term string, context long")
    return found.groupBy("term", "context").agg(F.count("*")).groupBy("term").agg(F.count("*").alias("n"))


def _counted(rows: DataFrame, only: bytes) -> DataFrame:
    """term, n: rows that hold the term, for terms whose place in the bitmap `only` is set."""
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        wanted = sent.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for t in b.column(0):
                words = set(words_of(t.as_py() or ""))
                terms = {w + " " for w in words}
                for k in PREFIXES:
                    terms.update(w[:k] for w in words if len(w) >= k)
                held.update(x for x in terms if wanted[(p := _place(x)) >> 3] >> (p & 7) & 1)
                if len(held) > 500_000:
                    yield out()
                    held.clear()
        yield out()

    return rows.select("text").mapInArrow(each, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _bitmap(terms: DataFrame) -> bytes:
    """FILTER_BITS bits, set at the places of the terms."""
    place = (F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1).alias("p")
    parts = terms.select(place).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    out = bytearray(FILTER_BITS // 8)
    # Rows of 4 KB, FILTER_BITS / 32768 at most. Spark counts places and buckets from 1.
    for r in parts.collect():
        start = (r["k"] - 1) * 4096
        out[start : start + 4096] = r["m"]
    return bytes(out)


def lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """Terms (without the blank, is a beginning) from (y, text)."""
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic:
        return []
    ones = stored(_contexts(rows.filter("y = 1")).filter(F.col("n") >= LEAST_CONTEXTS), "toxic-terms")
    candidates = ones.count()
    zeros = _counted(rows.filter("y = 0"), _bitmap(ones)).withColumnRenamed("n", "zeros")
    both = ones.join(zeros, "term", "left").fillna(0, ["zeros"])
    ratio = ((F.col("n") + 0.5) / (toxic + 1)) / ((F.col("zeros") + 0.5) / (clean + 1))
    # The log-likelihood ratio of the term's split between toxic and other rows.
    total, share = F.col("n") + F.col("zeros"), toxic / (toxic + clean)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (total * p))).otherwise(0.0)
    evidence = 2 * (part(F.col("n"), share) + (part(F.col("zeros"), 1 - share) if clean else F.lit(0.0)))
    least = 2 * float(np.log(max(candidates, 1) / CHANCE)) if clean else 0.0
    found = {r["term"]: r["n"] for r in both.filter((ratio >= LEAST_RATIO) & (evidence >= least)).select("term", "n").collect()}
    return chosen(found)


def chosen(found: dict[str, int]) -> list[tuple[str, bool]]:
    """The terms to use of {term: contexts}: words that no beginning covers, and the
    shortest beginnings but for those behind which a single word stands; beside a
    beginning also the longest one that has nearly all its contexts, as it is long
    enough to allow an edit."""
    good = sorted(found, key=lambda t: (len(t.rstrip()), t))
    words = [t.rstrip() for t in good if t.endswith(" ")]
    stems: list[str] = []
    for t in good:
        if not t.endswith(" ") and not t.startswith(tuple(stems)):
            stems.append(t)
    stems = [b for b in stems if not any(w.startswith(b) and found[b] <= 1.1 * found[w + " "] for w in words)]
    longest = [max((t for t in good if not t.endswith(" ") and t.startswith(b) and found[t] >= SAME_SHARE * found[b]), key=len) for b in stems]
    covered = tuple(stems)
    return [(b, True) for b in sorted({*stems, *longest})] + [(w, False) for w in sorted(words) if not (covered and w.startswith(covered))]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the hit text[start:end] is reported, by the window around it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    opened = sum(before.count(q) for q in QUOTES)
    if opened % 2 and any(q in after for q in QUOTES):
        return True
    return any(w in SAYING for w in LETTERS.findall(lowered(before))[-3:])


FEATURES = ("log_abuse", "log_quoted", "log_misspelled", "share", "any")


def features(texts: list[str], lex: Automaton) -> np.ndarray:
    each = [words_of(t) for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    flat = [w for x in each for w in x]
    if not flat:
        return out
    codes, names = pd.factorize(np.array(flat, object))
    kinds = lex.run(names.tolist())[codes]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    ends = np.cumsum(counts)
    hit_at = np.flatnonzero(kinds)
    for d in np.unique(np.searchsorted(ends, hit_at, side="right")).tolist():
        own = kinds[ends[d] - counts[d] : ends[d]]
        n = [0, 0, 0]
        low = lowered(texts[d])
        for k, m in zip(own.tolist(), LETTERS.finditer(low), strict=True):
            if k:
                n[1 if quoted(low, m.start(), m.end()) else 0 if k == EXACT else 2] += 1
        out[d] = np.log1p(n[0]), np.log1p(n[1]), np.log1p(n[2]), (n[0] + 0.5 * n[2]) / len(own), float(n[0] > 0)
    return out


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t.as_py() or "")
        size += len(chunk[-1])
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


@dataclass
class Model:
    lex: Automaton
    terms: list[tuple[str, bool]]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge."""
    design = np.column_stack((x, np.ones(len(x))))
    penalty = ridge * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-3
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + penalty, design.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


def learn(rows: DataFrame) -> Model:
    """From (y, text)."""
    with scratch(rows.sparkSession):
        return _learn(stored(rows, "toxic-rows"))


def _learn(rows: DataFrame) -> Model:
    terms = lexicon(rows)
    lex = automaton(terms)
    sent = rows.sparkSession.sparkContext.broadcast(lex)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([features(c, sent.value) for c in _chunks(b.column(1))] or [np.zeros((0, len(FEATURES)))])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], names=["y", *FEATURES])

    schema = ", ".join(["y int", *[f"{f} double" for f in FEATURES]])
    fit = rows.mapInArrow(each, schema).toPandas().sort_values(["y", *FEATURES])
    weights = logistic(fit[list(FEATURES)].to_numpy(), fit["y"].to_numpy(float))
    return Model(lex, terms, weights)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([features(c, sent.value.lex) for c in _chunks(b.column(1))] or [np.zeros((0, len(FEATURES)))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = predict(docs, learn(labelled(docs, labels, "toxic", FIT_ROWS)))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
