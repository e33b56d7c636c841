"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once for each whole text and depend on nothing else. The trees
are fitted on the driver on about FIT_ROWS labelled rows (a documented bound; rows are
chosen by a hash of the id), whose statistics, not texts, are gathered. They are
then flat arrays, broadcast (some 100 KB) and walked with numpy.

Null texts count as empty and are scored like any other. Of several labels for one id
the least counts, of several texts the least by code point; rows without a label are not
learnt from. Without learning rows
the score is 0.5 for all. Null ids and repeated rows give a row each. An empty table
gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees
from .common import fold

FIT_ROWS = 40_000
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_chars", "long_words", "symbols", "pipes", "exclaims", "upper", "digits", "stops", "not_ascii",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "log_lines", "line_words", "dup_lines", "line_ends", "blanks",
)

_CLASS = np.zeros((256, 8))
for _k, _chars in enumerate((b"#*$%&<>~^_=+\\@{}[]", b"|", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", bytes(range(128, 256)), b" \t")):
    _CLASS[list(_chars), _k] = 1


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, n_raw, n_words, n_lines = max(1, len(text)), max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    symbols, pipes, exclaims, upper, digits, stops, other, blanks = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    seen = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n_words, sum(len(w) > 20 for w in seen) / n_words, symbols / n_raw, pipes / n_words,
        exclaims / n_words, upper / n_raw, digits / n_raw, stops / n_words, other / n_raw, len(seen) / n_words, max(seen.values(), default=0) / n_words,
        again / n_words, len(pairs) / n_words, np.log1p(len(lines)), len(words) / n_lines, 1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(x.rstrip()[-1] in ".!?:" for x in lines) / n_lines, blanks / n,
    ]


def _features(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py() or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int = FIT_ROWS) -> DataFrame:
    """(y, text) of about `most` rows that may be learnt from (their id's crc32 mod 5 is
    not 0), chosen by a hash of the id; all where there are fewer. The chosen ids, a
    few bytes each and `most` in number, are broadcast, so no text is shuffled."""
    one = labels.filter(F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(column).cast("int").alias("y"))
    one = one.filter(F.col("_id").isNotNull() & (fold(F.col("_id"), 5) != 0))
    share = int(min(1.0, most / max(one.count(), 1)) * (1 << 30))
    one = one.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share)
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    again = ids.join(F.broadcast(one), "_id", "left_semi").groupBy("_id").count().filter("count > 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(one), "_id")
    # Ids are nearly always unique, so look first; else of each id's texts the least stays.
    if not again.isEmpty():
        rows = rows.groupBy("_id", "y").agg(F.min("text").alias("text"))
    return rows.select("y", "text")


def learn(rows: DataFrame) -> Trees:
    """Trees from (y, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * len(FEATURES), len(FEATURES), dtype=np.int32)), pa.array(_features(b.column(1)).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], names=["y", "x"])

    found = rows.mapInArrow(each, "y int, x array<double>").toPandas()
    if not len(found):
        return Trees(n_trees=0)
    # Order does not depend on the partitions, so a rerun grows the same trees.
    x, y = np.array(found["x"].tolist()), found["y"].to_numpy()
    order = np.lexsort((*x.T, y))
    return Trees().fit(x[order], y[order])


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.predict(_features(b.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double")


def op6_quality_model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = predict(docs, learn(labelled(docs, labels, "quality")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
