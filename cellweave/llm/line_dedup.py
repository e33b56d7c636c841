"""Line dedup across documents by a deletion-neighbourhood join.

A line is a \\n-separated piece of a text with a word in it, taken as its words joined by
single blanks. Two lines are near at one edit, and the unit of an edit grows with the line:

* a word changed, added or left out, if the longer has NEAR_WORDS words or more;
* a character changed, added or left out, if the shorter has fewer words than that and the
  longer NEAR_CHARS characters or more. Lines below that are only equal or different:
  an edit there would be more than a twentieth of the line.

A line is dropped if an equal or near line stands earlier anywhere, in order of (doc_id,
text hash, line number); the earliest of them is named as its `keep`. That needs no
chain: it is decided against all lines, dropped or not.

1. Equal lines meet by the hash of their words, as a combining aggregate.
2. Two lines at distance 1 agree in the first or the second half of the shorter. Distinct
   lines that share neither half with any other have no neighbour and go no further;
   this loses nothing and keeps the neighbourhoods small.
3. The others emit their deletion neighbourhood, over words and, where they are short,
   over characters: for each unit the hash of the line without it. With the unit's place
   in the key, equal keys are lines that differ in that one unit; without, a key equal to
   the hash of a whole line tells a unit more. Hashes of units are combined so that all
   of a line's keys cost one pass.
4. Equal keys are joined to their earliest line only, never to each other: lines with
   the same place and the same rest are all at distance 1 of the earliest.
5. Each pair is verified on its words or characters.

Null texts have no lines. Rows with a null id come last in order. Rows of equal id are told
apart by their text; rows that are equal in both count as one place, so their lines are
kept or dropped alike. An empty table gives an empty result. Extra columns are kept by
`deduplicated`, whatever their names. Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, kept, let, likely, salted_join, scratch, stored, words

NEAR_WORDS, NEAR_CHARS = 10, 20
LAST = (1 << 63) - 1


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.col("text_hash"), F.col("line_no"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), w (its words), key of each line with a word."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("text_hash"), F.posexplode(F.split(body(), "\n")).alias("line_no", "line"))
    found = found.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"line_no": F.col("line_no").cast("long"), "w": words(F.col("line"))}).drop("line")
    return found.withColumn("key", F.unhex(F.md5(F.concat_ws(" ", "w"))))


def _halves(w: Column) -> Column:
    """Hashes of the first and second half, as if the line had n or n - 1 units, of its
    words and of its characters, for those units in which it can have neighbours."""

    def of(unit: str, t: Column, first, last) -> list[Column]:
        half = F.floor(t / 2).cast("int")
        return [F.xxhash64(F.lit(unit), F.lit("first"), t, first(half)), F.xxhash64(F.lit(unit), F.lit("second"), t, last(t - half))]

    def both(unit: str, n: Column, first, last) -> Column:
        return F.array(*of(unit, n, first, last), *of(unit, n - 1, first, last))

    def of_chars(s: Column) -> Column:
        n = F.length(s)
        own = both("c", n, lambda k: F.substring(s, 1, k), lambda k: F.substring(s, n - k + 1, k))
        return F.when(n >= NEAR_CHARS - 1, own).otherwise(none)

    none = F.array().cast("array<bigint>")
    n = F.size(w)
    by_word = F.when(n >= NEAR_WORDS - 1, both("w", n, lambda k: F.slice(w, 1, k), lambda k: F.slice(w, n - k + 1, k))).otherwise(none)
    return F.when(n > NEAR_WORDS, by_word).otherwise(F.concat(by_word, let(F.concat_ws(" ", w), of_chars)))


def units(texts: DataFrame) -> DataFrame:
    """key, first, unit ("w" or "c"), u (the line in such units), emits (whether it may be
    the longer of a near pair) from (key, first, w)."""
    n = F.size("w")
    line = F.concat_ws(" ", "w")
    none = F.array().cast("array<string>")
    chars = F.when((n <= NEAR_WORDS) & (F.length(line) >= NEAR_CHARS - 1), F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))).otherwise(none)
    by_word = F.when(n >= NEAR_WORDS - 1, F.col("w")).otherwise(none)
    each = F.array(F.struct(F.lit("w").alias("unit"), by_word.alias("u")), F.struct(F.lit("c").alias("unit"), chars.alias("u")))
    out = texts.select("key", "first", F.explode(each).alias("x")).filter(F.size("x.u") > 0)
    return out.select("key", "first", "x.unit", "x.u", (F.size("x.u") >= F.when(F.col("x.unit") == "w", NEAR_WORDS).otherwise(NEAR_CHARS)).alias("emits"))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def changed_keys(w: Column, unit: Column) -> Column:
    """For each unit the key of its place and the line without it."""
    n = F.size(w)
    return let(
        F.transform(w, lambda x, i: F.xxhash64(i, x)),
        lambda h: let(_xor(h), lambda t: F.transform(h, lambda x, i: F.xxhash64(F.lit("changed"), unit, n, i, t.bitwiseXOR(x)))),
    )


def _bag(w: Column) -> Column:
    """36-bit hashes of units, to be added: one that comes twice does not cancel out, and
    sums cannot overflow."""
    return F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 36)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def less_keys(w: Column, unit: Column) -> Column:
    """For each different unit the key of the line without it, whatever its place."""
    return let(_bag(w), lambda h: let(_sum(h), lambda t: F.array_distinct(F.transform(h, lambda x: F.xxhash64(F.lit("less"), unit, F.size(w) - 1, t - x)))))


def whole_key(w: Column, unit: Column) -> Column:
    """What less_keys of a line with one unit more can equal."""
    return F.xxhash64(F.lit("less"), unit, F.size(w), _sum(_bag(w)))


def is_neighbour(a: Column, b: Column) -> Column:
    """Whether lists of units a and b are at distance 1; len(a) >= len(b)."""
    n, m = F.size(a), F.size(b)
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")  # from 1; 0: a == b
    rest = lambda w, size, start: F.slice(w, start, F.greatest(size - start + 1, F.lit(0)))
    changed = rest(a, n, differs + 1) == rest(b, m, differs + 1)
    added = rest(a, n, differs + 1) == rest(b, m, differs)
    return (differs > 0) & F.when(n == m, changed).when(n == m + 1, added).otherwise(False)


def distinct_lines(found: DataFrame) -> DataFrame:
    """key, first (place of the earliest such line), copies, halves; found: (doc_id,
    text_hash, line_no, key, halves)."""
    return found.groupBy("key").agg(F.min(_place()).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves"))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """key, near (place of the earliest line at distance 1, if earlier than the line's own)."""
    halves = distinct.select("key", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    left = salted_join(halves, shared, "half", "left_semi").select("key").distinct()
    left = stored(left.join(distinct.select("key", "first"), "key"), "lines-left")
    # The words are read again, only from the documents in which such a line stands first.
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    there = likely(docs.select("doc_id", "text").withColumn("_at", own), left.select(F.col("first.doc_id").alias("_at")), "_at")
    texts = lines(there).select("key", _place().alias("first"), "w").join(left, ["key", "first"]).dropDuplicates(["key"])
    texts = stored(units(texts), "lines-texts")
    longer = texts.filter("emits")
    keys = longer.select("key", "first", F.explode(changed_keys(F.col("u"), F.col("unit"))).alias("k"), "unit")
    best = keys.groupBy("k").agg(F.min(F.struct("first", "key")).alias("b"), F.count("*").alias("n"))
    best = stored(best.filter("n > 1").select("k", "b"), "lines-best")
    changed = salted_join(likely(keys.select("k", "key", "unit"), best, "k"), best, "k")
    changed = changed.select("key", "unit", F.col("b.key").alias("other"), F.col("b.first").alias("near")).filter("key <> other").distinct()
    whole = texts.select(whole_key(F.col("u"), F.col("unit")).alias("k"), F.col("key").alias("w_key"), F.col("first").alias("w_first"))
    less = longer.select("key", "first", "unit", F.explode(less_keys(F.col("u"), F.col("unit"))).alias("k"))
    less = salted_join(likely(less, whole, "k"), whole, "k").filter("key <> w_key")
    later = F.col("first") > F.col("w_first")
    less = less.select(
        F.when(later, F.col("key")).otherwise(F.col("w_key")).alias("key"), "unit",
        F.when(later, F.col("w_key")).otherwise(F.col("key")).alias("other"), F.least("first", "w_first").alias("near"),
    )
    pairs = stored(changed.unionByName(less), "lines-pairs")
    pairs = pairs.join(texts.select("key", "unit", F.col("u").alias("a")), ["key", "unit"]).join(texts.select(F.col("key").alias("other"), "unit", F.col("u").alias("b")), ["other", "unit"])
    longer = F.size("a") >= F.size("b")
    true = is_neighbour(F.when(longer, F.col("a")).otherwise(F.col("b")), F.when(longer, F.col("b")).otherwise(F.col("a")))
    return pairs.filter(true).groupBy("key").agg(F.min("near").alias("near"))


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, keep_doc_id, keep_line_no, distance, kept of each line: the
    earliest line that is equal (distance 0) or near (1); itself if there is none. It
    is stored; the folders of the steps before it are gone when this returns."""
    with scratch(docs.sparkSession) as made:
        return kept(_decisions(docs), "lines", made)


def _decisions(docs: DataFrame) -> DataFrame:
    found = stored(lines(docs).select("doc_id", "text_hash", "line_no", "key", _halves(F.col("w")).alias("halves")), "lines-found")
    distinct = stored(distinct_lines(found), "lines-distinct")
    near = near_lines(docs, distinct)
    told = distinct.select("key", "first", "copies").join(near, "key", "left").filter("copies > 1 or near is not null")
    told = stored(told.select(F.col("key").alias("_key"), "first", F.least("first", "near").alias("keep")), "lines-told")
    rows = found.select("doc_id", "text_hash", "line_no", "key").join(told, F.col("key") == F.col("_key"), "left")
    rows = rows.withColumn("keep", F.coalesce("keep", _place())).withColumn("first", F.coalesce("first", _place()))
    return rows.select(
        "doc_id",
        "text_hash",
        "line_no",
        F.when(F.col("keep.doc_id") != LAST, F.col("keep.doc_id")).alias("keep_doc_id"),
        F.col("keep.line_no").alias("keep_line_no"),
        F.when(F.col("keep") == F.col("first"), 0).otherwise(1).cast("int").alias("distance"),
        (F.col("keep") == _place()).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, with all their columns."""
    dropped = decisions(docs).filter("not kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    dropped = dropped.agg(F.collect_set(F.col("line_no").cast("int")).alias("_drop"))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.xxhash64(body(F.col("row.text"))) == F.col("_hash")
    joined = joined.join(dropped, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & own, "left")
    left = let(
        F.split(F.col("row.text"), "\n"),
        lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_drop")), lambda i: p[i]), "\n"),
    )
    text = F.when(F.col("_drop").isNull(), F.col("row.text")).otherwise(left)
    return joined.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return decisions(docs).drop("text_hash")


SQL = f"""
WITH l AS (
  SELECT doc_id, line_no, w, array_to_string(w, ' ') AS s FROM (
    SELECT doc_id, (generate_subscripts(p, 1) - 1)::BIGINT AS line_no, regexp_extract_all(unnest(p), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)) WHERE len(w) > 0),
d AS (SELECT s, any_value(w) AS w, min((coalesce(doc_id, {LAST}), line_no)) AS first FROM l GROUP BY s),
n AS (SELECT s, first, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= {NEAR_WORDS}),
v AS (SELECT s, first, n, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v FROM n),
c AS (SELECT s, min(first) OVER (PARTITION BY n, i, v) AS near FROM v),
p AS (SELECT DISTINCT v.s AS x, v.first AS x_first, d.s AS y, d.first AS y_first FROM v JOIN d ON v.v = d.s AND len(d.w) >= {NEAR_WORDS - 1}),
e AS (SELECT s, first, length(s) AS n, unnest(range(1, length(s) + 1)) AS i FROM d WHERE len(w) <= {NEAR_WORDS} AND length(s) >= {NEAR_CHARS}),
f AS (SELECT s, first, n, i, concat(substring(s, 1, i - 1), substring(s, i + 1)) AS v FROM e),
g AS (SELECT s, min(first) OVER (PARTITION BY n, i, v) AS near FROM f),
h AS (SELECT DISTINCT f.s AS x, f.first AS x_first, d.s AS y, d.first AS y_first FROM f JOIN d ON f.v = d.s AND len(d.w) <= {NEAR_WORDS}),
a AS (SELECT s, near FROM c UNION ALL SELECT x, y_first FROM p UNION ALL SELECT y, x_first FROM p
      UNION ALL SELECT s, near FROM g UNION ALL SELECT x, y_first FROM h UNION ALL SELECT y, x_first FROM h),
m AS (SELECT s, min(near) AS near FROM a GROUP BY s),
k AS (SELECT d.s, d.first, least(d.first, coalesce(m.near, d.first)) AS keep FROM d LEFT JOIN m USING (s))
SELECT l.doc_id, l.line_no, nullif(keep[1], {LAST}) AS keep_doc_id, keep[2] AS keep_line_no,
       (CASE WHEN keep = first THEN 0 ELSE 1 END)::INTEGER AS distance, keep = (coalesce(l.doc_id, {LAST}), l.line_no) AS kept
FROM l JOIN k USING (s)
"""
