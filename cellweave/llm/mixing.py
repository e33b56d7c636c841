"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that depends on
doc_id alone (md5; on the text where it is null), and may be gone through `epochs` times. A queued copy gets
the virtual finish time (words of its source up to and including it) / (target
of its source). All queues drain at once: copies are taken in order of that time
until the total budget is spent, so each source comes within one document of its
target.

Nothing here needs a source in one place. Documents are grouped by (source,
first hex digits of the shuffle key); a running sum over those groups' totals and
one within each group give the virtual times. The global order is range-sorted the
same way: copies fall into equal slices of virtual time, the slices' totals are
summed in order, the slice in which the budget ends is sliced again while it is
large, and only then looked at row by row for the exact cut. Copies of one source have
different times, as each has a size, so what no pass can part are a few copies of
different sources; MOST_PASSES passes part all that floating point can tell apart. The result compares each copy with that cut.

Null texts have size 0, null sources are one source (last). Rows with equal id and size, or
without id and with equal text, are interchangeable. Documents of size 0 are never taken: they weigh nothing. With no
words at all every target is 0. An empty table gives an empty result. Extra
columns are kept by `mixed` and cannot clash, as the row travels as one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import body, kept, scratch, stored, words, wrapped

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Rows that a group of (source, digits) should hold, and the most hex digits used.
GROUP_ROWS = 4_000
MOST_DIGITS = 5
#: Slices of virtual time in a pass; a slice of more rows is sliced again.
SLICES = 4_096
SLICE_ROWS = 15_000
MOST_PASSES = 6


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Of the id alone, or of the text where that is null."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.md5(text))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    Sharing a budget by weight, with each target capped and the excess shared
    again, ends at target = min(cap, level * weight) for the one level that spends
    the budget. Sorted by cap / weight, the capped sources are a prefix; the level
    follows from the sums over it. Rows are sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    t = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size").cast("double") * epochs)
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    capped_before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("_budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("_cap").over(everything)))
        .withColumn("_done", F.coalesce(F.sum("_cap").over(capped_before), F.lit(0.0)))
        .withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(capped_before), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_done")) / F.col("_wleft"))
    )
    # From the first source that it leaves under its cap on, _level falls; none: all are capped.
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    t = t.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap")))
    return t.select("source", "source_size", "target")


def _plan(sizes: DataFrame, base: DataFrame, weights, share, epochs) -> DataFrame:
    """Adds source_size, target, _cum (words of the source up to here in one epoch)
    to `base`; `sizes` are its small columns."""
    n = sizes.count()
    digits = min(MOST_DIGITS, max(2, math.ceil(math.log(max(n, 1) / GROUP_ROWS, 16)) if n > GROUP_ROWS else 2))
    group = F.substring("_key", 1, digits).alias("_group")
    base = base.withColumn("_group", group)
    groups = stored(sizes.groupBy("source", group).agg(F.sum("size").alias("_n")), "mix-groups")
    shares = targets(groups.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    groups = groups.alias("g").join(shares.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")))
    groups = groups.select(F.col("g.source").alias("_source"), F.col("_group").alias("_g"), "_before", "source_size", "target")
    within = Window.partitionBy("source", "_group").orderBy("_key", "size", F.col("doc_id").asc_nulls_first())
    placed = base.withColumn("_in", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        placed.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_g")))
        .withColumn("_cum", F.col("_before") + F.col("_in"))
        .drop("_source", "_g", "_before", "_in", "_group")
    )


def _finish(epoch: int) -> Column:
    return (F.col("_cum") + F.col("source_size") * epoch).cast("double") / F.col("target")


def _cut(planned: DataFrame, epochs: int):
    """The last copy taken, as (virtual time, key, size, epoch), or None.

    Copies that start after their target is reached are never taken: at time 1
    the targets are met, and each source has one copy at most across that point.
    """
    copies = planned.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("_e", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    end = F.col("_cum") + F.col("source_size") * F.col("_e")
    copies = copies.filter((end - F.col("size")).cast("double") < F.col("target")).select(
        (end.cast("double") / F.col("target")).alias("t"), F.col("_key").alias("key"), "size", F.col("_e").alias("epoch")
    )
    budget = planned.groupBy("source").agg(F.first("target").alias("x")).agg(F.sum("x")).first()[0] or 0.0
    budget *= 1 + 1e-12
    low, high, total = 0.0, 2.0, 0
    for k in range(MOST_PASSES):
        step = (high - low) / SLICES
        place = F.least(F.floor((F.col("t") - low) / step), F.lit(SLICES)).cast("int")
        cut_in = (copies.filter((F.col("t") >= low) & (F.col("t") < high)) if k else copies).withColumn("_slice", place)
        slices = sorted(cut_in.groupBy("_slice").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect())  # SLICES + 1 rows at most
        hit = None
        for s, n, rows in slices:
            if total + n > budget:
                hit = s, rows
                break
            total += n
        if hit is None:
            return (math.inf, "", -1, -1) if total else None
        inside = cut_in.filter(F.col("_slice") == hit[0])
        if hit[1] <= SLICE_ROWS or hit[0] == SLICES or step < 1e-12:
            break
        # A copy may round into a neighbouring slice: take the bounds that the rows have.
        low, high = inside.agg(F.min("t"), F.max("t")).first()
        if low == high:
            break
        high = math.nextafter(high, math.inf)
    order = Window.orderBy("t", "key", "size", "epoch")
    inside = inside.withColumn("_sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + total)
    last = inside.filter(F.col("_sum") <= budget).orderBy(F.desc("t"), F.desc("key"), F.desc("size"), F.desc("epoch")).first()
    if last:
        return last["t"], last["key"], last["size"], last["epoch"]
    first = inside.agg(F.min("t")).first()[0]
    return (math.nextafter(first, -math.inf), "\uffff", 1 << 62, 1 << 30)  # nothing of this slice


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep_rows: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (times the mix takes it),
    taken = copies * size; with keep_rows also the document as the struct `row`."""
    base = wrapped(docs).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"),
        F.size(words(body(F.col("row.text")))).cast("long").alias("size"), shuffle_key(F.col("row.doc_id"), body(F.col("row.text")), seed).alias("_key"), *(["row"] if keep_rows else []),
    )
    with scratch(docs.sparkSession) as made:
        sizes = stored(base.drop("row"), "mix-sizes")
        planned = kept(_plan(sizes, base if keep_rows else sizes, weights, share, epochs), "mix-plan", made)
        cut = _cut(planned, epochs)
    copies = F.lit(0)
    if cut:
        at = F.struct(*[F.lit(x) for x in (float(cut[0]), cut[1], int(cut[2]), int(cut[3]))])
        for e in range(epochs):
            own = F.struct(_finish(e), F.col("_key"), F.col("size"), F.lit(e))
            starts = (F.col("_cum") + F.col("source_size") * e - F.col("size")).cast("double") < F.col("target")
            at_typed = at.cast("struct<a:double,b:string,c:bigint,d:int>")
            taken = (F.col("size") > 0) & (F.col("target") > 0) & starts
            copies = copies + F.when(taken, (own.cast("struct<a:double,b:string,c:bigint,d:int>") <= at_typed).cast("int")).otherwise(0)
    return planned.select(
        "doc_id", "size", "source", "source_size", "target", copies.cast("int").alias("copies"), *(["row"] if keep_rows else [])
    ).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    rows = mix(docs, keep_rows=True, **options)
    rows = rows.filter(F.col("copies") > 0).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("row.*")


def op8_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(f"{x}.0" for x in WEIGHTS)}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w,
      source_size::DOUBLE * {EPOCHS} AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER ()::DOUBLE * {SHARE} AS budget,
      coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
      sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft FROM w),
l AS (SELECT *, (budget - done) / wleft AS level FROM r),
t AS (SELECT source, source_size, least(cap, max(CASE WHEN level <= cap / w THEN level END) OVER () * w) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
      sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, row_number() OVER () AS rid FROM p),
q AS (SELECT rid, size, key, e, (cum + e * source_size)::DOUBLE / target AS vt
      FROM c, (SELECT unnest(range({EPOCHS})) AS e)
      WHERE size > 0 AND (cum + e * source_size - size)::DOUBLE < target),
o AS (SELECT *, sum(size) OVER (ORDER BY vt, key, size, e ROWS UNBOUNDED PRECEDING) AS upto FROM q),
k AS (SELECT rid, sum(size) AS taken FROM o
      WHERE upto <= (SELECT sum(target) FROM t) * (1 + 1e-12) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(k.taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (rid)
"""
