"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the measured
values and one integer whose bit i says that rule i failed. A policy is a named,
versioned set of rules; applying one, comparing two, or asking what dropping a
rule would change is integer arithmetic on the ledger and reads no text again.

Null texts count as empty: all measures are 0 and `too_short` fails. Null ids and
repeated rows give a row each. An empty table gives an empty ledger. Extra
columns are ignored here and kept by `filter_documents`, whatever their names.
All of it is built-in DataFrame functions, a narrow map without any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, body, let, unwrapped, words, wrapped

WINDOW = 5
#: Words of the windows over which the distinct ones are counted by n_window_distinct.
SHARE_WINDOW = 1000

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_exclaims", "n_distinct_words", "n_window_distinct",
)


@dataclass(frozen=True)
class Rule:
    """`fails` is a condition over the measures; `bit` is its place in the ledger for good."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_short", 0, "n_words < 10"),
    Rule("repeats_itself", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("shouting", 3, "10 * n_exclaims > 3 * n_words"),
    Rule("repeated_lines", 4, "2 * n_dup_lines > n_lines"),
    Rule("few_distinct_words", 5, "5 * n_distinct_words < n_words"),
    Rule("long_words", 6, "word_chars > 40 * n_words"),
    Rule("few_distinct_in_windows", 7, "5 * n_window_distinct < n_words"),
)
BASE = ("too_short", "repeats_itself")

#: Versioned policies: names of the rules that reject a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "shouting"),
    "web-2": (*BASE, "symbols", "shouting", "repeated_lines", "few_distinct_words", "long_words"),
    # The share of distinct words falls with the length of any text; its mean over
    # windows of SHARE_WINDOW words does not. Texts of one window fare the same.
    "web-3": (*BASE, "symbols", "shouting", "repeated_lines", "few_distinct_in_windows", "long_words"),
}
DEFAULT_POLICY = "web-3"


def mask(names, rules=RULES) -> int:
    by_name = {r.name: r for r in rules}
    return sum(1 << by_name[n].bit for n in set(names))


def _repeat_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. Each window start
    covers 5 words, less what the next such start covers again."""

    def covered(starts: Column) -> Column:
        size = F.size(starts)
        own = F.transform(
            starts,
            lambda p, k: F.when(k + 1 < size, F.least(F.lit(WINDOW), starts[F.least(k + 1, size - 1)] - p)).otherwise(WINDOW),
        )
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, k: ((k > 0) & (s.getItem(F.greatest(k - 1, F.lit(0)))["g"] == x["g"])) | ((k < last) & (s[F.least(k + 1, last)]["g"] == x["g"]))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def slow(of: Column) -> Column:
        placed = F.array_sort(F.transform(of, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(placed, lambda s: let(starts(s), covered))

    # Most texts repeat no window at all; the hash set says so at little cost.
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), slow(g)).otherwise(F.lit(0).cast("long")))


def _window_distinct(hashes: Column) -> Column:
    """Distinct words of each window of SHARE_WINDOW words, summed over the whole text."""
    own = lambda h, i: F.size(F.array_distinct(F.slice(h, i * SHARE_WINDOW + 1, SHARE_WINDOW)))
    starts = lambda h: F.sequence(F.lit(0), F.floor(F.size(h) / SHARE_WINDOW).cast("int"))
    return let(hashes, lambda h: F.aggregate(starts(h), F.lit(0).cast("long"), lambda a, i: a + own(h, i)))


def measured(wrapped_docs: DataFrame) -> DataFrame:
    """Add the measures (long) of `row.text`."""
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = (
        wrapped_docs.withColumn("_t", body(F.col("row.text")))
        .withColumn("_w", words(text))
        .withColumn("_lines", lines)
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    )
    n = F.size("_w")
    grams = let(F.col("_h"), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))
    step = step.withColumn("_g", F.when(n >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    values = {
        "n_words": n,
        "word_chars": F.length(F.concat_ws("", "_w")),
        "n_symbols": F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_g")),
        "n_lines": F.size("_lines"),
        "n_exclaims": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "n_distinct_words": F.size(F.array_distinct("_h")),
        "n_window_distinct": _window_distinct(F.col("_h")),
    }
    return step.select("row", *[v.cast("long").alias(k) for k, v in values.items()])


def with_bits(measures: DataFrame, rules=RULES) -> DataFrame:
    """Add `fail_bits`: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return measures.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, fail_bits: one row for each document."""
    return with_bits(measured(wrapped(docs.select("doc_id", "text"))), rules).select(
        F.col("row.doc_id").alias("doc_id"), *MEASURES, "fail_bits"
    )


def rejected(policy, rules=RULES) -> Column:
    """Whether the policy (a name in POLICIES, or rule names) rejects a ledger row."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules))) != 0


def filter_documents(docs: DataFrame, policy=DEFAULT_POLICY, rules=RULES) -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    return unwrapped(with_bits(measured(wrapped(docs)), rules).filter(~rejected(policy, rules)))


def ablation(led: DataFrame, policies=None, rules=RULES) -> DataFrame:
    """For each policy and each of its rules: documents rejected by the policy, by
    the rule, and by this rule alone (what dropping it would bring back).

    The ledger is first counted by fail_bits, at most 2 ** rules groups, so the
    bitwise part handles a few hundred rows whatever the corpus holds.
    """
    policies = POLICIES if policies is None else policies
    by_name = {r.name: r for r in rules}
    parts = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(names, rules)).cast("long").alias("m"), F.lit(1 << by_name[r].bit).cast("long").alias("b"))
        for p, names in policies.items()
        for r in names
    ]
    counts = led.groupBy("fail_bits").agg(F.count("*").alias("n")).withColumn("x", F.explode(F.array(*parts)))
    hit, m, b = F.col("fail_bits"), F.col("x.m"), F.col("x.b")
    total = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    return counts.groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule")).agg(
        total(hit.bitwiseAND(m) != 0, "rejected_by_policy"),
        total(hit.bitwiseAND(b) != 0, "rejected_by_rule"),
        total(hit.bitwiseAND(m) == b, "only_by_rule"),
    )


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns, the further measures and fail_bits."""
    return ledger(docs).withColumns({"base_failed": rejected(BASE), "kept": ~rejected(DEFAULT_POLICY)})


_GAP = GAP.rstrip("+")
_NOT_GAP = _GAP.replace("[", "[^")

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_NOT_GAP}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_NOT_GAP}')) AS lines
  FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
         len(list_distinct(w))::BIGINT AS n_distinct_words,
         list_sum(list_transform(range(0, len(w) // {SHARE_WINDOW} + 1),
           lambda k: len(list_distinct(w[k * {SHARE_WINDOW} + 1:(k + 1) * {SHARE_WINDOW}]))))::BIGINT AS n_window_distinct
  FROM d LEFT JOIN cover USING (rid)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)})::BIGINT AS fail_bits FROM m)
SELECT *,
       (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {mask(POLICIES[DEFAULT_POLICY])}) = 0 AS kept FROM b
"""
