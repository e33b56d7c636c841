"""Five operators in a row: from raw documents to bit-packed token ids.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents, extra ones included. The operators delete the folders of their own steps; what a
stage's result still reads stays with it.

`run` returns the rows of the last stage. `build` also takes or tells the folder of the
token store, which is the product and is not deleted; of the tables between the stages
it keeps one at a time.

Null and empty texts fail the quality rules. Null ids, repeated ids and rows, ties and extra
columns are treated by each stage as its operator says. Empty tables, or stages that
keep nothing, give an empty store and no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import decontamination, mixing, near_dedup, quality_rules, token_output
from cellweave.llm.common import new_path, remove, scratch, stored, table
from cellweave.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies stays."""
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as its source's target weight takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, store: str | None = None) -> DataFrame:
    """Writes the token store; returns doc_id, start, n_tokens, ids_crc32 read from it."""
    return token_output.op9_token_output(spark, docs, tokenizer_path(), store)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", tokens),
]

#: The tokenizer and the sampling have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def build(spark: SparkSession, sf_dir: str, store: str | None = None) -> tuple[DataFrame, str]:
    """(the last stage's rows, the folder of the token store, which must be new)."""
    store = store or new_path(spark, "token-store")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    name, stage = STAGES[-1]
    out = stored(stage(spark, docs, sf_dir, store), f"pipeline-{name}")
    remove(spark, before)
    return out, store


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir)[0]
