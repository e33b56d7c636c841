"""Shared pieces of the text operators: table access, lineage cuts, workers' caches."""

from __future__ import annotations

import contextlib
import contextvars
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF, CR.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where that is unset (local runs and tests only)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


class Scratch(list):
    """Folders made within a `scratch` block; `outer` is the block around it."""

    outer: Scratch | None = None


_made: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the folders that are made within the block, but for those that `kept`
    makes: what leaves the block may read these only."""
    made = Scratch()
    made.outer = _made.get()
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def kept(df: DataFrame, what: str, made: Scratch) -> DataFrame:
    """`df` stored in a folder that outlives the innermost block, `made`; a block around
    that one deletes it."""
    path = new_path(df.sparkSession, what)
    made.remove(path)
    if made.outer is not None:
        made.outer.append(path)
    return stored(df, what, path)


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes unless the session has a bound of its own. Spark's are
    10,000 rows or 64 MB, and both processes hold several of them for each task. The bound
    stays with the session; it changes no result."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: what a lost executor held is read again from there
    instead of being computed anew, and non-deterministic inputs stay fixed.
    """
    spark = df.sparkSession
    path = path or new_path(spark, what)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API (any store)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that no name of theirs can clash with
    the columns an operator adds. `unwrapped` restores them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unwrapped(df: DataFrame) -> DataFrame:
    names = df.schema["row"].dataType.fieldNames()
    return df.select(*[F.col("row").getField(c).alias(c) for c in names])


def body(col: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, whatever the optimiser inlines."""
    return F.transform(F.array(value), use).getItem(0)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal digits modulo `parts`; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0).cast("long"))


#: Copies of a row in `salted_join`.
SALTS = 16


def salted_join(rows: DataFrame, looked_up: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join in which each row of `looked_up` stands in SALTS copies, so that the rows of
    one key are dealt to SALTS tasks before adaptive skew splitting has to help."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit("salt")), F.lit(SALTS)).cast("int")
    copies = looked_up.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn("_salt", salt).join(copies, [on, "_salt"], how).drop("_salt")


#: Runs of letters, in what `lowered` gives.
LETTERS = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """In lower case, with blanks for numbers that are no digits (such as ² or Ⅷ), which
    LETTERS would take for letters."""
    text = text.lower()
    if text.isascii():
        return text
    numbers = {ord(c): " " for c in set(text) if c.isnumeric() and not (c.isalpha() or c.isdecimal())}
    return text.translate(numbers) if numbers else text


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    name = "_cellweave_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept


#: Bits of the filter in `likely`, 2 MB.
FILTER_BITS = 1 << 24


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is in `wanted`, and a few more by chance.

    A hash filter of FILTER_BITS bits in all, broadcast as 512 bitmaps of 4 KB whatever
    the number of keys; it spares a later exact join the shuffle of most other rows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = (
        wanted.select(place.alias("p"))
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_map"))
    )
    at = rows.withColumn("_p", place)
    at = at.withColumn("_bucket", F.expr("bitmap_bucket_number(_p)")).withColumn("_bit", F.expr("bitmap_bit_position(_p)"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0
    return at.join(F.broadcast(bits), "_bucket").filter(held).select(*rows.columns)
