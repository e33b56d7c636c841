"""Deterministic reads, regions and cells made from the driver's tables.

Each view exists twice, as a DataFrame and as SQL text for the oracle, with the same
integer arithmetic. Nothing in the operators depends on this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIG_LENGTH = 30_000
CHROMS = ("chrA", "chrN", "chrR")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as aligned reads: two samples, three contigs, barcodes from suppliers."""
    x = _table(spark, d, "lineitem").selectExpr(
        "l_linestatus AS sample", "concat('chr', l_returnflag) AS chrom", "concat('BC', l_suppkey) AS bc",
        "l_orderkey * 8 + l_linenumber AS read_seq",
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int), cast(floor(l_extendedprice) AS bigint)) AS query_name",
        "cast(datediff(cast(l_shipdate AS date), date'1995-01-01') * 10 AS bigint) AS start",
        "cast(l_quantity AS int) AS len", "cast(round(l_discount * 100) AS int) AS mapq",
        "cast(l_partkey % 4 AS string) AS umi", "cast(floor(l_extendedprice) AS bigint) AS price", "l_orderkey AS o", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s",
    )
    x = x.selectExpr(
        "*",
        "cast((o % 2) + (CASE WHEN p % 3 <> 0 THEN 2 ELSE 0 END) + (CASE WHEN p % 37 = 0 THEN 4 ELSE 0 END) + (CASE WHEN p % 5 = 0 THEN 8 ELSE 0 END)"
        " + ((s + n) % 2) * 16 + (CASE WHEN (s + n) % 2 = 0 OR p % 13 = 0 THEN 32 ELSE 0 END) + (CASE WHEN n % 4 < 2 THEN 64 ELSE 128 END)"
        " + (CASE WHEN p % 41 = 0 THEN 256 ELSE 0 END) + (CASE WHEN o % 29 = 0 THEN 1024 ELSE 0 END) AS int) AS flag",
        "CASE WHEN p % 11 = 0 THEN 'chrA' ELSE chrom END AS mate_chrom",
        "cast((100 + price % 300) * (CASE WHEN (s + n) % 2 = 1 THEN -1 ELSE 1 END) AS int) AS tlen",
        "n = 3 AND len >= 4 AS spliced",
    )
    x = x.selectExpr(
        "*",
        "start + len + CASE WHEN spliced THEN 40 ELSE 0 END AS end",
        "greatest(0, start + tlen + CASE WHEN tlen > 0 THEN -len ELSE len END) AS mate_start",
        "CASE WHEN spliced THEN array(struct(0 AS op, len div 2 AS len), struct(3 AS op, 40 AS len), struct(0 AS op, len - len div 2 AS len))"
        " ELSE array(struct(0 AS op, len AS len)) END AS cigar0",
        "CASE WHEN spliced THEN array(struct(start AS start, start + len div 2 AS end), struct(start + len div 2 + 40 AS start, start + len + 40 AS end))"
        " ELSE array(struct(start AS start, start + len AS end)) END AS blocks",
        "substring(translate(md5(query_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(least(len, 32) AS int)) AS fwd_seq",
        "len + (p % 3) AS query_len",
    )
    return x.selectExpr(
        "sample", "read_seq", "query_name", "flag", "chrom", "start", "end", "mapq", "transform(cigar0, c -> struct(cast(c.op AS int) AS op, cast(c.len AS int) AS len)) AS cigar",
        "blocks", "mate_chrom", "mate_start", "tlen", "fwd_seq", "cast(query_len AS int) AS query_len", "bc", "concat('g', p % 3) AS grp", "CASE WHEN p % 17 <> 0 THEN umi END AS umi",
    )


READS_SQL = """reads0 AS (
  SELECT l_linestatus AS sample, 'chr' || l_returnflag AS chrom, 'BC' || l_suppkey AS bc, l_orderkey * 8 + l_linenumber AS read_seq,
         concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, floor(l_extendedprice)::BIGINT) AS query_name,
         (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 10)::BIGINT AS start, l_quantity::INT AS len, round(l_discount * 100)::INT AS mapq,
         (l_partkey % 4)::VARCHAR AS umi, floor(l_extendedprice)::BIGINT AS price, l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
reads1 AS (
  SELECT *, ((o % 2) + (CASE WHEN p % 3 <> 0 THEN 2 ELSE 0 END) + (CASE WHEN p % 37 = 0 THEN 4 ELSE 0 END) + (CASE WHEN p % 5 = 0 THEN 8 ELSE 0 END)
         + ((s + n) % 2) * 16 + (CASE WHEN (s + n) % 2 = 0 OR p % 13 = 0 THEN 32 ELSE 0 END) + (CASE WHEN n % 4 < 2 THEN 64 ELSE 128 END)
         + (CASE WHEN p % 41 = 0 THEN 256 ELSE 0 END) + (CASE WHEN o % 29 = 0 THEN 1024 ELSE 0 END))::INT AS flag,
         CASE WHEN p % 11 = 0 THEN 'chrA' ELSE chrom END AS mate_chrom,
         ((100 + price % 300) * (CASE WHEN (s + n) % 2 = 1 THEN -1 ELSE 1 END))::INT AS tlen, n = 3 AND len >= 4 AS spliced FROM reads0),
reads AS (
  SELECT sample, read_seq, query_name, flag, chrom, start, start + len + CASE WHEN spliced THEN 40 ELSE 0 END AS "end", mapq, len, spliced,
         CASE WHEN spliced THEN [{'start': start, 'end': start + len // 2}, {'start': start + len // 2 + 40, 'end': start + len + 40}]
              ELSE [{'start': start, 'end': (start + len)::BIGINT}] END AS blocks,
         mate_chrom, greatest(0, start + tlen + CASE WHEN tlen > 0 THEN -len ELSE len END) AS mate_start, tlen,
         substring(translate(md5(query_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, least(len, 32)) AS fwd_seq,
         (len + (p % 3))::INT AS query_len, bc, 'g' || (p % 3) AS grp, CASE WHEN p % 17 <> 0 THEN umi END AS umi FROM reads1)"""


def contigs(spark: SparkSession, d: str) -> DataFrame:
    rows = [(c, CONTIG_LENGTH, k) for k, c in enumerate(CHROMS)]
    return spark.createDataFrame(rows, "chrom string, length bigint, chrom_idx int")


CONTIGS_SQL = "contigs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {CONTIG_LENGTH}::BIGINT, {k})" for k, c in enumerate(CHROMS)) + ") AS t(chrom, length, chrom_idx))"

_CHROM = "CASE {0} % 3 WHEN 0 THEN 'chrA' WHEN 1 THEN 'chrN' ELSE 'chrR' END"


def regions(spark: SparkSession, d: str) -> DataFrame:
    """part as stranded features of two exons."""
    x = _table(spark, d, "part").selectExpr(
        f"{_CHROM.format('p_partkey')} AS chrom", "cast(p_size * 500 + p_partkey % 97 AS bigint) AS start", "cast(60 + floor(p_retailprice) % 700 AS bigint) AS len",
        "concat(p_brand, '.', p_partkey) AS name", "CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand",
    )
    return x.selectExpr(
        "chrom", "start", "start + len AS end", "name", "strand",
        "array(struct(start AS start, start + len div 2 - 10 AS end), struct(start + len div 2 + 10 AS start, start + len AS end)) AS exons",
    )


REGIONS_SQL = f"""regions AS (
  SELECT chrom, start, start + len AS "end", name, strand,
         [{{'start': start, 'end': start + len // 2 - 10}}, {{'start': start + len // 2 + 10, 'end': start + len}}] AS exons FROM (
    SELECT {_CHROM.format("p_partkey")} AS chrom, (p_size * 500 + p_partkey % 97)::BIGINT AS start, (60 + floor(p_retailprice)::BIGINT % 700)::BIGINT AS len,
           p_brand || '.' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part))"""


def blacklist(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "supplier").selectExpr(
        f"{_CHROM.format('s_suppkey')} AS chrom", "cast(s_suppkey * 271 % 29000 AS bigint) AS start", "cast(s_suppkey * 271 % 29000 + 40 + s_nationkey * 5 AS bigint) AS end"
    )


BLACKLIST_SQL = f"""blacklist AS (
  SELECT {_CHROM.format("s_suppkey")} AS chrom, (s_suppkey * 271 % 29000)::BIGINT AS start, (s_suppkey * 271 % 29000 + 40 + s_nationkey * 5)::BIGINT AS "end" FROM supplier)"""


def groups(spark: SparkSession, d: str) -> DataFrame:
    """supplier as cell groups; some barcodes have none, sample F lacks a third."""
    x = _table(spark, d, "supplier").filter("s_suppkey % 7 <> 0").selectExpr("concat('BC', s_suppkey) AS barcode", "concat('c', s_nationkey % 4) AS cluster", "s_suppkey AS k")
    x = x.crossJoin(spark.createDataFrame([("O",), ("F",)], "sample string"))
    return x.filter("sample = 'O' OR k % 3 <> 0").select("sample", "barcode", "cluster")


GROUPS_SQL = """groups AS (
  SELECT sample, barcode, cluster FROM (
    SELECT 'BC' || s_suppkey AS barcode, 'c' || (s_nationkey % 4) AS cluster, s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0), (VALUES ('O'), ('F')) AS v(sample)
  WHERE sample = 'O' OR k % 3 <> 0)"""


def barcodes(spark: SparkSession, d: str) -> DataFrame:
    """A whitelist: two thirds of the suppliers' barcodes."""
    return _table(spark, d, "supplier").filter("s_suppkey % 3 <> 1").selectExpr("concat('BC', s_suppkey) AS bc")


BARCODES_SQL = "barcodes AS (SELECT 'BC' || s_suppkey AS bc FROM supplier WHERE s_suppkey % 3 <> 1)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a sparse matrix: suppliers are cells, parts modulo 400 are features."""
    x = _table(spark, d, "lineitem").selectExpr("concat(l_linestatus, '::BC', l_suppkey) AS cell_id", "concat('f', l_partkey % 400) AS feature_id")
    return x.groupBy("cell_id", "feature_id").agg(F.count("*").cast("double").alias("count"))


COUNTS_SQL = """counts AS (
  SELECT l_linestatus || '::BC' || l_suppkey AS cell_id, 'f' || (l_partkey % 400) AS feature_id, count(*)::DOUBLE AS count FROM lineitem GROUP BY 1, 2)"""


def genome(spark: SparkSession, d: str, tile: int = 1000) -> DataFrame:
    """Contig sequences in tiles of `tile` bases, drawn from md5 digits."""
    x = contigs(spark, d).select("chrom", F.explode(F.sequence(F.lit(0), F.lit(CONTIG_LENGTH // tile - 1))).alias("tile"))
    part = "translate(md5(concat(chrom, ':', tile, ':', i)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    return x.selectExpr("chrom", "cast(tile AS bigint) AS tile", f"substring(array_join(transform(sequence(0, {tile // 32}), i -> {part}), ''), 1, {tile}) AS seq")


GENOME_SQL = """genome AS (
  SELECT chrom, tile::BIGINT AS tile, substring(array_to_string(list_transform(range(0, 32),
         lambda i: translate(md5(chrom || ':' || tile || ':' || i), '0123456789abcdef', 'ACGTACGTACGTACGT')), ''), 1, 1000) AS seq
  FROM contigs, (SELECT unnest(range(0, 30)) AS tile))"""

SQL = {
    "reads": READS_SQL, "contigs": CONTIGS_SQL, "regions": REGIONS_SQL, "blacklist": BLACKLIST_SQL, "groups": GROUPS_SQL,
    "barcodes": BARCODES_SQL, "counts": COUNTS_SQL, "genome": GENOME_SQL,
}


def with_views(names: str, query: str) -> str:
    """The oracle's query with the named views before it."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query
