"""Registered queries: each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .operators import combine, counts, coverage, dedup, fragments, intervals, methylation, qc, signal, stats
from .operators import predicates as P
from .schema import REVERSE, cell_id, has
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "reads"):
    """Registers a function under its name, with its oracle over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql) if views else sql
        return f

    return add


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _strings(df: DataFrame, name: str) -> DataFrame:
    """Intervals as text, "a-b,c-d", so that results compare plainly."""
    return df.withColumn(name, F.array_join(F.transform(name, lambda b: F.concat_ws("-", b["start"].cast("string"), b["end"].cast("string"))), ","))


FILTER = P.ReadFilter(min_mapq=3, flag_exclude=256)
FILTER_SQL = "flag & 4 = 0 AND mapq >= 3 AND flag & 256 = 0"
CELL = "sample || '::' || bc"

# ---- reads ----


@query(
    "SELECT sample, bc, chrom, start, query_name FROM reads WHERE flag & 4 = 0 AND chrom NOT IN ('chrR') AND mapq >= 4 AND flag & 64 = 64 AND flag & 256 = 0 "
    "AND CASE WHEN flag & 1 = 1 AND tlen <> 0 THEN abs(tlen) ELSE \"end\" - start END BETWEEN 20 AND 300"
)
def read_filter(spark, d):
    f = P.ReadFilter(min_mapq=4, flag_include=64, flag_exclude=(256,), min_fragment=20, max_fragment=300, skip_chroms=("chrR",))
    return P.read_filter(V.reads(spark, d), f).select("sample", "bc", "chrom", "start", "query_name")


@query(
    "SELECT query_name, CASE WHEN flag & 1 = 1 THEN flag & 144 = 128 OR flag & 96 = 64 ELSE flag & 16 = 16 END AS forward, "
    "CASE WHEN flag & 1 = 1 THEN flag & 144 = 144 OR flag & 96 = 96 ELSE flag & 16 = 0 END AS reverse FROM reads"
)
def strand_filter(spark, d):
    return V.reads(spark, d).select("query_name", P.strand("forward").alias("forward"), P.strand("reverse").alias("reverse"))


@query("SELECT query_name, round(length(regexp_replace(fwd_seq, '[^CG]', '', 'g')) / length(fwd_seq), 6) AS gc FROM reads WHERE length(regexp_replace(fwd_seq, '[^CG]', '', 'g')) / length(fwd_seq) BETWEEN 0.4 AND 0.6")
def gc_filter(spark, d):
    return V.reads(spark, d).filter(P.gc_between(0.4, 0.6)).select("query_name", F.round(P.gc_content(), 6).alias("gc"))


@query("SELECT query_name, round(len / query_len, 6) AS fraction FROM reads WHERE len / query_len >= 0.97")
def aligned_fraction(spark, d):
    return V.reads(spark, d).filter(P.min_aligned_fraction(0.97)).select("query_name", F.round(P.aligned_fraction(), 6).alias("fraction"))


PROPER_SQL = (
    "(flag & 2 = 2 AND mate_chrom = chrom AND abs(tlen) <= {most} AND (flag & 16 = 16) <> (flag & 32 = 32) "
    "AND CASE WHEN flag & 16 = 16 THEN mate_start <= start ELSE mate_start >= start END)"
)


@query(f"SELECT query_name, flag & 1024 = 1024 AS marked, flag & 9 = 9 AS singleton FROM reads WHERE {PROPER_SQL.format(most=300)}")
def proper_pair(spark, d):
    return V.reads(spark, d).filter(P.proper_pair(300)).select("query_name", P.duplicate_mark().alias("marked"), P.singleton().alias("singleton"))


@query(
    "SELECT query_name, flag & 16 = 16 AS rev FROM (SELECT *, CASE WHEN flag & 16 = 16 THEN \"end\" - 1 ELSE start - 1 END AS b FROM reads) r "
    "LEFT JOIN genome g ON g.chrom = r.chrom AND g.tile = r.b // 1000 LEFT JOIN genome h ON h.chrom = r.chrom AND h.tile = r.b // 1000 + 1 "
    "WHERE b >= 0 AND ((substring(fwd_seq, 1, 1) = 'A' AND substring(coalesce(g.seq, '') || coalesce(h.seq, ''), (b % 1000 + 1)::INT, 2) = 'TA') "
    "OR (substring(fwd_seq, 1, 2) = 'CG' AND substring(coalesce(g.seq, '') || coalesce(h.seq, ''), (b % 1000 + 1)::INT, 2) = 'GC'))",
    "contigs genome reads",
)
def motif_filter(spark, d):
    x = P.motif(V.reads(spark, d), V.genome(spark, d), [("A", "TA"), ("CG", "GC")])
    return x.filter("motif_ok").select("query_name", has(REVERSE).alias("rev"))


@query("SELECT sample, query_name FROM reads SEMI JOIN barcodes USING (bc)", "reads barcodes")
def whitelist(spark, d):
    return P.whitelisted(V.reads(spark, d), V.barcodes(spark, d)).select("sample", "query_name")


@query("SELECT query_name, grp FROM reads WHERE (grp, bc) IN (SELECT 'g1', bc FROM barcodes)", "reads barcodes")
def group_labels(spark, d):
    labels = V.barcodes(spark, d).withColumn("grp", F.lit("g1"))
    return P.in_groups(V.reads(spark, d), labels).select("query_name", "grp")


@query("SELECT query_name, start FROM reads JOIN contigs USING (chrom) WHERE start % 1500 < CASE WHEN least((start // 1500 + 1) * 1500, length) - start // 1500 * 1500 > 1000 THEN least((start // 1500 + 1) * 1500, length) - start // 1500 * 1500 - 500 ELSE 1500 END", "reads contigs")
def chunk_sampling(spark, d):
    x = V.reads(spark, d).join(F.broadcast(V.contigs(spark, d)), "chrom")
    return x.filter(P.in_sample(1000, 500)).select("query_name", "start")


KEYS = ("start_bc", "start_bc_umi", "start_end_bc", "start_end_bc_umi")


def _key_sql(kind: str) -> str:
    umi = "umi" if "umi" in kind else "NULL::VARCHAR"
    s = "CASE WHEN tlen >= 0 THEN start ELSE mate_start END"
    e = "CASE WHEN tlen >= 0 THEN start + tlen ELSE mate_start - tlen END"
    if "end" in kind:
        return f"struct_pack(bc := bc, umi := {umi}, s := {s}, e := CASE WHEN mate_chrom <> chrom THEN mate_start ELSE {e} END, m := mate_chrom, r := flag & 16 = 16)"
    return f"struct_pack(bc := bc, umi := {umi}, s := CASE WHEN flag & 16 = 0 THEN {s} END, e := CASE WHEN flag & 16 = 16 THEN {e} END, m := chrom, r := flag & 16 = 16)"


#: Barcodes taken modulo a few, so that there are duplicates to find.
def _coarse(spark, d):
    return V.reads(spark, d).withColumn("bc", F.concat(F.lit("BC"), F.substring("bc", 3, 9).cast("int") % 5)).withColumn("mate_start", F.floor(F.col("mate_start") / 100) * 100).withColumn("tlen", F.signum("tlen").cast("int") * 100)


COARSE_SQL = "coarse AS (SELECT * REPLACE ('BC' || (substring(bc, 3)::INT % 5) AS bc, mate_start // 100 * 100 AS mate_start, sign(tlen)::INT * 100 AS tlen) FROM reads)"
V.SQL["coarse"] = COARSE_SQL


def _dedup(kind):
    def adjacent(spark, d):
        return dedup.drop_adjacent(P.read_filter(_coarse(spark, d), FILTER), kind, tile=5000).select("sample", "query_name")

    adjacent.__name__ = f"dedup_adjacent_{kind}"
    query(
        f"SELECT sample, query_name FROM (SELECT *, {_key_sql(kind)} AS k, lag({_key_sql(kind)}) OVER w AS p FROM coarse WHERE {FILTER_SQL} "
        "WINDOW w AS (PARTITION BY sample, chrom ORDER BY start, read_seq, query_name)) WHERE p IS NULL OR k IS DISTINCT FROM p",
        "reads coarse",
    )(adjacent)

    def position(spark, d):
        return dedup.drop_positional(P.read_filter(_coarse(spark, d), FILTER), kind).select("sample", "query_name")

    position.__name__ = f"dedup_position_{kind}"
    query(
        f"SELECT sample, query_name FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom, start, {_key_sql(kind)} ORDER BY read_seq, query_name) AS rn FROM coarse WHERE {FILTER_SQL}) WHERE rn = 1",
        "reads coarse",
    )(position)


for _kind in KEYS:
    _dedup(_kind)

# ---- fragments ----


@query(
    "SELECT query_name, CASE WHEN x.\"end\" > x.start THEN x.start || '-' || x.\"end\" ELSE '' END AS blocks FROM (SELECT query_name, CASE WHEN " + PROPER_SQL.format(most=600)
    + " THEN CASE WHEN flag & 16 = 16 THEN {'start': mate_start, 'end': \"end\"} ELSE {'start': start, 'end': start + abs(tlen)} END "
    "ELSE CASE WHEN flag & 16 = 16 THEN {'start': \"end\" - 150, 'end': \"end\"} ELSE {'start': start, 'end': start + 150} END END AS x FROM reads)"
)
def fragments_extend(spark, d):
    return _strings(V.reads(spark, d).select("query_name", fragments.extended(150).alias("blocks")), "blocks")


@query(
    "SELECT query_name, CASE WHEN x.\"end\" > x.start THEN (floor((x.start + x.\"end\") / 2)::BIGINT - query_len // 2) || '-' || (floor((x.start + x.\"end\") / 2)::BIGINT - query_len // 2 + query_len) ELSE '' END AS blocks FROM (SELECT query_name, query_len, CASE WHEN "
    + PROPER_SQL.format(most=600) + " THEN CASE WHEN flag & 16 = 16 THEN {'start': mate_start, 'end': \"end\"} ELSE {'start': start, 'end': start + abs(tlen)} END "
    "ELSE CASE WHEN flag & 16 = 16 THEN {'start': \"end\" - 150, 'end': \"end\"} ELSE {'start': start, 'end': start + 150} END END AS x FROM reads)"
)
def fragments_center(spark, d):
    x = V.reads(spark, d)
    return _strings(x.select("query_name", fragments.centred(150).alias("blocks")), "blocks")


@query(
    "SELECT query_name, (start + tlen // 2 - 1) || '-' || (start + tlen // 2 - 1 + CASE WHEN tlen % 2 = 0 THEN 2 ELSE 3 END) AS blocks FROM reads "
    f"WHERE {PROPER_SQL.format(most=1000)} AND flag & 16 = 0 AND tlen BETWEEN 130 AND 200 AND flag & 4 = 0"
)
def fragments_mnase(spark, d):
    x = fragments.with_fragments(V.reads(spark, d), fragments.mnase())
    return _strings(x.select("query_name", "blocks"), "blocks")


def _offset_sql(first: int, last: int) -> str:
    """By bases: spread, number from the 5' end, cut, and merge into runs."""
    cond = f"(CASE WHEN {first} > 0 THEN i >= {first} ELSE i > n + {first} END) AND (CASE WHEN {last} > 0 THEN i <= {last} ELSE i <= n + {last} + 1 END)"
    return f"""SELECT query_name, string_agg(s || '-' || e, ',' ORDER BY s) AS blocks FROM (
      SELECT query_name, min(p) AS s, max(p) + 1 AS e FROM (
        SELECT query_name, p, p - row_number() OVER (PARTITION BY query_name ORDER BY p) AS run FROM (
          SELECT query_name, p, row_number() OVER (PARTITION BY query_name ORDER BY CASE WHEN rev THEN -p ELSE p END) AS i, count(*) OVER (PARTITION BY query_name) AS n FROM (
            SELECT query_name, flag & 16 = 16 AS rev, unnest(range(b.start, b."end")) AS p FROM (SELECT query_name, flag, unnest(blocks) AS b FROM reads WHERE flag & 4 = 0)))
        WHERE {cond} AND abs({first}) <= n) GROUP BY query_name, run) GROUP BY query_name"""


@query(_offset_sql(3, 12))
def fragments_offset(spark, d):
    return _strings(fragments.with_fragments(V.reads(spark, d), fragments.offset(3, 12)).select("query_name", "blocks"), "blocks")


@query(_offset_sql(-5, -2))
def fragments_offset_from_end(spark, d):
    return _strings(fragments.with_fragments(V.reads(spark, d), fragments.offset(-5, -2)).select("query_name", "blocks"), "blocks")


@query(
    "SELECT CASE WHEN f >= r THEN f::BIGINT END AS length FROM (SELECT quantile_cont(CASE WHEN flag & 3 = 3 AND tlen BETWEEN 1 AND 2000 THEN tlen END, 0.5) AS f, quantile_cont(query_len, 0.5) AS r FROM reads)"
)
def fragment_default_length(spark, d):
    return fragments.default_length(V.reads(spark, d))


@query(
    "SELECT query_name, s AS start, e AS \"end\" FROM (SELECT query_name, greatest(CASE WHEN flag & 16 = 16 THEN start ELSE start + 4 END, 0) AS s, "
    "least(CASE WHEN flag & 16 = 16 THEN \"end\" - 5 ELSE \"end\" END, length) AS e FROM reads JOIN contigs USING (chrom) WHERE flag & 3 = 3 AND flag & 4 = 0) WHERE e > s",
    "reads contigs",
)
def shift_reads(spark, d):
    return P.shift_reads(V.reads(spark, d), V.contigs(spark, d)).select("query_name", "start", "end")


@query("SELECT chrom, start, least(start + tlen, length) AS \"end\", query_name, bc FROM reads JOIN contigs USING (chrom) WHERE tlen > 0", "reads contigs")
def bedpe(spark, d):
    return P.bedpe(V.reads(spark, d), V.contigs(spark, d))


@query("SELECT r.sample, r.query_name, g.cluster FROM reads r JOIN groups g ON r.sample = g.sample AND r.bc = g.barcode", "reads groups")
def tag_groups(spark, d):
    return P.tag_groups(V.reads(spark, d), V.groups(spark, d)).select("sample", "query_name", "cluster")


# ---- counting ----

BINS_SQL = "SELECT DISTINCT {cell} AS cell_id, chrom, query_name, unnest(range(b.start // {n}, (b.\"end\" - 1) // {n} + 1)) AS bin FROM (SELECT *, unnest(blocks) AS b FROM reads WHERE {where})"


def _bins_sql(n: int, where: str = FILTER_SQL) -> str:
    return BINS_SQL.format(cell=CELL, n=n, where=where)


V.SQL["grouped"] = "x AS (SELECT substring(cell_id, 1, 6) AS cell_id, feature_id, sum(count) AS count FROM counts GROUP BY 1, 2)"
V.SQL["binned"] = f"b AS (SELECT cell_id, chrom, bin, count(*) AS c FROM ({_bins_sql(1000)}) GROUP BY ALL)"


@query(
    f"SELECT cell_id, chrom, bin, count(*)::DOUBLE AS count, bin * 1000 AS start, least(bin * 1000 + 1000, length) AS \"end\" FROM ({_bins_sql(1000)}) JOIN contigs USING (chrom) WHERE bin * 1000 < length GROUP BY ALL",
    "reads contigs",
)
def bins_count(spark, d):
    return counts.count_bins(P.read_filter(V.reads(spark, d), FILTER), 1000, V.contigs(spark, d)).withColumn("start", F.col("start").cast("long"))


@query(f"SELECT DISTINCT cell_id, chrom, bin, 1.0::DOUBLE AS count FROM ({_bins_sql(1000)})")
def bins_binarized(spark, d):
    return counts.count_bins(P.read_filter(V.reads(spark, d), FILTER), 1000, binarize=True)


@query(
    f"SELECT cell_id, chrom, bin, count(*)::DOUBLE AS count FROM (SELECT DISTINCT {CELL} AS cell_id, chrom, query_name, k AS bin FROM "
    f"(SELECT *, unnest(range(b.start // 1500, (b.\"end\" - 1) // 1500 + 1)) AS k FROM (SELECT *, unnest(blocks) AS b FROM reads WHERE {FILTER_SQL})) "
    "WHERE k * 1500 < b.\"end\" AND k * 1500 + 1000 > b.start) JOIN contigs USING (chrom) WHERE bin * 1500 + 1000 <= length GROUP BY cell_id, chrom, bin",
    "reads contigs",
)
def bins_spaced(spark, d):
    x = intervals.to_spaced_bins(P.read_filter(V.reads(spark, d), FILTER), 1000, 500, V.contigs(spark, d))
    return x.groupBy(cell_id().alias("cell_id"), "chrom", "bin").agg(F.count("*").cast("double").alias("count"))


@query(
    f"SELECT cell_id, chrom, bin * 1000 AS start, least(bin * 1000 + 1000, 8500) AS \"end\", count(*)::DOUBLE AS count FROM ({_bins_sql(1000)}) WHERE chrom = 'chrN' AND bin BETWEEN 3 AND 8 GROUP BY cell_id, chrom, bin",
    "reads contigs",
)
def bins_region(spark, d):
    x = counts.count_bins(P.read_filter(V.reads(spark, d), FILTER), 1000, V.contigs(spark, d))
    return intervals.clip_to_region(x, "chrN", 3700, 8500, 1000).select("cell_id", "chrom", "start", "end", "count")


@query(
    f"SELECT {CELL} AS cell_id, chrom, k AS bin, sum(least(b.\"end\", (k + 1) * 1000) - greatest(b.start, k * 1000))::BIGINT AS bases FROM "
    f"(SELECT *, unnest(range(b.start // 1000, (b.\"end\" - 1) // 1000 + 1)) AS k FROM (SELECT *, unnest(blocks) AS b FROM reads WHERE {FILTER_SQL})) GROUP BY 1, 2, 3"
)
def sum_bases(spark, d):
    return counts.sum_bases(P.read_filter(V.reads(spark, d), FILTER), 1000)


@query(
    f"SELECT cell_id, chrom, start, \"end\", name, count(*)::DOUBLE AS count FROM (SELECT DISTINCT {CELL} AS cell_id, r.query_name, f.chrom, f.start, f.\"end\", f.name FROM "
    f"(SELECT *, unnest(blocks) AS b FROM reads WHERE {FILTER_SQL}) r JOIN regions f ON r.chrom = f.chrom AND r.b.start < f.\"end\" AND r.b.\"end\" > f.start) GROUP BY ALL",
    "reads regions",
)
def features_count(spark, d):
    return counts.count_features(P.read_filter(V.reads(spark, d), FILTER), V.regions(spark, d))


@query(
    f"SELECT cell_id, chrom, start, \"end\", name, count(*)::DOUBLE AS count FROM (SELECT DISTINCT {CELL} AS cell_id, r.query_name, f.chrom, f.start, f.\"end\", f.name, f.x FROM "
    f"(SELECT *, unnest(blocks) AS b FROM reads WHERE {FILTER_SQL}) r JOIN (SELECT *, unnest(exons) AS x FROM regions) f ON r.chrom = f.chrom AND r.b.start < f.x.\"end\" AND r.b.\"end\" > f.x.start) "
    "GROUP BY cell_id, chrom, start, \"end\", name",
    "reads regions",
)
def features_exons(spark, d):
    return counts.count_features(P.read_filter(V.reads(spark, d), FILTER), V.regions(spark, d), exons=True)


@query("SELECT chrom, s AS start, least(s + 100, \"end\") AS \"end\", name, strand FROM (SELECT *, unnest(range(start, \"end\", 100)) AS s FROM regions)", "regions")
def features_binned(spark, d):
    return intervals.bins_in_regions(V.regions(spark, d), 100).select("chrom", "start", "end", "name", "strand")


@query("SELECT r.chrom, r.start, r.\"end\", r.name FROM regions r WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = r.chrom AND b.start < r.\"end\" AND b.\"end\" > r.start)", "regions blacklist")
def blacklist_regions(spark, d):
    return intervals.without_blacklisted(V.regions(spark, d).select("chrom", "start", "end", "name"), V.blacklist(spark, d))


@query(
    "SELECT sample, query_name FROM reads r WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = r.chrom AND b.start < r.start + greatest(r.query_len - 1, 1) AND b.\"end\" > r.start)",
    "reads blacklist",
)
def blacklist_reads(spark, d):
    span = intervals.read_span(V.reads(spark, d).select("sample", "chrom", "start", "end", "query_len", "query_name"))
    return intervals.without_blacklisted(span, V.blacklist(spark, d)).select("sample", "query_name")


FREE_SQL = (
    "m0 AS (SELECT *, max(\"end\") OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM blacklist), "
    "m1 AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM m0), "
    "merged AS (SELECT chrom, min(start) AS start, max(\"end\") AS \"end\" FROM m1 GROUP BY chrom, k), "
    "free AS (SELECT chrom, \"end\" AS start, coalesce(lead(start) OVER (PARTITION BY chrom ORDER BY start), length) AS \"end\" FROM merged JOIN contigs USING (chrom) "
    "UNION ALL SELECT chrom, 0, min(start) FROM merged GROUP BY chrom UNION ALL SELECT chrom, 0, length FROM contigs WHERE chrom NOT IN (SELECT chrom FROM merged))"
)
V.SQL["free"] = FREE_SQL


@query("SELECT chrom, start, \"end\" FROM free WHERE \"end\" > start", "contigs blacklist free")
def blacklist_free(spark, d):
    return intervals.free_space(V.contigs(spark, d), V.blacklist(spark, d))


@query("SELECT chrom, s AS start, least(s + 700, \"end\") AS \"end\" FROM (SELECT *, unnest(range(start, \"end\", 700)) AS s FROM free WHERE \"end\" > start)", "contigs blacklist free")
def blacklist_tiles(spark, d):
    return intervals.free_bins(V.contigs(spark, d), V.blacklist(spark, d), 700)


@query(
    "SELECT r.chrom, greatest(greatest(0, r.start - 200), coalesce(max(CASE WHEN b.\"end\" <= r.start THEN b.\"end\" END), 0)) AS start, "
    "least(r.\"end\" + 200, coalesce(min(CASE WHEN b.start >= r.\"end\" THEN b.start END), r.\"end\" + 200)) AS \"end\", r.name, r.strand FROM regions r "
    "LEFT JOIN blacklist b ON b.chrom = r.chrom GROUP BY r.chrom, r.start, r.\"end\", r.name, r.strand",
    "regions blacklist",
)
def blacklist_windows(spark, d):
    return intervals.clip_windows(V.regions(spark, d).drop("exons"), V.blacklist(spark, d), 200)


# ---- statistics ----

STATS_SQL = """
  SELECT sample, bc, count(*) AS t, count_if(bad OR low OR mi OR ex OR dup OR mk OR si OR st OR gc OR al) AS f, count_if(bad) AS bad, count_if(low) AS low, count_if(mi) AS mi,
    count_if(ex) AS ex, count_if(dup) AS dup, count_if(mk) AS mk, count_if(si) AS si, count_if(st) AS st, count_if(gc) AS gc, count_if(al) AS al FROM (
    SELECT sample, bc, EXISTS (SELECT 1 FROM blacklist b WHERE b.chrom = r.chrom AND b.start < r.start + greatest(r.query_len - 1, 1) AND b."end" > r.start) AS bad,
      mapq < 3 AS low, flag & 2 <> 2 AS mi, flag & 256 <> 0 AS ex,
      row_number() OVER (PARTITION BY sample, chrom, start, {key} ORDER BY read_seq, query_name) > 1 AS dup, flag & 1024 = 1024 AS mk, flag & 9 = 9 AS si,
      NOT (CASE WHEN flag & 1 = 1 THEN flag & 144 = 128 OR flag & 96 = 64 ELSE flag & 16 = 16 END) AS st,
      NOT (length(regexp_replace(fwd_seq, '[^CG]', '', 'g')) / length(fwd_seq) BETWEEN 0.3 AND 0.7) AS gc, NOT (len / query_len >= 0.95) AS al
    FROM coarse r WHERE flag & 4 = 0) GROUP BY sample, bc""".replace("{key}", _key_sql("start_bc"))


def _statistics(spark, d):
    reads = _coarse(spark, d)
    options = P.ReadFilter(min_mapq=3, flag_include=2, flag_exclude=256, strand="forward", gc=(0.3, 0.7), min_aligned=0.95)
    cells = spark.createDataFrame([(s, f"BC{k}") for s in ("O", "F") for k in range(7)], "sample string, bc string")
    return stats.filter_statistics(reads, cells, options, "start_bc", V.blacklist(spark, d))


CELLS_SQL = "(SELECT sample, 'BC' || k AS bc FROM (VALUES ('O'), ('F')) AS v(sample), range(0, 7) AS x(k))"
_SHORT = dict(zip(stats.COUNTERS, "t f bad low mi ex dup mk si st mo gc al".split(), strict=True))


@query(
    f"SELECT c.sample || '::' || c.bc AS cell_id, " + ", ".join("0::BIGINT AS Wrong_motif" if v == "mo" else f"coalesce({v}, 0)::BIGINT AS {k}" for k, v in _SHORT.items())
    + f" FROM {CELLS_SQL} c LEFT JOIN ({STATS_SQL}) s ON c.sample = s.sample AND c.bc = s.bc",
    "reads coarse blacklist",
)
def filter_stats(spark, d):
    return _statistics(spark, d)


@query(
    f"SELECT c.sample || '::' || c.bc AS cell_id, coalesce(t, 0)::BIGINT AS Total_sampled, "
    + ", ".join("CASE WHEN t > 0 THEN 0.0::DOUBLE END AS Wrong_motif" if v == "mo" else f"round({v} * 100.0::DOUBLE / t, 6) AS {k}" for k, v in list(_SHORT.items())[1:])
    + f" FROM {CELLS_SQL} c LEFT JOIN ({STATS_SQL}) s ON c.sample = s.sample AND c.bc = s.bc",
    "reads coarse blacklist",
)
def filter_stats_percent(spark, d):
    return _round(stats.as_percent(_statistics(spark, d)), *stats.COUNTERS[1:])


@query("SELECT bc, n AS count, n >= least(20, 90) AS selected FROM (SELECT bc, count(DISTINCT (chrom, start // 1000)) AS n FROM reads GROUP BY bc)")
def filter_barcodes(spark, d):
    return stats.select_barcodes(stats.bins_per_barcode(V.reads(spark, d), 1000), 20, 90)


@query(
    "SELECT bc, n AS count, rank() OVER (ORDER BY n DESC) AS rank, round(log10(n), 6) AS log10_count FROM (SELECT bc, count(DISTINCT (chrom, start // 1000)) AS n FROM reads GROUP BY bc)"
)
def barcode_rank(spark, d):
    return _round(stats.knee(stats.bins_per_barcode(V.reads(spark, d), 1000)), "log10_count")


@query(
    "SELECT o.bc, (min({'d': hamming(o.bc, w.bc), 'l': w.bc})).l AS nearest, (min({'d': hamming(o.bc, w.bc), 'l': w.bc})).d::INT AS distance FROM (SELECT DISTINCT bc FROM reads) o JOIN barcodes w ON length(o.bc) = length(w.bc) "
    "WHERE hamming(o.bc, w.bc) <= 1 GROUP BY o.bc",
    "reads barcodes",
)
def barcode_hamming(spark, d):
    return P.hamming_barcodes(V.reads(spark, d), V.barcodes(spark, d), 1)


@query(f"SELECT count(*) AS total, count_if({FILTER_SQL})::BIGINT AS remaining FROM reads")
def filter_totals(spark, d):
    return stats.filter_totals(V.reads(spark, d), FILTER)


@query(
    "SELECT sample, chrom, w.bc IS NOT NULL AS in_whitelist, x.start, is_dup, CASE WHEN is_dup THEN 0 WHEN rn = 1 THEN coalesce(gap, 0) END AS distance, "
    "round(length(regexp_replace(fwd_seq, '[^CG]', '', 'g')) / length(fwd_seq), 6) AS gc, flag & 16 = 16 AS is_reverse, query_name FROM ("
    f"SELECT r.*, row_number() OVER (PARTITION BY r.sample, r.chrom, r.start, {_key_sql('start_bc').replace('start', 'r.start').replace('mate_r.start', 'mate_start').replace('chrom', 'r.chrom')} ORDER BY read_seq, query_name) > 1 AS is_dup, "
    "row_number() OVER (PARTITION BY r.sample, r.chrom, r.start ORDER BY read_seq, query_name) AS rn, gap FROM (SELECT * FROM coarse WHERE flag & 4 = 0 AND mapq >= 3) r "
    "JOIN (SELECT sample, chrom, start, start - lag(start) OVER (PARTITION BY sample, chrom ORDER BY start) AS gap FROM (SELECT DISTINCT sample, chrom, start FROM coarse WHERE flag & 4 = 0 AND mapq >= 3) t) g "
    "ON r.sample = g.sample AND r.chrom = g.chrom AND r.start = g.start) x LEFT JOIN (SELECT DISTINCT bc FROM barcodes) w USING (bc)",
    "reads coarse barcodes",
)
def read_stats_table(spark, d):
    return _round(stats.read_table(_coarse(spark, d), V.barcodes(spark, d), P.ReadFilter(min_mapq=3)), "gc")


# ---- coverage ----

COVERAGE_SQL = f"cov AS (SELECT cluster, chrom, bin, sum(c)::DOUBLE AS value FROM (SELECT cell_id, chrom, bin, count(*) AS c FROM ({_bins_sql(500)}) GROUP BY ALL) JOIN groups g ON cell_id = g.sample || '::' || g.barcode GROUP BY cluster, chrom, bin)"
V.SQL["cov"] = COVERAGE_SQL


def _coverage(spark, d, binarize=False):
    c = counts.count_bins(P.read_filter(V.reads(spark, d), FILTER), 500, binarize=binarize)
    return coverage.group_coverage(c, V.groups(spark, d))


@query("SELECT * FROM cov", "reads groups cov")
def group_coverage_none(spark, d):
    return _coverage(spark, d)


@query("SELECT cluster, chrom, bin, round(value * 1e6 / sum(CASE WHEN chrom <> 'chrR' THEN value END) OVER (PARTITION BY cluster), 4) AS value FROM cov", "reads groups cov")
def group_coverage_cpm(spark, d):
    return _round(coverage.cpm(_coverage(spark, d), ignore=("chrR",)), "value", digits=4)


@query("SELECT cluster, chrom, bin, round(value * 2.5 / n, 6) AS value FROM cov JOIN (SELECT cluster, count(*) AS n FROM groups GROUP BY cluster) USING (cluster)", "reads groups cov")
def group_coverage_mean(spark, d):
    return _round(coverage.scaled(coverage.mean(_coverage(spark, d), V.groups(spark, d)), 2.5), "value")


@query(
    f"SELECT g.cluster, chrom, bin, round(count(*) / any_value(n), 6) AS value FROM (SELECT DISTINCT cell_id, chrom, bin FROM ({_bins_sql(500)})) JOIN groups g ON cell_id = g.sample || '::' || g.barcode "
    "JOIN (SELECT cluster, count(*) AS n FROM groups GROUP BY cluster) s ON s.cluster = g.cluster GROUP BY g.cluster, chrom, bin",
    "reads groups",
)
def group_coverage_frequency(spark, d):
    return _round(coverage.mean(_coverage(spark, d, binarize=True), V.groups(spark, d)), "value")


RUNS_SQL = (
    "SELECT cluster, chrom, min(s) AS start, max(e) AS \"end\", any_value(value) AS value FROM (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM s AND value = pv THEN 0 ELSE 1 END) OVER (PARTITION BY cluster, chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS run "
    "FROM (SELECT cluster, chrom, bin * 500 AS s, bin * 500 + 500 AS e, value, lag(bin * 500 + 500) OVER w AS p, lag(value) OVER w AS pv FROM cov WINDOW w AS (PARTITION BY cluster, chrom ORDER BY bin))) GROUP BY cluster, chrom, run"
)


def _runs(spark, d):
    c = coverage.without_zero_bins(_coverage(spark, d)).withColumn("start", F.col("bin") * 500).withColumn("end", F.col("bin") * 500 + 500)
    return intervals.run_length(c, ["cluster", "chrom"])


@query(RUNS_SQL, "reads groups cov")
def bedgraph_rle(spark, d):
    return _runs(spark, d)


@query(f"SELECT cluster, chrom, start, \"end\", round(value * 1e6 / sum(value) OVER (PARTITION BY cluster), 4) AS value FROM ({RUNS_SQL})", "reads groups cov")
def group_coverage_cpm_runs(spark, d):
    c = _coverage(spark, d).withColumn("start", F.col("bin") * 500).withColumn("end", F.col("bin") * 500 + 500)
    return _round(coverage.cpm_of_runs(c), "value", digits=4)


@query("SELECT cluster, chrom, bin, round(sum(value) OVER (PARTITION BY cluster, chrom ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS value FROM cov", "reads groups cov")
def smoothed(spark, d):
    return _round(coverage.smoothed(_coverage(spark, d), 4), "value")


@query("SELECT sample, barcode, cluster FROM (SELECT * FROM (SELECT DISTINCT sample FROM reads), (SELECT DISTINCT barcode FROM groups)) LEFT JOIN groups USING (sample, barcode)", "reads groups")
def cells_with_groups(spark, d):
    return coverage.cells_with_groups(V.reads(spark, d), V.groups(spark, d))


@query("SELECT sample, 'groups' AS missing_in FROM (SELECT sample FROM reads EXCEPT SELECT sample FROM groups WHERE sample <> 'F') UNION ALL SELECT 'X', 'reads'", "reads groups")
def label_diff(spark, d):
    g = V.groups(spark, d).filter("sample <> 'F'").unionByName(spark.createDataFrame([("X", "BC1", "c0")], "sample string, barcode string, cluster string"))
    return coverage.sample_differences(V.reads(spark, d), g)


# ---- count quality ----

@query(
    "SELECT cell_id, round(CASE WHEN max(n) > 1 THEN sum((2 * i - n - 1) * count) / (max(n) * sum(count)) END, 6) AS gini FROM "
    "(SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY count) AS i, count(*) OVER (PARTITION BY cell_id) AS n FROM counts) GROUP BY cell_id",
    "counts",
)
def gini(spark, d):
    return _round(qc.gini(V.counts(spark, d)), "gini")


TOP_SQL = ", ".join(f"round(100 * sum(CASE WHEN r <= {k} THEN count ELSE 0 END) / sum(count), 6) AS pct_counts_in_top_{k}_genes" for k in (5, 50))


@query(
    f"SELECT cell_id, count(*) AS n_genes_by_counts, sum(count) AS total_counts, {TOP_SQL}, round(ln(1 + count(*)), 6) AS log1p_n_genes_by_counts, round(ln(1 + sum(count)), 6) AS log1p_total_counts "
    "FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY count DESC, feature_id) AS r FROM counts) GROUP BY cell_id",
    "counts",
)
def qc_cells(spark, d):
    x = qc.cell_metrics(V.counts(spark, d), (5, 50))
    return _round(x, "pct_counts_in_top_5_genes", "pct_counts_in_top_50_genes", "log1p_n_genes_by_counts", "log1p_total_counts")


FEATURE_SQL = (
    "SELECT feature_id, count(*) AS n_cells_by_counts, sum(count) AS total_counts, round(sum(count) / n, 6) AS mean_counts, round(100 * (1 - count(*) / n), 6) AS pct_dropout_by_counts, "
    "round(ln(1 + sum(count) / n), 6) AS log1p_mean_counts, round(ln(1 + sum(count)), 6) AS log1p_total_counts FROM counts, (SELECT count(DISTINCT cell_id) AS n FROM counts) GROUP BY feature_id, n"
)


@query(FEATURE_SQL, "counts")
def qc_features(spark, d):
    return _round(qc.feature_metrics(V.counts(spark, d)), "mean_counts", "pct_dropout_by_counts", "log1p_mean_counts", "log1p_total_counts")


@query(
    "SELECT metric, min, max FROM (SELECT 'n_cells_by_counts' AS metric, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max FROM (SELECT count(*) AS n FROM counts GROUP BY feature_id) "
    "UNION ALL SELECT 'total_counts', min(s), max(s) FROM (SELECT sum(count) AS s FROM counts GROUP BY feature_id))",
    "counts",
)
def describe(spark, d):
    return qc.describe(qc.feature_metrics(V.counts(spark, d)).select("feature_id", "n_cells_by_counts", "total_counts"))


@query("SELECT count(DISTINCT cell_id) AS cells, count(DISTINCT feature_id) AS features FROM counts", "counts")
def matrix_totals(spark, d):
    return qc.totals(V.counts(spark, d))


@query(
    "SELECT c.* FROM counts c WHERE feature_id IN (SELECT feature_id FROM counts GROUP BY feature_id HAVING count(*) BETWEEN 90 AND 130) AND cell_id IN (SELECT cell_id FROM counts GROUP BY cell_id HAVING sum(count) BETWEEN 250 AND 320 AND cell_id <> 'O::BC7')",
    "counts",
)
def qc_filter(spark, d):
    c = V.counts(spark, d)
    obs, var = qc.cell_metrics(c), qc.feature_metrics(c)
    return qc.filtered(c, obs, var, qc.parse_ranges("total_counts: 250, 320"), qc.parse_ranges("n_cells_by_counts: 90, 130"), bad_cells=("O::BC7",))


@query(
    "SELECT c.cell_id, c.feature_id, 1.0::DOUBLE AS count FROM counts c WHERE cell_id IN (SELECT cell_id FROM counts GROUP BY 1 HAVING count(*) >= 200) AND feature_id IN (SELECT feature_id FROM counts GROUP BY 1 HAVING count(*) >= 100)", "counts"
)
def preprocess(spark, d):
    return qc.preprocessed(V.counts(spark, d), 200, 100)


@query(
    "SELECT cell_id, round(exp(-quantile_cont(ln(count) - g, 0.5)), 6) AS size_factor FROM x JOIN (SELECT feature_id, avg(ln(count)) AS g FROM x GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT cell_id) FROM x)) USING (feature_id) GROUP BY cell_id",
    "counts grouped",
)
def size_factors(spark, d):
    return _round(counts.size_factors(_grouped(spark, d)), "size_factor")



def _grouped(spark, d):
    return V.counts(spark, d).groupBy(F.substring("cell_id", 1, 6).alias("cell_id"), "feature_id").agg(F.sum("count").alias("count"))


@query("SELECT * FROM counts WHERE feature_id IN (SELECT feature_id FROM counts GROUP BY 1 HAVING sum(CASE WHEN count > 1 THEN count ELSE 0 END) <> 0)", "counts")
def remove_zero_rows(spark, d):
    c = V.counts(spark, d)
    zeroed = c.withColumn("shown", F.col("count")).withColumn("count", F.when(F.col("count") > 1, F.col("count")).otherwise(float("nan")))
    return counts.without_zero_rows(zeroed).select("cell_id", "feature_id", F.col("shown").alias("count"))


@query(
    "SELECT cell_id, feature_id, coalesce(count, 0) AS count FROM (SELECT * FROM (SELECT DISTINCT cell_id FROM counts), (SELECT DISTINCT feature_id FROM counts)) LEFT JOIN counts USING (cell_id, feature_id)", "counts"
)
def zero_fill(spark, d):
    c = V.counts(spark, d)
    return counts.zero_filled(c, c, c)


@query("SELECT feature_id, quantile_cont(count, 0.5) AS median FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", "counts")
def top_bins(spark, d):
    return counts.top_features(V.counts(spark, d), 25)


# ---- combining ----


def _halves(spark, d):
    c = V.counts(spark, d)
    n = F.substring("feature_id", 2, 9).cast("int")
    return {"a": c.filter(F.col("cell_id").startswith("O") & (n < 300)), "b": c.filter(F.col("cell_id").startswith("F") & (n >= 100))}


@query(
    "SELECT CASE WHEN cell_id LIKE 'O%' THEN 'a_' ELSE 'b_' END || cell_id AS cell_id, feature_id, count FROM counts WHERE feature_id IN "
    "(SELECT feature_id FROM counts WHERE cell_id LIKE 'O%' AND substring(feature_id, 2)::INT < 300 INTERSECT SELECT feature_id FROM counts WHERE cell_id LIKE 'F%' AND substring(feature_id, 2)::INT >= 100)",
    "counts",
)
def combine_samples(spark, d):
    return combine.stack(_halves(spark, d))


def _modalities(spark, d):
    c = V.counts(spark, d)
    n = F.substring("feature_id", 2, 9).cast("int")
    return combine.with_modality({"rna": c.filter(n % 2 == 0), "atac": c.filter(n % 2 == 1)})


@query("SELECT cell_id, array_to_string(list_sort(list_distinct(list(CASE WHEN substring(feature_id, 2)::INT % 2 = 0 THEN 'rna' ELSE 'atac' END))), ',') AS modalities FROM counts GROUP BY cell_id", "counts")
def combine_modalities(spark, d):
    return combine.modality_cells(_modalities(spark, d)).withColumn("modalities", F.array_join("modalities", ","))


@query("SELECT cell_id FROM counts WHERE substring(feature_id, 2)::INT % 2 = 0 INTERSECT SELECT cell_id FROM counts WHERE substring(feature_id, 2)::INT % 2 = 1", "counts")
def common_barcodes(spark, d):
    return combine.common_cells(_modalities(spark, d))


@query("SELECT bc FROM reads UNION SELECT bc FROM barcodes", "reads barcodes")
def all_barcodes(spark, d):
    return combine.all_barcodes(V.reads(spark, d), V.barcodes(spark, d))


@query("SELECT DISTINCT bc FROM reads", "reads")
def observed_barcodes(spark, d):
    return P.observed_barcodes(V.reads(spark, d))


@query("SELECT bc FROM barcodes WHERE substring(bc, 3)::INT % 2 = 0", "barcodes")
def selected_barcodes(spark, d):
    x = V.barcodes(spark, d).select(F.col("bc").alias("barcode"), (F.substring("bc", 3, 9).cast("int") % 2 == 0).alias("selected"))
    return P.selected_barcodes(x)


@query("SELECT query_name, len AS aligned FROM reads")
def read_lengths(spark, d):
    return V.reads(spark, d).select("query_name", P.read_length().alias("aligned"))


@query("SELECT cell_id, feature_id, CASE WHEN count = 1 THEN 'nan'::DOUBLE ELSE count - 1 END AS count FROM counts", "counts")
def zeros_to_nan(spark, d):
    return counts.zeros_to_nan(V.counts(spark, d).withColumn("count", F.col("count") - 1))


@query(
    "SELECT feature_id, r.chrom, r.start, r.\"end\" FROM (SELECT DISTINCT feature_id FROM counts) LEFT JOIN (SELECT 'f' || split_part(name, '.', 2) AS feature_id, chrom, start, \"end\" FROM regions) r USING (feature_id)", "counts regions"
)
def feature_positions(spark, d):
    known = V.regions(spark, d).select(F.concat(F.lit("f"), F.split("name", r"\.")[1]).alias("feature_id"), "chrom", "start", "end")
    return combine.with_positions(V.counts(spark, d).select("feature_id").distinct(), known)


@query("SELECT cell_id, cluster FROM (SELECT DISTINCT cell_id FROM counts) LEFT JOIN (SELECT sample || '::' || barcode AS cell_id, cluster FROM groups) USING (cell_id)", "counts groups")
def cell_metadata(spark, d):
    known = V.groups(spark, d).select(cell_id("sample", "barcode").alias("cell_id"), "cluster")
    return combine.with_metadata(V.counts(spark, d).select("cell_id").distinct(), known)


@query(
    "SELECT bc, max(CASE WHEN sample = 'F' THEN n END) AS \"F\", max(CASE WHEN sample = 'O' THEN n END) AS \"O\" FROM (SELECT bc, sample, count(*) AS n FROM reads GROUP BY 1, 2) GROUP BY bc"
)
def reads_by_sample(spark, d):
    return combine.wide(V.reads(spark, d).groupBy("bc", "sample").agg(F.count("*").alias("n")), "bc", "sample", "n")


@query("SELECT chrom, length FROM contigs WHERE chrom <> 'chrR'", "contigs")
def common_contigs(spark, d):
    c = V.contigs(spark, d)
    return combine.common_contigs(c, c.withColumn("length", F.when(F.col("chrom") == "chrR", 5).otherwise(F.col("length"))))


# ---- regions ----

GENES_SQL = (
    "SELECT b.chrom, b.start, b.\"end\", string_agg(g.name || g.strand, ',' ORDER BY g.name, g.strand) AS genes FROM (SELECT chrom, k * 1000 AS start, k * 1000 + 1000 AS \"end\" FROM contigs, range(0, 30) AS x(k)) b "
    "LEFT JOIN regions g ON g.chrom = b.chrom AND g.start < b.\"end\" AND g.\"end\" > b.start GROUP BY b.chrom, b.start, b.\"end\""
)


def _annotated(spark, d):
    bins = V.contigs(spark, d).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(1000).cast("long")))).withColumn("end", F.col("start") + 1000)
    return intervals.features_of_bins(bins, V.regions(spark, d))


@query(GENES_SQL, "contigs regions")
def feature_genes(spark, d):
    x = _annotated(spark, d)
    return x.withColumn("genes", F.when(F.col("genes").isNotNull(), F.array_join(F.transform("genes", lambda g: F.concat(g["gene"], g["strand"])), ",")))


@query(
    "SELECT b.chrom, b.start, b.\"end\", g.name AS gene, g.strand FROM (SELECT chrom, k * 1000 AS start, k * 1000 + 1000 AS \"end\" FROM contigs, range(0, 30) AS x(k)) b JOIN regions g ON g.chrom = b.chrom AND g.start < b.\"end\" AND g.\"end\" > b.start "
    "WHERE lower(g.name) = (SELECT lower(min(name)) FROM regions)",
    "contigs regions",
)
def gene_bins(spark, d):
    gene = V.regions(spark, d).agg(F.min("name")).first()[0]
    return intervals.bins_of_gene(_annotated(spark, d), gene.upper())


@query(
    "SELECT b.chrom, CASE WHEN g.strand = '-' THEN max(b.start) ELSE min(b.start) END AS start, CASE WHEN g.strand = '-' THEN max(b.start) ELSE min(b.start) END + 1000 AS \"end\", g.name AS gene, g.strand FROM "
    "(SELECT chrom, k * 1000 AS start, k * 1000 + 1000 AS \"end\" FROM contigs, range(0, 30) AS x(k)) b JOIN regions g ON g.chrom = b.chrom AND g.start < b.\"end\" AND g.\"end\" > b.start "
    "WHERE lower(g.name) = (SELECT lower(max(name)) FROM regions) GROUP BY b.chrom, g.name, g.strand",
    "contigs regions",
)
def gene_first_bin(spark, d):
    gene = V.regions(spark, d).agg(F.max("name")).first()[0]
    return intervals.bins_of_gene(_annotated(spark, d), gene.lower(), first=True)


# ---- signal ----


@query("SELECT bc, least(abs(tlen) * 100 // 1000, 99)::INT AS bin, count(*) AS n FROM reads WHERE abs(tlen) <= 1000 GROUP BY 1, 2")
def frag_hist(spark, d):
    return signal.length_histogram(V.reads(spark, d))


@query()
def fft_power(spark, d):
    return _round(signal.band_power(signal.spectrum(signal.length_histogram(V.reads(spark, d)))), "mono", "di", "period")


@query(
    """SELECT cell_id, jsd FROM (WITH x AS (SELECT cell_id, s::DOUBLE / 90 AS m, top FROM (SELECT cell_id, sum(c) AS s, max(c)::INT AS top FROM b GROUP BY cell_id)),
    hist AS (SELECT cell_id, k, sum(c) AS c FROM (SELECT cell_id, c::INT AS k, 1 AS c FROM b UNION ALL SELECT cell_id, 0, 90 - count(*) FROM b GROUP BY cell_id) GROUP BY 1, 2),
    grid AS (SELECT cell_id, m, unnest(range(0, top + 1)) AS k FROM x),
    q AS (SELECT cell_id, k, exp(k * ln(m) - m - lgamma(k + 1)) AS q, coalesce(hist.c, 0) / 90 AS p FROM grid LEFT JOIN hist USING (cell_id, k))
    SELECT cell_id, round(sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) + greatest(1 - sum(q), 0)) / 2, 0)), 6) AS jsd FROM q GROUP BY cell_id)""",
    "reads binned",
)
def jsd(spark, d):
    c = counts.count_bins(P.read_filter(V.reads(spark, d), FILTER), 1000)
    return _round(signal.jensen_shannon(c, 90, "count"), "jsd")


# ---- methylation ----

METHYL_SQL = "m AS (SELECT l_suppkey::VARCHAR AS cell, l_returnflag AS ctxt, CASE WHEN l_partkey % 9 <> 0 THEN 'b' || l_partkey % 50 END AS bin, sum(l_linenumber)::DOUBLE AS meth, sum(l_linenumber + l_quantity % 3)::DOUBLE AS depth FROM lineitem GROUP BY 1, 2, 3)"
V.SQL["methyl"] = METHYL_SQL


def _methyl(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    x = x.groupBy(F.col("l_suppkey").cast("string").alias("cell"), F.col("l_returnflag").alias("ctxt"), F.expr("CASE WHEN l_partkey % 9 <> 0 THEN concat('b', l_partkey % 50) END").alias("binID"))
    x = x.agg(F.sum("l_linenumber").cast("double").alias("meth"), F.sum(F.col("l_linenumber") + F.col("l_quantity") % 3).alias("unmeth"))
    return methylation.ratios(x, "R")


@query("SELECT cell, bin AS bin_id, depth, round(meth / depth, 6) AS ratio FROM m WHERE ctxt = 'R' AND bin IS NOT NULL", "methyl")
def methyl_ratio(spark, d):
    return _round(_methyl(spark, d), "ratio")


@query(
    "SELECT cell, bin_id, round(coalesce(r, avg(r) OVER (PARTITION BY bin_id)), 6) AS ratio FROM (SELECT c.cell, b.bin AS bin_id, m.meth / m.depth AS r FROM (SELECT DISTINCT cell FROM m WHERE ctxt = 'R' AND bin IS NOT NULL) c, "
    "(SELECT DISTINCT bin FROM m WHERE ctxt = 'R' AND bin IS NOT NULL) b LEFT JOIN m ON m.cell = c.cell AND m.bin = b.bin AND m.ctxt = 'R')",
    "methyl",
)
def methyl_impute(spark, d):
    r = _methyl(spark, d)
    return _round(methylation.imputed(r, r), "ratio")


@query(
    "SELECT bin AS bin_id, quantile_cont(depth, 0.5) AS median_depth, 100 - count(meth / depth) AS missing, round(stddev_pop(meth / depth), 6) AS std FROM m WHERE ctxt = 'R' AND bin IS NOT NULL GROUP BY bin", "methyl"
)
def methyl_bins(spark, d):
    return _round(methylation.bin_summary(_methyl(spark, d), 100), "std")
