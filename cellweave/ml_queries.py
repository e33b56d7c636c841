"""Registered queries of the reduction, graph and family operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import views as V
from .functions.families import FAMILIES
from .operators import graph, reduction, signal
from .queries import ORACLES, QUERIES, _round, query  # noqa: F401
from .streaming.windows import bin_counts


V.SQL["knn"] = (
    "near AS (SELECT src, dst, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM (SELECT q.vec_id AS src, e.vec_id AS dst, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance "
    "FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id)) WHERE rank <= 8), "
    "half AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(1 / (1 + distance)) AS weight FROM near GROUP BY 1, 2), "
    "edges AS (SELECT a AS src, b AS dst, weight FROM half UNION ALL SELECT b, a, weight FROM half)"
)
V.SQL["tops"] = "tops AS (SELECT t AS topic, r AS rank, 'f' || (t * 7 + r) AS f FROM range(0, 5) AS x(t), range(0, 4) AS y(r))"


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


@query("SELECT cell_id, feature_id, round(ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY cell_id)), 6) AS count FROM counts", "counts")
def normalize_log1p(spark, d):
    return _round(reduction.log1p(reduction.normalized(V.counts(spark, d))), "count")


@query(
    "SELECT cell_id, feature_id, round((1 + log2(count)) * log2(n / df) / (0.75 * pv + 0.25 * u), 6) AS weight FROM counts JOIN (SELECT feature_id, count(*) AS df FROM counts GROUP BY 1) USING (feature_id) "
    "JOIN (SELECT cell_id, count(*) AS u FROM counts GROUP BY 1) USING (cell_id), (SELECT count(DISTINCT cell_id) AS n, count(*) / count(DISTINCT cell_id) AS pv FROM counts)",
    "counts",
)
def tfidf(spark, d):
    return _round(reduction.tfidf(V.counts(spark, d)), "weight")


def _tops(spark, d):
    """Five topics of four features, as a stand-in for a model's top terms."""
    return spark.createDataFrame([(t, r, f"f{t * 7 + r}") for t in range(5) for r in range(4)], "topic int, rank int, feature_id string")


@query(
    "SELECT a.topic::INT AS topic, round(avg(ln(((SELECT count(*) FROM counts x JOIN counts y ON x.cell_id = y.cell_id WHERE x.feature_id = a.f AND y.feature_id = b.f) + 1.0) / (SELECT count(*) FROM counts x WHERE x.feature_id = b.f))), 6) AS u_mass "
    "FROM tops a JOIN tops b ON a.topic = b.topic AND a.rank > b.rank GROUP BY a.topic",
    "counts tops",
)
def coherence(spark, d):
    return _round(reduction.coherence(V.counts(spark, d), _tops(spark, d)), "u_mass")


@query(
    "SELECT src, dst, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM "
    "(SELECT q.vec_id AS src, e.vec_id AS dst, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 10",
    "",
)
def knn_topk(spark, d):
    e = _embeddings(spark, d)
    return _round(graph.nearest(e, 10, e.filter("cell_id % 50 = 0")).withColumn("rank", F.col("rank").cast("long")), "distance")


def _graph(spark, d):
    e = _embeddings(spark, d)
    return graph.symmetric(graph.nearest(e, 8)), e.select(F.col("cell_id").alias("node"), "label")


@query(
    "SELECT a, b, round(w * m2 / (da * db), 6) AS weight FROM (SELECT x.label AS a, y.label AS b, sum(weight) AS w FROM edges JOIN embeddings x ON src = x.vec_id JOIN embeddings y ON dst = y.vec_id GROUP BY 1, 2) "
    "JOIN (SELECT label AS a, sum(weight) AS da FROM edges JOIN embeddings ON src = vec_id GROUP BY 1) USING (a) JOIN (SELECT label AS b, sum(weight) AS db FROM edges JOIN embeddings ON src = vec_id GROUP BY 1) USING (b), "
    "(SELECT sum(weight) AS m2 FROM edges) WHERE a < b",
    "knn",
)
def paga_edges(spark, d):
    return _round(graph.abstracted(*_graph(spark, d)), "weight")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY label", "")
def cluster_centroids(spark, d):
    e = _embeddings(spark, d)
    points = e.select(F.col("cell_id").alias("node"), F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))
    return _round(graph.centroids(points, e.select(F.col("cell_id").alias("node"), "label")), "x", "y")


@query(
    "WITH m AS (SELECT label, list(v ORDER BY k) AS v FROM (SELECT label, k, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2) GROUP BY 1) "
    "SELECT a.label AS i, b.label AS j, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM m a, m b",
    "",
)
def component_cosine(spark, d):
    """Of the labels' mean vectors, as a stand-in for two sets of components."""
    x = _embeddings(spark, d).select("label", F.posexplode("vector").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    m = x.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("vector"))
    return _round(graph.cosine(m, m), "cosine")


@query()
def knn_lists(spark, d):
    """All rows' neighbours through inverted lists; recall is measured in the tests."""
    return _round(graph.nearest_by_lists(_embeddings(spark, d), 8), "distance")


def _family(name: str, sql: str, **params):
    """The family's log density of each line's quantity at a parameter made from its price."""
    family = FAMILIES[name](**params)

    def run(spark, d):
        @pandas_udf("double")
        def density(x, theta):
            import pandas as pd

            return pd.Series(family.log_density(x.to_numpy(), theta.to_numpy()))

        x = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(f"{X[name][0]} AS x", f"{X[name][1]} AS theta")
        return x.withColumn("log_density", F.round(density("x", "theta"), 5)).groupBy("x", "theta", "log_density").agg(F.count("*").alias("n"))

    run.__name__ = f"family_{name}"
    x_sql, t_sql = X_SQL[name]
    query(f"SELECT x, theta, round({sql}, 5) AS log_density, count(*) AS n FROM (SELECT {x_sql} AS x, {t_sql} AS theta FROM lineitem) GROUP BY ALL", "")(run)


X = {
    "gaussian": ("l_quantity", "cast(l_linenumber AS double)"), "poisson": ("l_quantity", "ln(l_linenumber * 7d)"), "bernoulli": ("cast(l_linenumber % 2 AS double)", "l_linenumber - 3.5d"),
    "log_normal": ("l_quantity", "l_linenumber / 2d"), "gamma": ("l_quantity", "cast(l_linenumber AS double)"), "beta": ("l_quantity / 51", "l_linenumber / 8d"),
    "sigmoid_beta": ("l_quantity / 51", "l_linenumber - 4d"),
}
X_SQL = {
    "gaussian": ("l_quantity", "l_linenumber::DOUBLE"), "poisson": ("l_quantity", "ln(l_linenumber * 7.0::DOUBLE)"), "bernoulli": ("(l_linenumber % 2)::DOUBLE", "l_linenumber - 3.5::DOUBLE"),
    "log_normal": ("l_quantity", "l_linenumber / 2.0::DOUBLE"), "gamma": ("l_quantity", "l_linenumber::DOUBLE"), "beta": ("l_quantity / 51", "l_linenumber / 8.0::DOUBLE"),
    "sigmoid_beta": ("l_quantity / 51", "l_linenumber - 4.0::DOUBLE"),
}
_family("gaussian", "-(x - theta) * (x - theta) / 2 - ln(2 * pi()) / 2")
_family("poisson", "x * theta - exp(theta) - lgamma(x + 1)")
_family("bernoulli", "x * theta - ln(1 + exp(theta))")
_family("log_normal", "-ln(x) - ln(2 * pi()) / 2 - ln(1.5) - (ln(x) - theta) * (ln(x) - theta) / (2 * 1.5 * 1.5)", nu=1.5)
_family("gamma", "(theta + 1) * ln(0.4) + theta * ln(x) - 0.4 * x - lgamma(theta + 1)", nu=0.4)
_B = "lgamma(3.0) - lgamma({m} * 3.0) - lgamma((1 - {m}) * 3.0) + ({m} * 3.0 - 1) * ln(x) + ((1 - {m}) * 3.0 - 1) * ln(1 - x)"
_family("beta", _B.format(m="theta"), nu=3.0)
_family("sigmoid_beta", _B.format(m="(1 / (1 + exp(-theta)))"), nu=3.0)


def _vectors(df):
    return df.withColumn("vector", F.transform("vector", lambda v: F.round(v, 4)))


@query()
def pca(spark, d):
    return _vectors(reduction.pca(reduction.log1p(reduction.normalized(V.counts(spark, d))), 5))


@query()
def lsa(spark, d):
    return _vectors(reduction.lsa(reduction.tfidf(V.counts(spark, d)), 6))


@query()
def lda(spark, d):
    return _vectors(reduction.cell_topics(reduction.lda(V.counts(spark, d), 4), 4))


@query()
def glmpca(spark, d):
    return _vectors(reduction.GLMPCA(3, "poisson").fit(V.counts(spark, d)).transform())


@query()
def clusters(spark, d):
    edges, _ = _graph(spark, d)
    return graph.clusters(edges)


@query()
def multiplex_clusters(spark, d):
    edges, _ = _graph(spark, d)
    far = edges.filter("src % 2 = dst % 2")
    return graph.clusters({"a": (edges, 0.7), "b": (far, 0.3)})


@query()
def fft_table(spark, d):
    return _round(signal.spectrum(signal.length_histogram(V.reads(spark, d))), "freq", "period", "power")


@query(
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2", ""
)
def events_windows(spark, d):
    x = bin_counts(spark.read.parquet(f"{d}/events.parquet"), "1 hour")
    return _round(x, "value", digits=4)
