"""Normalisation and dimension reduction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.families import FAMILIES
from ..storage import checkpointed


def normalized(counts: DataFrame, total: float = 1e4) -> DataFrame:  # M1
    """Each cell's counts scaled to the same sum."""
    return counts.withColumn("count", F.col("count") * total / F.sum("count").over(Window.partitionBy("cell_id")))


def log1p(counts: DataFrame) -> DataFrame:  # M2
    return counts.withColumn("count", F.log1p("count"))


def binarized(counts: DataFrame) -> DataFrame:  # M7
    return counts.filter("count > 0").withColumn("count", F.lit(1.0))


def tfidf(counts: DataFrame, slope: float = 0.25) -> DataFrame:  # M4
    """weight = (1 + log2 tf) * log2(N / df) / ((1 - slope) * pivot + slope * unique), where
    unique is the cell's number of features and pivot its mean over the cells."""
    x = counts.filter("count > 0")
    sizes = x.groupBy("cell_id").agg(F.count("*").alias("u"))
    df = x.groupBy("feature_id").agg(F.count("*").alias("df"))
    n = sizes.agg(F.count("*").alias("N"), F.avg("u").alias("pivot"))
    x = x.join(df, "feature_id").join(sizes, "cell_id").join(F.broadcast(n))
    weight = (1 + F.log2("count")) * F.log2(F.col("N") / F.col("df")) / ((1 - slope) * F.col("pivot") + slope * F.col("u"))
    return x.select("cell_id", "feature_id", weight.alias("weight"))


def feature_index(counts: DataFrame) -> DataFrame:
    """feature_id, idx from 0 by name. Features, not cells, are numbered in one place."""
    return counts.select("feature_id").distinct().withColumn("idx", (F.row_number().over(Window.orderBy("feature_id")) - 1).cast("int"))


def cell_rows(counts: DataFrame, value: str = "count") -> tuple[DataFrame, int]:
    """(cell_id, idx, val) with the arrays sorted by idx; and the number of features."""
    index = feature_index(counts)
    n = index.count()
    x = counts.join(index, "feature_id").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("x"))
    return x.select("cell_id", F.col("x.idx").alias("idx"), F.col("x.v").alias("val")), n


def cell_vectors(counts: DataFrame, value: str = "count") -> tuple[DataFrame, int]:
    """(cell_id, features): sparse vectors for MLlib."""
    rows, n = cell_rows(counts, value)

    @F.udf(VectorUDT())
    def sparse(idx, val):
        return Vectors.sparse(n, idx, val)

    return rows.select("cell_id", sparse("idx", "val").alias("features")), n


def _signs(v: np.ndarray) -> np.ndarray:
    """+1 or -1 for each column, so that its largest entry becomes positive."""
    return np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _project(rows: DataFrame, loadings: np.ndarray, centre: np.ndarray | None = None) -> DataFrame:
    """cell_id, vector: sparse rows times loadings, less the centre's image."""
    shift = np.zeros(loadings.shape[1]) if centre is None else centre @ loadings
    sent = rows.sparkSession.sparkContext.broadcast((loadings, shift))

    @pandas_udf("array<double>")
    def image(idx: pd.Series, val: pd.Series) -> pd.Series:
        v, s = sent.value
        return pd.Series([(np.asarray(x, float) @ v[np.asarray(i, int)] - s).tolist() for i, x in zip(idx, val, strict=True)])

    return rows.select("cell_id", image("idx", "val").alias("vector"))


def pca(counts: DataFrame, k: int) -> DataFrame:  # M3
    """cell_id, vector of k principal components. The covariance is gathered by RowMatrix
    (features x features); rows stay sparse and the mean is taken off the image."""
    rows, n = cell_rows(counts)
    vectors = rows.rdd.map(lambda r: OldVectors.sparse(n, r["idx"], r["val"]))
    m = RowMatrix(vectors)
    loadings = m.computePrincipalComponents(k).toArray()
    loadings = loadings * _signs(loadings)
    return _project(rows, loadings, np.asarray(m.computeColumnSummaryStatistics().mean()))


def lsa(weights: DataFrame, k: int, value: str = "weight", drop_first: bool = True) -> DataFrame:  # M5
    """cell_id, vector: rows times the right singular vectors, which is U times S; the
    first component, mostly depth, is dropped. Signs are fixed by the largest loading."""
    rows, n = cell_rows(weights, value)
    svd = RowMatrix(rows.rdd.map(lambda r: OldVectors.sparse(n, r["idx"], r["val"]))).computeSVD(k)
    v = svd.V.toArray()
    v = v * _signs(v)
    return _project(rows, v[:, 1:] if drop_first else v)


def lda(counts: DataFrame, topics: int, passes: int = 2, seed: int = 42) -> DataFrame:  # M6
    """cell_id, vector: topic shares by online LDA."""
    vectors, _ = cell_vectors(counts)
    model = LDA(k=topics, maxIter=max(passes * 10, 10), optimizer="online", seed=seed).fit(vectors)
    return model.transform(vectors).select("cell_id", vector_to_array("topicDistribution").alias("vector"))


def cell_topics(topics: DataFrame, k: int, least: float = 0.01, pop_sparse: bool = False) -> DataFrame:  # M8
    """Topic shares under `least` become 0; with pop_sparse, cells that then lack a topic go."""
    x = topics.withColumn("vector", F.transform("vector", lambda v: F.when(F.abs(v) >= least, v).otherwise(0.0)))
    return x.filter(F.size(F.filter("vector", lambda v: v != 0)) == k) if pop_sparse else x


def coherence(counts: DataFrame, tops: DataFrame, eps: float = 1.0) -> DataFrame:  # A29
    """topic, u_mass: mean over pairs of a topic's top terms (topic, rank, feature_id) of
    ln((cells with both + eps) / cells with the one of lower rank)."""
    x = counts.filter("count > 0").select("cell_id", "feature_id").distinct()
    own = x.groupBy("feature_id").agg(F.count("*").alias("d"))
    pairs = tops.alias("a").join(tops.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") > F.col("b.rank")))
    pairs = pairs.select(F.col("a.topic").alias("topic"), F.col("a.feature_id").alias("i"), F.col("b.feature_id").alias("j"))
    needed = pairs.select("i", "j").distinct()
    left = needed.join(x.withColumnRenamed("feature_id", "i"), "i")
    both = left.join(x.withColumnRenamed("feature_id", "j"), ["j", "cell_id"]).groupBy("i", "j").agg(F.count("*").alias("n"))
    y = pairs.join(both, ["i", "j"], "left").join(own.withColumnRenamed("feature_id", "j"), "j")
    return y.groupBy("topic").agg(F.avg(F.ln((F.coalesce("n", F.lit(0)) + eps) / F.col("d"))).alias("u_mass"))


class GLMPCA:  # M9-M14
    """Loadings V (features x k, orthonormal) and intercept b that minimise the negative
    log-likelihood of P = (theta - b) V V' + b, theta the saturated parameters.

    Rows never leave their partitions. An epoch sends V and b out, sums the gradients
    as rows (feature, values) by a combining aggregate, steps by Adagrad and returns to
    the orthonormal matrices by QR. On a loss that is not finite it starts anew with a
    smaller rate. Gradients: E = the family's at (X, P); dV = (theta - b)' E V + E' (theta - b) V;
    db = sum over rows of E - E V V'. It ends after max_iter epochs, or when PATIENCE epochs
    better the loss by less than tol of itself.

    Before, the family's parameters are fitted to each feature, and b starts at the link of
    the feature's mean, for counts of its median (zeros count in either). V starts at the
    leading directions of theta - b ("spectral", by subspace iteration) or at random; of
    n_init descents, all but the first at random, the best is kept. Rows are dense
    in a block of BLOCK cells only, as the link of 0 is not 0.
    """

    BLOCK, PATIENCE, PASSES = 256, 5, 4

    def __init__(
        self, n_pc: int, family: str = "gaussian", max_iter: int = 100, learning_rate: float = 0.2, step_size: int = 20, gamma: float = 0.5, n_init: int = 1, seed: int = 42,
        init: str = "spectral", method: str = "mle", tol: float = 1e-4,
    ):
        self.n_pc, self.family, self.max_iter = n_pc, FAMILIES[family](), max_iter
        self.rate, self.step_size, self.gamma, self.n_init, self.seed = learning_rate, step_size, gamma, n_init, seed
        self.init, self.method, self.tol = init, method, tol
        self.losses: list[float] = []

    def _sums(self, rows: DataFrame, n: int, columns: int, add) -> np.ndarray:
        """Sum over blocks x (cells x n, dense) of add(x), n + 1 rows of `columns` values."""

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((n + 1, columns))
            for f in frames:
                for at in range(0, len(f), GLMPCA.BLOCK):
                    part = f.iloc[at : at + GLMPCA.BLOCK]
                    x = np.zeros((len(part), n))
                    for r, (i, val) in enumerate(zip(part["idx"], part["val"], strict=True)):
                        x[r, np.asarray(i, int)] = val
                    total += add(x)
            yield pd.DataFrame({"j": np.arange(n + 1), "g": total.tolist()})

        parts = rows.mapInPandas(each, "j int, g array<double>")
        sums = parts.groupBy("j").agg(F.array(*[F.sum(F.col("g")[c]) for c in range(columns)]).alias("g")).toPandas().sort_values("j")
        return np.array(sums["g"].tolist())

    def _epoch(self, rows: DataFrame, n: int, v: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        family, k = self.family, self.n_pc
        sent = rows.sparkSession.sparkContext.broadcast((v, b))

        def add(x: np.ndarray) -> np.ndarray:
            v, b = sent.value
            t = family.inverse_link(x) - b
            p = t @ v @ v.T + b
            e = family.gradient(x, p)
            own = np.column_stack((t.T @ (e @ v) + e.T @ (t @ v), (e - e @ v @ v.T).sum(axis=0)))
            return np.vstack((own, np.full(k + 1, family.loss(x, p))))

        g = self._sums(rows, n, k + 1, add)
        return float(g[n, 0]), g[:n, :k], g[:n, k]

    def _spectral(self, rows: DataFrame, n: int, b: np.ndarray, rng) -> np.ndarray:  # M10
        """The leading right singular vectors of theta - b."""
        family, width = self.family, min(n, self.n_pc + 8)
        q = np.linalg.qr(rng.normal(size=(n, width)))[0]
        for _ in range(self.PASSES):
            sent = rows.sparkSession.sparkContext.broadcast(q)

            def add(x: np.ndarray, sent=sent) -> np.ndarray:
                t = family.inverse_link(x) - b
                return np.vstack((t.T @ (t @ sent.value), np.zeros(width)))

            y = self._sums(rows, n, width, add)[:n]
            values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            last = q @ turn[:, ::-1]
            q = np.linalg.qr(y)[0]
        return np.linalg.qr(last[:, : self.n_pc])[0]

    def _start(self, rows: DataFrame, n: int, cells: int) -> np.ndarray:  # M11
        """Fits the family; the first intercept."""
        family = self.family

        def add(x: np.ndarray) -> np.ndarray:
            own = np.column_stack((x.sum(axis=0), (x**2).sum(axis=0), *[t.sum(axis=0) for t in family.statistics(x)]))
            return np.vstack((own, np.zeros(own.shape[1])))

        columns = 2 + len(family.statistics(np.zeros((1, 1))))
        means = self._sums(rows, n, columns, add)[:n] / max(cells, 1)
        family.fit_means(means[:, 0], means[:, 1], list(means.T[2:]), self.method)
        middle = means[:, 0]
        if family.name == "poisson":
            x = rows.select(F.explode(F.arrays_zip("idx", "val")).alias("x")).select("x.idx", F.col("x.val").cast("double").alias("val"), F.lit(1).cast("long").alias("n"))
            zeros = x.groupBy("idx").agg(F.lit(0.0).alias("val"), (cells - F.count("*")).alias("n")).filter("n > 0")
            medians = x.unionByName(zeros).groupBy("idx").agg(F.percentile("val", F.lit(0.5), F.col("n")).alias("m")).toPandas()
            middle = np.zeros(n)
            middle[medians["idx"]] = medians["m"]
        return family.inverse_link(np.clip(middle, 1e-3, 1 - 1e-3) if family.name == "bernoulli" else middle)

    def fit(self, counts: DataFrame) -> GLMPCA:
        rows, n = cell_rows(counts)
        rows = checkpointed(rows)
        cells = rows.count()
        b0 = self._start(rows, n, cells)
        best = None
        for init in range(self.n_init):
            rng = np.random.default_rng(self.seed + init)
            v0 = self._spectral(rows, n, b0, rng) if self.init == "spectral" and not init else np.linalg.qr(rng.normal(size=(n, self.n_pc)))[0]
            rate, found = self.rate, None
            while rate > 1e-10 and not found:
                found = self._descend(rows, n, cells, b0.copy(), v0, rate)
                rate *= self.gamma
            if found and (best is None or found[0][-1] < best[0][-1]):
                best = found
        if best is None:
            raise ValueError("the loss is not finite at any learning rate")
        self.losses, self.loadings, self.intercept, self._rows = *best, rows
        return self

    def _descend(self, rows, n, cells, b, v, rate):
        hv, hb, losses = np.zeros((n, self.n_pc)), np.zeros(n), []
        kept = (np.inf, v, b)
        for it in range(self.max_iter):
            loss, dv, db = self._epoch(rows, n, v, b)
            if not np.isfinite(loss) or not np.isfinite(dv).all():
                return None
            losses.append(min(loss, kept[0]))
            if it >= self.PATIENCE and losses[-1 - self.PATIENCE] - losses[-1] <= self.tol * abs(losses[-1]):
                break
            if loss < kept[0]:
                kept = (loss, v, b)
            dv = dv - v @ (v.T @ dv + dv.T @ v) / 2  # along the orthonormal matrices
            hv, hb = hv + dv**2, hb + db**2
            step = rate * self.gamma ** (it // self.step_size)
            v = np.linalg.qr(v - step * dv / np.sqrt(hv + 1e-12))[0]
            b = b - 0.01 * step * db / np.sqrt(hb + 1e-12)
        return losses, kept[1] * _signs(kept[1]), kept[2]

    def transform(self) -> DataFrame:  # M14
        """cell_id, vector: (theta - b) V of the rows it was fitted on."""
        family, v, b = self.family, self.loadings, self.intercept
        n = len(b)

        @pandas_udf("array<double>")
        def image(idx: pd.Series, val: pd.Series) -> pd.Series:
            out = []
            for i, x in zip(idx, val, strict=True):
                row = np.zeros(n)
                row[np.asarray(i, int)] = x
                out.append(((family.inverse_link(row) - b) @ v).tolist())
            return pd.Series(out)

        return self._rows.select("cell_id", image("idx", "val").alias("vector"))
