"""Neighbour graphs and clusters of cells."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..storage import checkpointed

#: Queries and rows of one block, some 8 and 32 MB at 256 dimensions.
BLOCK_ROWS, ROW_BLOCK = 4_096, 16_384
#: Rows that lists are fitted on, at most, and rows that a list should hold.
SAMPLE_ROWS, LIST_ROWS = 20_000, 256


def _closest(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """src, dst, distance: for each of q (i, v) the k nearest of r (j, w) by another id, and
    all ties."""
    empty = pd.DataFrame({"src": q["i"].iloc[:0], "dst": r["j"].iloc[:0], "distance": np.zeros(0)})
    if not len(q) or not len(r):
        return empty
    names, own = q["i"].to_numpy(), r["j"].to_numpy()
    a, m = np.stack(q["v"].to_numpy()).astype(np.float64), np.stack(r["w"].to_numpy()).astype(np.float64)
    out = []
    step = max(1, 4_000_000 // len(own))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        d = np.maximum((part**2).sum(axis=1)[:, None] + (m**2).sum(axis=1) - 2 * part @ m.T, 0)
        keep = min(k + 1, len(own))
        near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        # Ties at the edge count too: all rows as near as the last one kept, but for rounding.
        edge = np.take_along_axis(d, near, axis=1).max(axis=1)
        src, dst = np.nonzero(d <= edge[:, None] * (1 + 1e-9) + 1e-12)
        exact = np.sqrt(((part[src] - m[dst]) ** 2).sum(axis=1))
        out.append(pd.DataFrame({"src": names[at : at + step][src], "dst": own[dst], "distance": exact}))
    found = pd.concat(out)
    return found[found["src"] != found["dst"]]


def _best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _pair(df: DataFrame, id: str, vector: str) -> DataFrame:
    return df.select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None, id: str = "cell_id", vector: str = "vector") -> DataFrame:  # M17, O7
    """src, dst, distance, rank: for each query (all rows by default) its k nearest other
    rows by Euclidean distance, exactly; ties by id.

    Blocks of queries meet blocks of rows through a shuffle, so neither the driver nor a task
    holds more than one of each; each pair of blocks keeps k candidates a query. Work is
    queries x rows: for the neighbours of all rows of a large table see nearest_by_lists.
    """
    rows = _pair(vectors, id, vector)
    asked = rows if queries is None else _pair(queries, id, vector)
    n_q, n_r = max(1, -(-asked.count() // BLOCK_ROWS)), max(1, -(-rows.count() // ROW_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("_q", block(n_q)).withColumn("_r", every(n_r))
    r = rows.select(F.col("i").alias("j"), F.col("v").alias("w"), block(n_r).alias("_r"), every(n_q).alias("_q"))
    kind = vectors.schema[id].dataType.simpleString()
    near = q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r")).applyInPandas(lambda a, b: _closest(a, b, k), f"src {kind}, dst {kind}, distance double")
    return _best(near, k)


def nearest_by_lists(vectors: DataFrame, k: int, id: str = "cell_id", vector: str = "vector", probes: int | None = None, seed: int = 42) -> DataFrame:  # M17
    """src, dst, distance, rank: about the k nearest other rows of every row.

    Centres of some rows / LIST_ROWS lists are fitted on SAMPLE_ROWS rows at most (all where
    there are fewer), chosen by hash; every row stands in the list of its nearest centre and
    asks the `probes` nearest lists (by default a fifth of them, 8 at least). Lists are split
    in blocks as `nearest` does, so a crowded list never meets in one task. Work is rows x
    probes x LIST_ROWS.
    """
    rows = checkpointed(_pair(vectors, id, vector).filter("i is not null and v is not null"))
    n = rows.count()
    kind = vectors.schema[id].dataType.simpleString()
    schema = f"src {kind}, dst {kind}, distance double"
    if not n:
        return _best(vectors.sparkSession.createDataFrame([], schema), k)
    share = int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    some = rows.filter(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) < share).orderBy("i").select("v").toPandas()
    centres = _centres(np.stack(some["v"].to_numpy()), max(1, min(n // LIST_ROWS, SAMPLE_ROWS // 40)), seed)
    probes = min(len(centres), probes or max(8, len(centres) // 5))
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    @pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        c, out = sent.value, []
        for at in range(0, len(v), 4096):
            m = np.stack(v.iloc[at : at + 4096].to_numpy())
            d = (c**2).sum(axis=1) - 2 * m @ c.T
            out += np.argsort(d, axis=1, kind="stable")[:, :probes].tolist()
        return pd.Series(out)

    placed = checkpointed(rows.withColumn("_lists", lists("v")))
    sizes = placed.groupBy(F.col("_lists")[0].alias("_list")).agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("n_r"))
    asked = placed.select(F.explode("_lists").alias("_list")).groupBy("_list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_q"))
    # A row for each list, some thousands at most.
    plan = F.broadcast(sizes.join(asked, "_list"))
    block = lambda c: F.pmod(F.xxhash64("i"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = placed.select("i", "v", F.explode("_lists").alias("_list")).join(plan, "_list").select("i", "v", "_list", block("n_q").alias("_q"), every("n_r").alias("_r"))
    r = placed.select("i", "v", F.col("_lists")[0].alias("_list")).join(plan, "_list").select(F.col("i").alias("j"), F.col("v").alias("w"), F.col("_list").alias("_list"), block("n_r").alias("_r"), every("n_q").alias("_q"))
    keys = ["_list", "_q", "_r"]
    return _best(q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(lambda a, b: _closest(a, b, k), schema), k)


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means on a sample that is in memory; a centre without rows stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([((centres**2).sum(axis=1) - 2 * x[at : at + 4096] @ centres.T).argmin(axis=1) for at in range(0, len(x), 4096)])
        many = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


def symmetric(neighbours: DataFrame) -> DataFrame:
    """src, dst, weight of an undirected graph, both directions: 1 / (1 + distance)."""
    e = neighbours.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (1 / (1 + F.col("distance"))).alias("w"))
    e = e.groupBy("a", "b").agg(F.max("w").alias("weight"))
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of an undirected graph given in both directions; labels: (node, label)."""
    x = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    per = x.groupBy("ls").agg(F.sum("weight").alias("deg"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0.0)).alias("inside"))
    r = per.agg(F.sum("deg").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("deg") * F.col("deg")).alias("d2")).first()
    return float(r["i"] / r["m2"] - resolution * r["d2"] / r["m2"] ** 2) if r["m2"] else 0.0


def clusters(layers: DataFrame | Mapping[str, tuple[DataFrame, float]], resolution: float = 1.0, rounds: int = 8, levels: int = 2) -> DataFrame:  # M18, M20
    """node, label by greedy modularity moves on one graph or the weighted layers of several.

    A round moves the nodes whose hash is of its parity to the neighbouring community of
    greatest gain w(node, c) - resolution * degree * degree(c) / 2m, summed over the layers,
    so that pairs do not swap for ever; ties go to the own label, then to the least. Between
    levels communities become nodes. The weighted sum of the layers' modularities is the
    modularity of the joint moves.

    Layers share one row for each pair: its weight is the sum over layers of weight * scale,
    and a node holds its degree in each layer as an array. A round then is one join of the
    edges with the labels, one sum, and two joins of what is left with nodes and communities.
    """
    given = [(layers, 1.0)] if isinstance(layers, DataFrame) else list(layers.values())
    totals = [float(e.agg(F.sum("weight")).first()[0] or 1.0) for e, _ in given]
    # Gains stay near the edges' own weights at any size of the graph, so rounding them is safe.
    scale = [weight * max(totals) / total for (_, weight), total in zip(given, totals)]
    parts = [
        e.select("src", "dst", (F.col("weight") * s).alias("w"), F.array(*[F.col("weight").cast("double") if i == j else F.lit(0.0) for j in range(len(given))]).alias("k"))
        for i, ((e, _), s) in enumerate(zip(given, scale))
    ]
    every = range(len(given))
    sums = F.array(*[F.sum(F.col("k")[i]) for i in every]).alias("k")
    united = parts[0]
    for x in parts[1:]:
        united = united.unionByName(x)
    edges = checkpointed(united.groupBy("src", "dst").agg(F.sum("w").alias("w"), sums))
    final = None
    for _ in range(levels):
        nodes = checkpointed(edges.groupBy(F.col("src").alias("node")).agg(sums).withColumn("mine", F.col("node")))
        between = edges.filter("src <> dst").select("src", "dst", "w")
        moved_any = False
        for turn in range(rounds):
            com = nodes.groupBy(F.col("mine").alias("label")).agg(sums).withColumnRenamed("k", "tot")
            near = between.join(nodes.select(F.col("node").alias("dst"), F.col("mine").alias("label")), "dst").select(F.col("src").alias("node"), "label", "w")
            x = near.unionByName(nodes.select("node", F.col("mine").alias("label"), F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
            x = x.join(com, "label").join(nodes, "node")
            stays = F.col("label") == F.col("mine")
            gain = F.col("w")
            for i in every:
                k = F.col("k")[i]
                gain = gain - F.lit(scale[i] * resolution / totals[i]) * k * (F.col("tot")[i] - F.when(stays, k).otherwise(0.0))
            best = x.groupBy("node").agg(F.min(F.struct(F.round(-gain, 9).alias("g"), (~stays).alias("leaves"), "label")).alias("best"), F.first("mine").alias("mine"), F.first("k").alias("k"))
            may = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
            new = checkpointed(best.select("node", "k", F.when(may, F.col("best.label")).otherwise(F.col("mine")).alias("mine"), (may & F.col("best.leaves")).alias("moved")))
            changed = new.filter("moved").count()
            moved_any |= changed > 0
            nodes = new.drop("moved")
            if not changed and turn % 2:
                break
        labels = nodes.select(F.col("node").alias("label"), F.col("mine").alias("_new"))
        final = nodes.select("node", F.col("mine").alias("label")) if final is None else checkpointed(final.join(labels, "label").select("node", F.col("_new").alias("label")))
        if not moved_any:
            break
        up = nodes.select(F.col("node").alias("src"), F.col("mine").alias("a"))
        over = nodes.select(F.col("node").alias("dst"), F.col("mine").alias("b"))
        edges = checkpointed(edges.join(up, "src").join(over, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"), sums))
    return final


def abstracted(edges: DataFrame, labels: DataFrame) -> DataFrame:  # M19
    """a, b, weight: edge weight between two clusters over what chance would put there."""
    x = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    between = x.groupBy("a", "b").agg(F.sum("weight").alias("w"))
    deg = x.groupBy("a").agg(F.sum("weight").alias("d"))
    m2 = F.sum("d").over(Window.partitionBy())
    deg = deg.withColumn("m2", m2)
    y = between.filter("a < b").join(deg, "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    return y.select("a", "b", (F.col("w") * F.col("m2") / (F.col("d") * F.col("db"))).alias("weight"))


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:  # A28
    """label and the mean of each coordinate of (node, x, y)."""
    return points.join(labels, "node").groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def cosine(a: DataFrame, b: DataFrame) -> DataFrame:  # M25
    """i, j, cosine of two small sets of components (id, vector)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    p = a.select(F.col("id").alias("i"), F.col("vector").alias("x")).crossJoin(F.broadcast(b.select(F.col("id").alias("j"), F.col("vector").alias("y"))))
    x, y = F.col("x"), F.col("y")
    return p.select("i", "j", (dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).alias("cosine"))
