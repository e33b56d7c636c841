"""Distribution measures of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jensen_shannon(coverage: DataFrame, bins: int, value: str = "bases") -> DataFrame:  # A23
    """cell_id, jsd: distance (base 2) between a cell's distribution of bin coverages and
    that of a synthetic cell whose coverages are Poisson with the same mean.

    Zero bins enter by their number, bins - rows. The Poisson probabilities follow
    from the mean by p(k) = exp(-m + k ln m - ln k!), ln k! as a running sum over the
    distinct coverages up to the cell's largest.
    """
    x = coverage.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.max(value).cast("int").alias("top"))
    m = (F.col("s") / F.lit(float(bins))).alias("m")
    seen = coverage.groupBy("cell_id", F.col(value).cast("int").alias("k")).agg(F.count("*").alias("c"))
    zero = x.select("cell_id", F.lit(0).alias("k"), (F.lit(bins) - F.col("n")).alias("c"))
    hist = seen.unionByName(zero).groupBy("cell_id", "k").agg(F.sum("c").alias("c"))
    grid = x.select("cell_id", m, F.explode(F.sequence(F.lit(0), "top")).alias("k"))
    w = Window.partitionBy("cell_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("lf", F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(w))
    grid = grid.withColumn("q", F.exp(F.col("k") * F.ln("m") - F.col("m") - F.col("lf")))
    both = grid.join(hist, ["cell_id", "k"], "left").withColumn("p", F.coalesce("c", F.lit(0)) / F.lit(float(bins)))
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
    # The Poisson tail above the largest coverage meets p = 0: q * log2(q / (q / 2)) = q.
    out = both.groupBy("cell_id").agg(F.sum(part("p")).alias("a"), F.sum(part("q")).alias("b"), (1 - F.sum("q")).alias("tail"))
    return out.select("cell_id", F.sqrt(F.greatest((F.col("a") + F.col("b") + F.greatest("tail", F.lit(0.0))) / 2, F.lit(0.0))).alias("jsd"))


def length_histogram(reads: DataFrame, top: int = 1000, bins: int = 100) -> DataFrame:  # A25
    """bc, bin (0 .. bins - 1), n: fragment lengths in 0 .. top; the last bin holds top."""
    x = reads.select("bc", F.abs("tlen").alias("len")).filter(F.col("len").between(0, top) & F.col("bc").isNotNull())
    return x.groupBy("bc", F.least(F.floor(F.col("len") * bins / top), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def spectrum(histogram: DataFrame, first: int = 10, last: int = 100, step: int = 10) -> DataFrame:  # M22, W7, O2
    """bc, freq, period, power: squared Fourier magnitudes of the first differences of
    log2(n + 1) over bins first .. last, positive frequencies, highest first."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(last)
        inside = pdf["bin"] < last
        h[pdf.loc[inside, "bin"]] = pdf.loc[inside, "n"]
        d = np.diff(np.log2(h[first:] + 1))
        power = np.abs(np.fft.fft(d)) ** 2
        freq = np.fft.fftfreq(len(d), step)
        k = freq > 0
        out = pd.DataFrame({"bc": pdf["bc"].iloc[0], "freq": freq[k], "period": 1 / freq[k], "power": power[k]})
        return out.sort_values("freq", ascending=False)

    return histogram.groupBy("bc").applyInPandas(each, "bc string, freq double, period double, power double")


def band_power(spectra: DataFrame) -> DataFrame:  # A26, O4
    """bc, mono (mean power at periods 120 .. 159), di (240 .. 319), period of most power."""
    p = F.floor("period")
    mean = lambda a, z: F.avg(F.when((p >= a) & (p < z), F.col("power")))
    return spectra.groupBy("bc").agg(mean(120, 160).alias("mono"), mean(240, 320).alias("di"), F.max_by("period", "power").alias("period"))


