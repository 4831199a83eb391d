"""Reliability and multivariate diagnostics: moments in Spark, p x p algebra on their result."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.index import average_ranks, melted, number, quantiles


def variance_components(df: DataFrame, dims: list[str], group: str, value: str) -> DataFrame:
    """One-way random effects per dimension: mean squares between and within groups, n0, between variance (floor
    1e-12), k = within / between, ICC, median group size. Groups are reduced to count, mean and variance first."""
    x = number(value)
    g = df.where(x.isNotNull()).groupBy(*dims, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("v"))
    s = g.groupBy(*dims).agg(
        F.count("*").alias("groups"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("n") * F.col("m")).alias("S"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("Q"),
        F.sum(F.col("n") * F.col("v")).alias("SSW"),
    )
    med = quantiles(g.select(F.struct(*dims).alias("key"), F.col("n").cast("double").alias("value")), {"median_n": 0.5}).select("key.*", "median_n")
    s = s.join(med, dims)
    ssb = F.col("Q") - F.col("S") * F.col("S") / F.col("N")
    msb, msw = F.try_divide(ssb, F.col("groups") - 1), F.try_divide(F.col("SSW"), F.col("N") - F.col("groups"))
    n0 = F.try_divide(F.col("N") - F.col("N2") / F.col("N"), F.col("groups") - 1)
    r = s.select(*dims, "groups", F.col("N").alias("n"), msb.alias("msb"), msw.alias("msw"), n0.alias("n0"), "median_n")
    r = r.withColumn("tau2", F.greatest((F.col("msb") - F.col("msw")) / F.col("n0"), F.lit(1e-12)))
    return r.withColumn("k", F.col("msw") / F.col("tau2")).withColumn("icc", F.col("tau2") / (F.col("tau2") + F.col("msw")))


def correlations(df: DataFrame, cols: list[str], least: int = 30) -> DataFrame:
    """``(a, b, r, n)`` for every pair a < b: Pearson over the rows that have both, null under ``least`` rows."""
    both = lambda a, b: number(a).isNotNull() & number(b).isNotNull()
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(number(a), number(b)).alias("r"), F.count(F.when(both(a, b), 1)).alias("n")).alias(f"_{i}") for i, (a, b) in enumerate(combinations(cols, 2))]
    if not parts:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    r = df.agg(*parts).select(F.explode(F.array(*(f"_{i}" for i in range(len(parts))))).alias("r")).select("r.*")
    return r.withColumn("r", F.when((F.col("n") >= least) & ~F.isnan("r"), F.col("r")))


def collinear(corr: DataFrame, threshold: float = 0.9) -> DataFrame:
    return corr.where(F.abs("r") > threshold)


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (n - 1) and number of complete rows, from one aggregate."""
    p = len(cols)
    full = df.select(*(number(c).alias(f"x{i}") for i, c in enumerate(cols))).dropna()
    mid = full.agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p))).first()
    if not mid["n"]:
        return np.full(p, np.nan), np.full((p, p), np.nan), 0
    m = np.array([mid[f"m{i}"] for i in range(p)])

    def products(it):
        total = np.zeros((p, p))
        for b in it:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)], 1) - m if len(b) else np.zeros((0, p))
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(p * p), "v": total.ravel()})

    # every partition sends one matrix
    got = full.mapInArrow(products, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return m, np.array([r["v"] for r in got]).reshape(p, p) / max(mid["n"] - 1, 1), mid["n"]


def _correlation(c: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def cronbach_alpha(df: DataFrame, cols: list[str], standardized: bool = True) -> float | None:
    """Internal consistency over complete rows; null under two columns or two rows."""
    k = len(cols)
    if k < 2:
        return None
    _, c, n = covariance(df, cols)
    if n < 2:
        return None
    if standardized:
        r = _correlation(c)[np.triu_indices(k, 1)].mean()
        return float(k * r / (1 + (k - 1) * r))
    return float(k / (k - 1) * (1 - np.trace(c) / c.sum()))


def alpha_if_deleted(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: cronbach_alpha(df, [x for x in cols if x != c]) for c in cols}


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 2000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def kmo_bartlett(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Bartlett's sphericity (chi-square, degrees, p) and the KMO measure over complete rows."""
    _, c, n = covariance(df, cols)
    r, p = _correlation(c), len(cols)
    chi = -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(r)[1]
    deg = p * (p - 1) / 2
    inv = np.linalg.inv(r)
    part = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(p, dtype=bool)
    r2, q2 = (r[off] ** 2).sum(), (part[off] ** 2).sum()
    return {"n": n, "chi2": float(chi), "dof": deg, "p": upper_gamma(deg / 2, float(chi) / 2), "kmo": float(r2 / (r2 + q2))}


def pca(df: DataFrame, cols: list[str], top: int = 3) -> pd.DataFrame:
    """Principal components of the standardised complete rows: eigenvalue (of R n / (n - 1)), share, cumulated share
    and loadings of the largest components; a component's largest loading is positive."""
    _, c, n = covariance(df, cols)
    val, vec = np.linalg.eigh(_correlation(c))
    val, vec = val[::-1], vec[:, ::-1]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(len(cols))])
    rows = [{"component": i + 1, "eigenvalue": v * n / (n - 1), "share": v / val.sum(), "cumulative": val[: i + 1].sum() / val.sum(), "n": n} | {f"load_{x}": vec[j, i] for j, x in enumerate(cols) if i < top} for i, v in enumerate(val)]
    return pd.DataFrame(rows)


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function I(dof / (dof + t²); dof / 2, 1 / 2)."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
        h = d
        for i in range(1, 500):
            for num in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if 0 < x else 0.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman correlation over the rows that have both, its p by Student's t, and their number; null under
    three."""
    j = df.select(number(a).alias("x"), number(b).alias("y")).dropna()
    rx, ry = (average_ranks(j, c).select(F.col("value").alias(f"_{c}"), F.col("rank").alias(f"r{c}")) for c in "xy")
    r = j.join(rx, F.col("x") == F.col("_x")).join(ry, F.col("y") == F.col("_y")).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n")).first()
    rho, n = (r["rho"], r["n"]) if r["n"] >= 3 and r["rho"] is not None and not math.isnan(r["rho"]) else (None, r["n"])
    p = None if rho is None else 0.0 if abs(rho) >= 1 else t_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    return df.sparkSession.createDataFrame([(rho, p, n)], "rho double, p double, n long")


def kendall(df: DataFrame, a: str, b: str, block: int = 2000) -> DataFrame:
    """One row: Kendall's tau-b, z-based p and n. Rows go to blocks of bounded size by a hash; every pair of blocks
    is one task of bounded size, so all pairs are compared without a cross join of rows. Quadratic by definition:
    meant for the firm matrix."""
    j = df.select(number(a).alias("x"), number(b).alias("y")).dropna()
    n = j.count()
    if n < 3:
        return df.sparkSession.createDataFrame([(None, None, n)], "tau double, p double, n long")
    m = -(-n // block)
    rows = j.withColumn("_b", (F.xxhash64("x", "y", F.monotonically_increasing_id()) % m + m) % m)
    both = rows.select("x", "y", "_b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_o")).select("x", "y", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") <= F.col("_o")).alias("first"), (F.col("_b") == F.col("_o")).alias("own"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.own.iloc[0]:
            x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
            s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
            return pd.DataFrame({"s": [float(np.triu(s, 1).sum())]})
        p, q = pdf[pdf["first"]], pdf[~pdf["first"]]
        s = np.sign(p.x.to_numpy()[:, None] - q.x.to_numpy()) * np.sign(p.y.to_numpy()[:, None] - q.y.to_numpy())
        return pd.DataFrame({"s": [float(s.sum())]})

    s = both.groupBy("i", "j").applyInPandas(count, "s double").agg(F.sum("s")).first()[0]
    ties = [j.groupBy(c).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0))).first()[0] for c in "xy"]
    pairs = n * (n - 1) / 2
    den = math.sqrt((pairs - ties[0]) * (pairs - ties[1]))
    tau = s / den if den else None
    z = 3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5)) if tau is not None else None
    return df.sparkSession.createDataFrame([(tau, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, n)], "tau double, p double, n long")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, exact; a column without values has a count of 0."""
    long = melted(df, cols)
    r = long.groupBy("key").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    every = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in cols], "key string"))
    j = every.join(r, "key", "left").join(quantiles(long, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "key", "left")
    return j.select(F.col("key").alias("column"), F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def classification(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 of two 0/1 columns; a ratio without cases is 0."""
    n = lambda p, g: F.sum(((F.col(predicted) == p) & (F.col(gold) == g)).cast("int")).alias
    c = df.where(F.col(predicted).isNotNull() & F.col(gold).isNotNull()).agg(n(1, 1)("tp"), n(1, 0)("fp"), n(0, 1)("fn"), n(0, 0)("tn")).na.fill(0)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def kmeans_scan(df: DataFrame, key: str, cols: list[str], ks: range = range(2, 11), seed: int = 42, starts: int = 10) -> list[dict]:
    """k-means of the standardised complete rows for each k, the best of ``starts`` seeds, with Euclidean silhouette
    and cluster sizes. The silhouette compares all pairs by definition."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    m, c, n = covariance(df, cols)
    sd = np.sqrt(np.diag(c) * (n - 1) / max(n, 1))
    z = df.select(key, *(((number(x) - float(m[i])) / float(sd[i] or 1)).alias(x) for i, x in enumerate(cols))).dropna()
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(z).persist()
    out = []
    for k in ks:
        if k >= n:
            break
        best = min((KMeans(k=k, seed=seed + s, maxIter=100).fit(data) for s in range(starts)), key=lambda f: f.summary.trainingCost)
        lab = best.transform(data).select(key, *cols, F.col("prediction").alias("cluster"))
        sizes = [r["count"] for r in lab.groupBy("cluster").count().collect()]  # k rows
        out.append({"k": k, "silhouette": silhouette(lab, key, cols), "sizes": sorted(sizes, reverse=True), "labels": lab})
    data.unpersist()
    return out


def silhouette(labels: DataFrame, key: str, cols: list[str], block: int = 2000) -> float | None:
    """Mean Euclidean silhouette of (key, cols, cluster). Distances are summed per row and cluster by pairs of blocks
    of bounded size, each one task; a cluster of one row counts 0."""
    n = labels.count()
    m = max(1, -(-n // block))
    rows = labels.select(F.col(key).alias("key"), F.array(*cols).alias("x"), "cluster").withColumn("_b", (F.xxhash64("key") % m + m) % m)
    left = rows.select("key", "x", F.col("cluster").alias("own"), F.lit(True).alias("left"), F.col("_b").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    right = rows.select("key", "x", F.col("cluster").alias("own"), F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), F.col("_b").alias("j"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "own": [], "other": [], "d": []})
        d = np.sqrt(((np.stack(a.x)[:, None] - np.stack(b.x)) ** 2).sum(-1))
        return pd.concat([pd.DataFrame({"key": a.key.to_numpy(), "own": a.own.to_numpy(), "other": c, "d": d[:, (b.own == c).to_numpy()].sum(1)}) for c in b.own.unique()])

    kind = labels.schema[key].dataType.simpleString()
    per = left.unionByName(right).groupBy("i", "j").applyInPandas(sums, f"key {kind}, own int, other int, d double").groupBy("key", "own", "other").agg(F.sum("d").alias("d"))
    size = labels.groupBy(F.col("cluster").alias("other")).agg(F.count("*").alias("n"))
    j = per.join(F.broadcast(size), "other")  # one row per cluster
    a = F.max(F.when(F.col("own") == F.col("other"), F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1))))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("d") / F.col("n")))
    s = j.groupBy("key").agg(a.alias("a"), b.alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))).first()[0]


def cluster_profiles(labels: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of every column per cluster, their level and the cluster's size, highest level first."""
    p = labels.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in cols), F.count("*").alias("n"))
    return p.withColumn("level", sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).orderBy(F.desc("level"))


def name_cluster(profile: dict[str, float], centre: dict[str, float]) -> str:
    """A cluster's name by where it is above the centre: everywhere, nowhere, or led by its two largest margins."""
    above = {c: profile[c] - centre[c] for c in profile if profile[c] > centre[c]}
    if len(above) == len(profile):
        return "above centre throughout"
    if not above:
        return "below centre throughout"
    return " and ".join(sorted(above, key=lambda c: -above[c])[:2]) + " led"
