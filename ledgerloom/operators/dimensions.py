"""The dimensions read from filings: their Items, what scores their sentences, and how far the scores can be trusted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.index import DIMENSIONS, dimension_score, geometric_composite, linear_composite, normalised, sqrt_skewed, tone_reliability
from ledgerloom.operators.stats import correlations, variance_components


@dataclass(frozen=True)
class Dimension:
    """A dimension, the Item it is read from and the kind of its tone: ``sentiment`` or ``forward_looking``."""

    name: str
    item: str
    tone: str

    @property
    def value(self) -> Column:
        """What a scored sentence says: positive less negative, or how far it looks ahead at all."""
        return F.col("pos") - F.col("neg") if self.tone == "sentiment" else F.col("p_specific") + F.col("p_nonspecific")


TEXT_DIMENSIONS = {d.name: d for d in (Dimension("strategy", "item_1", "sentiment"), Dimension("operations", "item_7", "sentiment"), Dimension("governance", "item_1a", "forward_looking"))}


def tone_fit(scored: DataFrame, dims: dict[str, Dimension] = TEXT_DIMENSIONS, group: str = "accession_number") -> DataFrame:
    """Per dimension the variance components of its sentence scores (item, group, score columns), k, ICC, and k again
    by the method of moments. Groups are reduced to count, mean and variance before they meet."""
    parts = [scored.where(F.col("item") == d.item).select(F.lit(d.name).alias("dimension"), group, d.value.alias("y")) for d in dims.values()]
    every = reduce(DataFrame.unionByName, parts).where("y IS NOT NULL AND NOT isnan(y)")
    base = variance_components(every, ["dimension"], group, "y")
    g = every.groupBy("dimension", group).agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    m = g.groupBy("dimension").agg(
        F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("v"))), F.sum(F.when(F.col("n") > 1, F.col("n") - 1))).alias("s2"), F.var_samp("m").alias("vm"), F.avg(1 / F.col("n")).alias("inv")
    )
    check = m.select("dimension", (F.col("s2") / F.greatest(F.col("vm") - F.col("s2") * F.col("inv"), F.lit(1e-12))).alias("k_moments_check"))
    return base.join(check, "dimension")


def within_correlations(df: DataFrame, dims: dict[str, tuple[str, str]]) -> DataFrame:
    """``(dimension, a, b, r, n)``: the correlation of each dimension's two indicators; null under three rows."""
    parts = [correlations(df, list(pair), least=3).withColumn("dimension", F.lit(name)) for name, pair in dims.items()]
    return reduce(DataFrame.unionByName, parts).select("dimension", "a", "b", "r", "n")


def index_variants(df: DataFrame, key: str, dims: dict[str, list[str]], counts: dict[str, tuple[str, float]], filled: DataFrame) -> DataFrame:
    """``(key, variant, index)`` of the main index and its variants: weights by coverage, no reliability weights, k
    doubled, no treatment of skew, ranks for values, geometric mean, and gaps filled (``filled``, without reliability).

    ``counts``: for an indicator read from sentences, their number's column and its k."""
    cols = [c for cs in dims.values() for c in cs]

    def weights(times: float) -> dict[str, Column]:
        return {c: tone_reliability(F.col(n), k * times) for c, (n, k) in counts.items()}

    def scored(frame: DataFrame, how: str, times: float | None, name: str, aggregate: str = "linear", coverage: bool = False) -> DataFrame:
        w = weights(times) if times else {}
        x = normalised(frame.withColumns({f"_w_{c}": w.get(c, F.lit(1.0)) for c in cols}), cols, how)
        scores, cover = zip(*(dimension_score([F.col(c) for c in cs], [F.col(f"_w_{c}") for c in cs]) for cs in dims.values()))
        by = list(cover) if coverage else [(c > 0).cast("double") for c in cover]
        return x.select(key, F.lit(name).alias("variant"), (geometric_composite if aggregate == "geometric" else linear_composite)(list(scores), by).alias("index"))

    treated, _ = sqrt_skewed(df, cols)
    filled_treated, _ = sqrt_skewed(filled, cols)
    made = [
        scored(treated, "minmax", 1.0, "main"), scored(treated, "minmax", 1.0, "coverage_weighted", coverage=True), scored(treated, "minmax", None, "no_reliability"), scored(treated, "minmax", 2.0, "k_doubled"),
        scored(df, "minmax", 1.0, "no_treatment"), scored(treated, "rankscore", 1.0, "rank_norm"), scored(treated, "minmax", 1.0, "geometric", aggregate="geometric"), scored(filled_treated, "minmax", None, "sector_median"),
    ]
    return reduce(DataFrame.unionByName, made)


def best_k(scan: list[dict], without: int = 2) -> dict:
    """The entry of a k-means scan with the largest silhouette, the first of equals; two clusters only halve a scale."""
    return max((s for s in scan if s["k"] != without), key=lambda s: (s["silhouette"], -s["k"]))


def cluster_means(labels: DataFrame, value: str) -> DataFrame:
    """Mean of a score per cluster, largest first; rows without a cluster have none."""
    return labels.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n")).orderBy(F.desc(f"mean_{value}"))


def fit_baseline(frame: DataFrame, target: str, features: list[str], seed: int = 42):
    """Gradient-boosted trees that predict an outside score from the indicators (rows with a target; gaps as -1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = frame.where(F.col(target).isNotNull()).na.fill(-1.0, features)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(labelCol=target, seed=seed, maxIter=20)]).fit(rows)


__all__ = ["DIMENSIONS", "TEXT_DIMENSIONS", "Dimension", "best_k", "cluster_means", "fit_baseline", "index_variants", "tone_fit", "within_correlations"]
