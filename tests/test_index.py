import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import index as I
from ledgerloom.operators import shares as S
from ledgerloom.operators import stats


def frame(spark, values, extra=""):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")


def test_shares_and_reasons(spark):
    df = spark.createDataFrame([(True, 1.0, 0.0), (True, 1.0, None), (True, None, 10.0), (True, 0.0, 10.0), (False, None, None), (True, 12.0, 10.0)], "m boolean, n double, d double")
    out = [tuple(r) for r in df.select(S.ratio(F.col("n"), F.col("d")), S.reason(F.col("m"), F.col("d"))).collect()]
    assert out == [(None, "zero_denominator"), (None, "zero_denominator"), (None, None), (0.0, None), (None, "unmatched"), (1.2, None)]


def test_structural_zeros(spark):
    df = spark.createDataFrame([(None, "zero_denominator"), (None, "unmatched"), (None, None), (0.5, None)], "s double, s_reason string")
    out = [tuple(r) for r in S.fill_structural_zeros(df, ["s"]).select("s", "s_imputed").collect()]
    assert out == [(0.0, True), (None, False), (None, False), (0.5, False)]


@pytest.mark.parametrize("how", ["zscore", "minmax", "rankscore"])
def test_column_without_spread_is_zero_everywhere(spark, how):
    vals = [None, None, None] if how == "rankscore" else [5.0, None, 5.0]
    assert [r["x"] for r in I.normalised(frame(spark, vals), ["x"], how).collect()] == [0.0, 0.0, 0.0]


def test_rankscore_ties_and_nulls(spark):
    out = {r["id"]: r["x"] for r in I.normalised(frame(spark, [1.0, 2.0, 2.0, None, 5.0]), ["x"], "rankscore").collect()}
    assert out == {0: 0.0, 1: 0.5, 2: 0.5, 3: None, 4: 1.0}


def test_nan_is_missing(spark):
    out = {r["id"]: r["x"] for r in I.normalised(frame(spark, [0.0, float("nan"), 10.0]), ["x"], "minmax").collect()}
    assert out == {0: 0.0, 1: None, 2: 1.0}


def test_competition_rank(spark):
    out = {r["id"]: r["rank"] for r in I.competition_rank(frame(spark, [80.0, 80.0, 70.0, None]), "x").collect()}
    assert out == {0: 1, 1: 1, 2: 3, 3: None}


def test_dimension_weights(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, 1.0), (None, 0.4, 0.5, None)], "a double, b double, wa double, wb double")
    s, c = I.dimension_score([F.col("a"), F.col("b")], [F.col("wa"), F.col("wb")])
    assert [tuple(r) for r in df.select(s, c).collect()] == [(0.5, 1.0), (0.4, 0.5)]


def test_composites(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0, 1.0), (0.5, 0.5, 1.0, 0.0)], "a double, b double, u double, v double")
    s, w = [F.col("a"), F.col("b")], [F.col("u"), F.col("v")]
    lin, geo = zip(*((r[0], r[1]) for r in df.select(I.linear_composite(s, w), I.geometric_composite(s, w)).collect()))
    assert lin == (50.0, None) and geo[1] is None and math.isclose(geo[0], math.exp(math.log(0.01) / 2) * 100)


def test_sqrt_only_where_skewed_and_never_negative(spark):
    vals = [1.0] * 50 + [10000.0]
    df, bad = I.sqrt_skewed(frame(spark, vals), ["x"])
    assert bad == ["x"] and df.agg(F.max("x")).first()[0] == 100.0
    with pytest.raises(Exception, match="negative"):
        I.sqrt_skewed(frame(spark, [-1.0] * 50 + [10000.0]), ["x"])[0].collect()
    assert I.sqrt_skewed(frame(spark, [1.0, 2.0, 3.0]), ["x"])[1] == []


def test_compose_refuses_double_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(ValueError):
        I.compose(a, {"b": b}, "k")
    assert I.compose(a, {"b": b.limit(1)}, "k").columns == ["k", "b__v"]


def test_pca_kmo_alpha_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 1))
    x = base + rng.normal(size=(200, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    r = np.corrcoef(x.T)
    val = np.sort(np.linalg.eigvalsh(r))[::-1]
    p = stats.pca(df, list("abcd"))
    assert np.allclose(p.eigenvalue, val * 200 / 199) and (p.load_a[0] > 0)
    mean = r[np.triu_indices(4, 1)].mean()
    assert math.isclose(stats.cronbach_alpha(df, list("abcd")), 4 * mean / (1 + 3 * mean), rel_tol=1e-9)
    k = stats.kmo_bartlett(df, list("abcd"))
    assert 0.5 < k["kmo"] < 1 and k["p"] < 1e-6
    assert math.isclose(stats.upper_gamma(2.5, 3.0), 0.3062189, rel_tol=1e-6) and math.isclose(stats.upper_gamma(1, 2), math.exp(-2), rel_tol=1e-12)


def test_correlation_needs_thirty_pairs(spark):
    mk = lambda n: spark.createDataFrame([(float(i), float(i * 2)) for i in range(n)], "a double, b double")
    assert stats.correlations(mk(29), ["a", "b"]).first()["r"] is None
    assert math.isclose(stats.correlations(mk(30), ["a", "b"]).first()["r"], 1.0)


def test_kendall_blocks_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.integers(0, 8, (60, 2))], "x double, y double")
    a, b = stats.kendall(df, "x", "y", 10).first(), stats.kendall(df, "x", "y", 1000).first()
    assert math.isclose(a["tau"], b["tau"], rel_tol=1e-12) and a["n"] == 60
    assert stats.kendall(df.limit(2), "x", "y").first()["tau"] is None


def test_variance_components_of_equal_groups(spark):
    df = spark.createDataFrame([("d", g, float(g * 10 + e)) for g in range(5) for e in (-1, 0, 1)], "dim string, g int, v double")
    r = stats.variance_components(df, ["dim"], "g", "v").first()
    assert math.isclose(r["msw"], 1.0) and math.isclose(r["n0"], 3.0) and r["icc"] > 0.9


def test_prf_without_cases(spark):
    r = stats.classification(spark.createDataFrame([(0, 0)], "p int, g int"), "p", "g").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_cluster_names():
    c = {"a": 1.0, "b": 1.0, "c": 1.0}
    assert stats.name_cluster({"a": 2.0, "b": 2.0, "c": 2.0}, c).startswith("above") and stats.name_cluster({"a": 0.0, "b": 1.0, "c": 0.5}, c).startswith("below")
    assert stats.name_cluster({"a": 3.0, "b": 0.0, "c": 2.0}, c) == "a and c led"


def test_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(3, 1, (25, 2)), [[20.0, 20.0]]])
    lab = np.array([0] * 30 + [1] * 25 + [2])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        mates = lab == lab[i]
        a = d[i, mates].sum() / max(mates.sum() - 1, 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b) if mates.sum() > 1 else 0.0)
    df = spark.createDataFrame([(i, float(p[0]), float(p[1]), int(c)) for i, (p, c) in enumerate(zip(x, lab))], "id long, a double, b double, cluster int")
    assert math.isclose(stats.silhouette(df, "id", ["a", "b"], block=10), np.mean(want), rel_tol=1e-9)


def test_ranks_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 400).cast("double").alias("x")).repartition(8)
    r = {x["value"]: x["rank"] for x in I.average_ranks(df, "x").collect()}
    assert r[0.0] == 2.0 and r[199.0] == 599.0 and r[399.0] == 999.5 and len(r) == 400
