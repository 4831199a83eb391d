import numpy as np
import pytest

from ledgerloom.operators.indicator_fill import fill_indicators, filled_cells
from ledgerloom.operators.mixture import fill_mixture, fit_mixture

SHARES = ("ai_publication", "ai_patent", "ai_worker", "tech_team1_worker")
SCHEMA = "record_id long, normalized_company_name string, industry string, fiscal_year int, " + ", ".join(f"{x}_share double, {x}_share_reason string" for x in SHARES)


def row(i, firm, year, **kw):
    vals = []
    for x in SHARES:
        vals += [kw.get(x, 0.1), kw.get(f"{x}_reason")]
    return (i, firm, kw.get("industry", "I"), year, *vals)


def test_what_is_lost(spark, rows):
    data = [row(i, f"f{i % 6}", 2020 + i // 6, **{x: 0.05 + 0.01 * (i % 6) for x in SHARES}) for i in range(30)]
    nan = float("nan")
    data += [
        row(101, "f1", 2025, ai_publication=None, ai_patent=0.06, ai_worker=0.06, tech_team1_worker=0.06), row(102, "f1", 2026, ai_publication=nan, ai_publication_reason="unmatched"), row(103, "f2", 2025, ai_worker=999.0), row(104, "f2", 2026, ai_worker=1.5),
        row(105, "f3", 2025, ai_patent=None), row(106, "f3", 2026, ai_patent=None, ai_patent_reason="n/a"), row(107, "f3", 2027, ai_patent=None, ai_patent_reason=" Zero_Denominator"), row(108, None, 2025, ai_publication=-1.0, industry=None),
    ]
    df = spark.createDataFrame(data + data[:3], SCHEMA)
    out = fill_indicators(df, components=2, rounds=5)
    assert out.count() == len(data)
    cells = filled_cells(out)
    assert rows(cells, "record_id", "field") == sorted([(101, "ai_publication_share"), (103, "ai_worker_share"), (105, "ai_patent_share_reason"), (106, "ai_patent_share_reason"), (108, "ai_publication_share")], key=repr)
    got = {r["record_id"]: r["value"] for r in cells.collect()}
    assert abs(float(got[101]) - 0.06) < 0.02 and 0 <= float(got[108]) <= 2 and got[105] in ("unmatched", "zero_denominator")


def test_empty_table(spark):
    assert filled_cells(fill_indicators(spark.createDataFrame([], SCHEMA))).count() == 0


def test_mixture_recovers_held_out_values(spark):
    rng = np.random.default_rng(3)
    n = 1500
    k = rng.integers(0, 2, n)
    x = rng.normal(np.array([-2.0, 2.0])[k], 0.4)
    y = 3 * x + rng.normal(0, 0.3, n)
    c = np.where(rng.random(n) < 0.9, k, 1 - k)
    hide_y, hide_c = rng.random(n) < 0.2, rng.random(n) < 0.2
    df = spark.createDataFrame([(i, float(x[i]), None if hide_y[i] else float(y[i]), None if hide_c[i] else f"c{c[i]}") for i in range(n)], "id long, x double, y double, c string")
    m, levels = fit_mixture(df, ["x", "y"], ["c"], components=2, rounds=20)
    got = {r["id"]: r for r in fill_mixture(df, m, levels, ["x", "y"], ["c"], "id", ["y"], ["c"]).collect()}
    err = np.array([got[i]["y_filled"] - y[i] for i in np.flatnonzero(hide_y)])
    assert np.sqrt((err**2).mean()) < 0.5 and all((got[i]["y_filled"] is None) == (not hide_y[i]) for i in range(n))
    assert np.mean([got[i]["c_filled"] == f"c{c[i]}" for i in np.flatnonzero(hide_c)]) > 0.8
    with pytest.raises(ValueError):
        fit_mixture(df.limit(0), ["x"], [])


def test_rare_levels_share_an_entry_and_null_ids_stay(spark):
    rng = np.random.default_rng(5)
    data = [(i, float(rng.normal(0 if i % 3 else 5, 0.1)), "a" if i % 3 else f"rare{i}", None if i % 10 == 0 else "x") for i in range(300)]
    df = spark.createDataFrame(data, "id long, v double, c string, d string")
    m, levels = fit_mixture(df, ["v"], ["c", "d"], components=2, rounds=6, max_levels=1)
    assert levels[0] == ["a", "\x00rest"] and abs(m.table[0][:, 1] @ m.weight - 1 / 3) < 0.05
    out = fill_mixture(df, m, levels, ["v"], ["c", "d"], "id", ["v"], ["d"])
    assert {r["d_filled"] for r in out.collect()} == {None, "x"}
    twin = [row(None, "f1", 2020 + i, ai_publication=None if i == 2 else 0.2) for i in range(5)] + [row(7, "f2", 2020), row(7, "f2", 2021, ai_worker=None)]
    got = fill_indicators(spark.createDataFrame(twin, SCHEMA), components=1, rounds=3)
    assert got.count() == 7 and got.where("record_id IS NULL").count() == 5 and got.where("ai_publication_share_was_filled").count() == 1


def test_fills_are_nearer_than_the_industrys_mean(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.01/indicators.parquet").distinct()
    known = F.col("ai_publication_share").between(0, 2) & F.col("ai_publication_share_reason").isNull()
    hide = df.where(known).select("record_id", F.col("ai_publication_share").alias("true")).where("record_id % 10 = 3").dropDuplicates(["record_id"])
    lost = df.join(hide, "record_id", "left").withColumn("ai_publication_share", F.when(F.col("true").isNull(), F.col("ai_publication_share"))).drop("true")
    out = fill_indicators(lost).where("ai_publication_share_was_filled").join(hide, "record_id")
    mean = df.where(known).groupBy("industry", "fiscal_year").agg(F.avg("ai_publication_share").alias("mean"))
    r = out.join(mean, ["industry", "fiscal_year"]).agg(F.avg(F.abs(F.col("ai_publication_share") - F.col("true"))).alias("em"), F.avg(F.abs(F.col("mean") - F.col("true"))).alias("mean"), F.count("*").alias("n")).first()
    print(r)
    assert r["n"] > 50 and r["em"] < 0.5 * r["mean"]
