import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dimensions as D
from ledgerloom.operators import index as I
from ledgerloom.operators import inputs as IN
from ledgerloom.operators import shares, stats
from ledgerloom.sources import lists
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.report import index_report


def test_eto_cascade_with_overrides(spark):
    firms = spark.createDataFrame([("everest", ""), ("acme", "ACM"), ("borden", ""), ("calder", "CAL")], "name string, tick string")
    core = spark.createDataFrame([(2312, "Everest Re"), (1, "Acme Inc"), (2, "Borden"), (3, "Borden Co")], "eto_id long, eto_name string")
    t = spark.createDataFrame([(1, "acm"), (99, "CAL")], "eto_id long, ticker string")
    a = spark.createDataFrame([(99, "Calder")], "eto_id long, alias string")
    out = {r["name"]: (r["eto_id"], r["method"]) for r in IN.match_eto(firms, core, t, a).collect()}
    assert out == {"everest": (2312, "manual"), "acme": (1, "ticker"), "borden": (None, "ambiguous"), "calder": (None, "unmatched")}


def test_gvkey_and_headcount(spark):
    u = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9"), ("d", None)], "company string, gvkey string")
    w = spark.createDataFrame([("1", "A", 0.0), ("2", "B", float("nan"))], "gvkey string, conm string, emp double")
    out = {r["company"]: (r["gvkey"], r["employees_wrds"], r["wrds_match_method"]) for r in IN.match_gvkey(u, w).collect()}
    assert out == {"a": ("1", 0.0, "gvkey"), "b": ("2", None, "gvkey"), "c": (None, None, "unmatched"), "d": (None, None, "unmatched")}


def test_resolve_filings(spark):
    u = spark.createDataFrame([("A", "aa", "a"), ("B", "~", "b"), ("C", "CC", "c"), ("D", "DD", "d"), ("E", "EE", "e"), ("F", None, "f")], "company string, ticker string, normalized_company_name string")
    f = spark.createDataFrame([("1", "AA", "x1", 2024, "2024-02-01", "10-K"), ("1", "AA", "x2", 2024, "2024-03-01", "10-K"), ("1", "AA", "x3", 2024, "2024-09-01", "10-K/A"), ("3", "CC", "y", 2024, "2024-01-01", "10-K/A"), ("4", "DD", "z", 2020, "2021-01-01", "10-K")], "cik string, ticker string, accession_number string, fiscal_year int, filing_date string, form string")
    found, skipped = IN.resolve_filings(u, f, 2024)
    assert [(r["company_name"], r["cik"], r["accession_number"]) for r in found.collect()] == [("A", "0000000001", "x2")]
    assert {r["company"]: r["reason"] for r in skipped.collect()} == {"B": "no ticker", "C": "only amendments", "D": "no filing of the year", "E": "lookup failed", "F": "no ticker"}
    by_cik = IN.resolve_filings(u.withColumn("cik", F.when(F.col("company") == "B", F.lit("4"))), f)[0].collect()
    assert {r["company_name"]: r["accession_number"] for r in by_cik} == {"A": "x2", "B": "z", "D": "z"}


def test_fetch_and_extract(spark, monkeypatch):
    text = "We sell things to people who like them a lot. " * 20

    def fetch(acc):
        if acc == "bad":
            raise OSError("gone")
        return {"new": {"item_1": text}, "legacy": {"item_1": text + "More."}}, ""

    f = spark.createDataFrame([("a", "1"), ("bad", "2")], "accession_number string, cik string")
    rows = {(r["accession_number"], r["parser"]): r["text"] for r in IN.fetch_filings(f, fetch).collect()}
    assert rows["bad", "raw"] is None and rows["a", "raw"] == "" and rows["a", "legacy"].endswith("More.")
    assert [(r["accession_number"], r["item"], r["source"], r["text"]) for r in IN.extract_items(f, fetch, ["new", "legacy"]).collect()] == [("a", "item_1", "edgartools", text + "More.")]
    monkeypatch.delenv("EDGAR_IDENTITY", raising=False)
    with pytest.raises(RuntimeError):
        IN.client_identity()
    monkeypatch.setenv("EDGAR_IDENTITY", "A Name a@b.org")
    assert IN.client_identity() == "A Name a@b.org"


def test_frames_beside_and_shared_values(spark, rows):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(IN.beside({"a": a, "b": b}, ["k"])) == [(1, "x", None), (2, "y", "z"), (3, None, "w")]
    assert rows(IN.in_both(a, b, "k")) == [(2,)]


def test_quantiles_and_ranks_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 57)) for v in rng.integers(0, 9, n)]
    q = {r["key"]: (r["lo"], r["hi"]) for r in I.quantiles(spark.createDataFrame(data, "key string, value double"), {"lo": 0.25, "hi": 0.975}).collect()}
    for k in "abc":
        mine = [v for x, v in data if x == k]
        assert q[k] == pytest.approx((np.quantile(mine, 0.25), np.quantile(mine, 0.975)))
    assert I.quantiles(spark.createDataFrame([], "key string, value double"), {"p": 0.5}).count() == 0


def test_flags_stay_and_t_tail(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0, True), (3.0, 0.0, 5.0, False), (None, None, 9.0, None)], "x double, a_flag double, b_flag double, ok boolean").withColumn("d__has_it", F.col("a_flag"))
    r = I.normalised(df, ["x", "a_flag", "b_flag", "d__has_it"], "minmax").collect()
    assert [x["a_flag"] for x in r] == [1.0, 0.0, None] and [x["d__has_it"] for x in r] == [1.0, 0.0, None] and [x["b_flag"] for x in r] == [0.0, pytest.approx(1 / 3), 1.0]
    assert stats.t_tail(2.2281388520, 10) == pytest.approx(0.05, abs=1e-6) and stats.t_tail(0.0, 5) == 1.0 and stats.t_tail(1.0, 1) == pytest.approx(0.5)
    s = stats.spearman(spark.createDataFrame([(float(i), float(i % 4)) for i in range(12)], "a double, b double"), "a", "b").first()
    assert 0 < s["p"] < 1 and math.isclose(s["rho"], 0.324, abs_tol=0.02)


def test_missing_mechanisms(spark):
    df = spark.createDataFrame([(0.5, None, 0.1, "f", 1, 3), (None, "unmatched", None, None, None, None), (None, "zero_denominator", None, "f", 0, 0), (None, None, None, "f", 1, 0)], "s double, s_reason string, tone double, filing string, parsed int, n_ai int")
    out = {r["indicator"]: r.asDict() for r in shares.mechanism_counts(df, ["s"], {"tone": ("filing", "parsed", "n_ai")}).collect()}
    assert (out["s"]["n_defined"], out["s"]["n_unmatched"], out["s"]["n_zero_denominator"]) == (1, 1, 1) and (out["tone"]["n_no_filing"], out["tone"]["n_item_unparsed"], out["tone"]["n_no_ai_sentences"]) == (1, 1, 1)


def test_lake_keeps_matrix_scores_and_samples(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a")], "id int, source string")
    assert spark.read.parquet(lake.write_matrix(df)).count() == spark.read.parquet(lake.write_scores(df)).count() == 1
    csv, key = lake.write_sample(df.drop("source"), df, "s")
    assert spark.read.option("header", True).csv(csv).columns == ["id"] and spark.read.parquet(key).columns == ["id", "source"]


def test_report_opens_to_the_indicators(spark):
    x = spark.createDataFrame([("A", 1, 50.0, 0.5, 1.0, None, 0.25)], "company_name string, rank int, index_0_100 double, score_d double, coverage_d double, cluster_label string, share double")
    h = index_report(x, ["d"], {"d": ["share"]})
    assert "<details><summary>1. A</summary>" in h and "0.25" in h
    cells = spark.createDataFrame([(["1", "0.5", "Foo"],), (["x"],)], "cells array<string>")
    assert [tuple(r) for r in lists.ranked_pdf_table(cells, ["rank", "ai_maturity_score", "company_name"]).collect()] == [("1", "0.5", "Foo")]


def test_best_k_and_baseline(spark):
    scan = [{"k": 2, "silhouette": 0.9}, {"k": 3, "silhouette": 0.4}, {"k": 4, "silhouette": 0.4}]
    assert D.best_k(scan)["k"] == 3
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i if i % 5 else None) for i in range(40)], "a double, b double, hg_score double")
    out = D.fit_baseline(df, "hg_score", ["a", "b"]).transform(df.na.fill(-1.0)).where("a = 30").first()
    assert abs(out["prediction"] - 60) < 15
