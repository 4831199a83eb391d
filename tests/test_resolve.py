from pyspark.sql import functions as F

from ledgerloom.operators import resolve as R


def test_key_values_drop_empty_and_flag_ambiguous(spark, rows):
    df = spark.createDataFrame([("X", 1), ("X", 1), ("Y", 2), ("Y", 3), (None, 4), ("", 5), ("Z", None)], "k string, v long")
    assert rows(R.key_values(df, F.col("k"), F.col("v"))) == [("X", 1, False), ("Y", None, True)]


def test_cascade_is_ambiguous_only_without_any_hit(spark, rows):
    firms = spark.createDataFrame([(1, "T", "n"), (2, "T", "m"), (3, "U", "q")], "id int, tick string, name string")
    t = spark.createDataFrame([("T", 7), ("T", 8)], "k string, v long")
    n = spark.createDataFrame([("n", 9)], "k string, v long")
    kv = lambda d: R.key_values(d, F.col("k"), F.col("v"))
    out = R.cascade(firms, [("ticker", F.col("tick"), kv(t)), ("name", F.col("name"), kv(n))], "hit", "how")
    assert rows(out, "id", "hit", "how") == [(1, 9, "name"), (2, None, "ambiguous"), (3, None, "unmatched")]


def test_demotion(spark, rows):
    df = spark.createDataFrame(
        [("a", 5, "ticker"), ("b", 5, "alias"), ("c", 6, "name"), ("d", 6, "name"), ("e", 7, "ticker"), ("f", 7, "ticker"), ("g", 7, "alias"), ("h", None, "unmatched")], "firm string, id long, how string"
    )
    out = dict((r[0], (r[1], r[2])) for r in rows(R.demote_duplicates(df, "id", "how", ["ticker", "name", "alias"]), "firm", "id", "how"))
    amb = (None, "ambiguous")
    assert out == {"a": (5, "ticker"), "b": amb, "c": amb, "d": amb, "e": (7, "ticker"), "f": (7, "ticker"), "g": amb, "h": (None, "unmatched")}


def test_preference_and_latest(spark):
    df = spark.createDataFrame([("k", "FS", "USD", 9.0), ("k", "INDL", "CAD", 1.0)], "g string, indfmt string, curcd string, at double")
    best = R.first_by(df.withColumn("p", R.preference({"indfmt": ("INDL", 16), "curcd": ("USD", 8)})), ["g"], [F.col("p"), F.col("at")]).first()
    assert best["indfmt"] == "INDL"
    f = spark.createDataFrame([("1", "a", "10-K", 2025, "2025-02-01"), ("1", "b", "10-K/A", 2025, "2025-05-01")], "cik string, accession_number string, form string, fiscal_year int, filing_date string")
    assert [r["accession_number"] for r in R.latest_filings(f).collect()] == ["a"]


def test_null_year_counts_as_latest(spark):
    from ledgerloom.sources.lists import cik_by_gvkey

    df = spark.createDataFrame([("g", 2023, "a"), ("g", None, "b"), ("h", 2020, None)], "gvkey string, fyear int, cik string")
    assert [tuple(r) for r in cik_by_gvkey(df).collect()] == [("g", "b")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, v long")
    kv = R.key_values(e, F.col("k"), F.col("v"))
    assert kv.count() == 0
    firms = spark.createDataFrame([(1, "x")], "id int, name string")
    assert R.cascade(firms, [("name", F.col("name"), kv)], "hit", "how").first()["how"] == "unmatched"
