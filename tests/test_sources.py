import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.names import FILLER_WORDS, LEGAL_WORDS
from ledgerloom.operators.fuzzy import merge_lists, token_sort_ratio
from ledgerloom.operators.sampling import sample, stratified_sample
from ledgerloom.sources import lists
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.report import index_report, inputs_review, sentence_review


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"rank": 1, "company": " Foo "}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"rank": "2", "company": "Bar", "city": "X"}]))
    a, b = (lists.json_list(spark, str(tmp_path / f)).first() for f in ("a.json", "b.json"))
    assert (a["rank"], a["company"], a["city"]) == ("1", "Foo", "") and b["city"] == "X"
    (tmp_path / "r.json").write_text(json.dumps({"response": [{"year": 2025, "rank": "x"}]}))
    assert tuple(lists.json_response(spark, str(tmp_path / "r.json"), "year int, rank int, gone string").first()) == (2025, None, None)
    (tmp_path / "f.csv").write_text("gvkey,extra,fyear,at\n00123,z,2024,x\n")
    assert tuple(lists.csv(spark, str(tmp_path / "f.csv"), "gvkey string, fyear int, at double").first()) == ("00123", 2024, None)


def test_html_table(spark):
    page = "<table><tr><td>no</td></tr></table><div class='rank-box'><table><tr><th>r</th><th>c</th><th>s</th></tr><tr><td></td><td>Foo &amp; Co</td><td>1,5</td></tr><tr><td>7</td><td>Bar</td><td>x</td></tr></table></div>"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    out = sorted(tuple(r) for r in lists.ranked_html_table(df, "id", "html", "rank-box", ["rank", "company", "score"]).collect())
    assert out == [(1, 1, "Foo & Co", 15.0), (1, 7, "Bar", None)]


def test_ranked_rows(spark):
    df = spark.createDataFrame([("1", "9.5", "A  b"), ("1", "3", "dup"), ("3", "bad", "C"), ("x", "1", "no")], "rank string, ai_maturity_score string, company_name string")
    t, missing = lists.ranked_rows(df, {3: "Fixed"}, 4)
    assert sorted(tuple(r) for r in t.collect()) == [(1, 9.5, "A b"), (3, None, "Fixed")] and sorted(r[0] for r in missing.collect()) == [2, 4]


def test_universe(spark):
    with pytest.raises(ValueError):
        lists.universe("nope")
    m = spark.createDataFrame([(1, "g1", "aa", "The Foo Inc"), (2, "g1", "bb", "Dup"), (3, "g2", "cc", "Bar")], "row int, gvkey string, tic string, companyname string")
    f = spark.createDataFrame([("g1", 2023, "7")], "gvkey string, fyear int, cik string")
    out = sorted(tuple(r) for r in lists.universe("sp500", members=m, fundamentals=f).select("rank", "ticker", "normalized_company_name", "cik").collect())
    assert out == [(1, "AA", "foo", "7"), (2, "CC", "bar", None)]
    with pytest.raises(ValueError):
        lists.gics_sector(spark.createDataFrame([(1,)], "rank int"), f)


def test_fiscal_year_falls_back(spark):
    df = spark.createDataFrame([("1", None, "2025-03-01"), ("12", "2024-12-31", "2025-03-01"), ("3", "bad", None)], "cik string, period_of_report string, filing_date string")
    assert [(r["cik"], r["fiscal_year"]) for r in lists.filings(df).collect()] == [("0000000001", 2025), ("0000000012", 2024), ("0000000003", None)]


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert lake.indicators() == [] and lake.step("i", "s") is None
    calls = []
    make = lambda: calls.append(1) or spark.range(3).toDF("k")
    assert lake.computed("i", "s", make).count() == 3 and lake.computed("i", "s", make).count() == 3 and len(calls) == 1
    lake.write_indicator(spark.range(2), "b")
    lake.write_indicator(spark.range(2), "a")
    assert lake.indicators() == ["a", "b"] and lake.clear("i") == 1 and lake.clear("i") == 0
    with pytest.raises(ValueError):
        Lake(spark, str(tmp_path), "x")


def test_merge_lists(spark):
    assert token_sort_ratio("b a", "a b") == 100 and 75 < token_sort_ratio("deutsche bank", "deutshe bank") < 100
    base = spark.createDataFrame([(1, "Walmart Stores"), (2, "Deutsche Bank AG"), (3, "Foo Inc"), (4, "Dell 3D Technologies Dells"), (5, None)], "row long, name string")
    other = spark.createDataFrame([(10, "WALMART US"), (11, "Deutshe Bank"), (12, "Foo Corp"), (13, "Foo Holding"), (14, None)], "row long, name string")
    out = {(r["base_row"], r["other_row"]): r["how"] for r in merge_lists(base, other).collect()}
    assert out == {(1, 10): "manual", (2, 11): "fuzzy", (3, 12): "exact"}


def test_merge_equals_choosing_in_turn(spark):
    import random

    random.seed(3)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 5)))
    base = [(i, f"{word()} {word()}") for i in range(40)]
    other = [(i, random.choice(base)[1][: random.randint(1, 9)] + random.choice(["", "a", " b"])) for i in range(40)]
    used, want = set(), {}
    key = lambda n: " ".join(w for w in n.lower().split() if w not in LEGAL_WORDS + FILLER_WORDS)
    for j, n in other:
        if hit := next((i for i, m in base if i not in used and key(m) == key(n) and key(n)), None):
            used.add(hit)
            want[hit, j] = "exact"
        elif key(n) and next((i for i, m in base if i == 0 and i not in used and key(m) == key(n)), None) == 0:
            used.add(0)
            want[0, j] = "exact"
    for j, n in other:
        if j not in {y for _, y in want} and key(n):
            best = max(((token_sort_ratio(key(m), key(n)), -i) for i, m in base if i not in used and key(m)), default=(0, 0))
            if best[0] >= 75:
                used.add(-best[1])
                want[-best[1], j] = "fuzzy"
    got = merge_lists(spark.createDataFrame(base, "row long, name string"), spark.createDataFrame(other, "row long, name string")).collect()
    assert {(r["base_row"], r["other_row"]): r["how"] for r in got} == want


def _aligned(a: str, b: str) -> float:
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(y) + 1)
    for p in x:
        diag = 0
        for j, q in enumerate(y):
            diag, row[j + 1] = row[j + 1], diag + 1 if p == q else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(x) + len(y))


@pytest.mark.parametrize("threshold", [75.0, 50.0])
def test_similar_keys_are_all_found_in_parts(spark, monkeypatch, threshold):
    import random

    from ledgerloom.operators import fuzzy

    monkeypatch.setattr(fuzzy, "_cells", lambda nx, ny, cores: (3, 2))
    random.seed(5)
    word = lambda: "".join(random.choice("abcde-") for _ in range(random.randint(1, 12)))
    x = [" ".join(word() for _ in range(random.randint(1, 14))) for _ in range(60)] + ["a", "b", "é è"]
    y = ["".join(c for c in n if random.random() < 0.8).strip() for n in x] + ["a", "ab", "a" * 300]
    key = lambda xs: spark.createDataFrame([(n,) for n in {" ".join(n.split()) for n in xs} - {""}], "key string")
    a, b = key(x), key(y)
    want = {(r["key"], q["key"]): s for r in a.collect() for q in b.collect() if (s := _aligned(r["key"], q["key"])) >= threshold}
    assert {(r["x"], r["y"]): r["score"] for r in fuzzy.similar_keys(a, b, threshold).collect()} == want and any(len(p) > 64 for p, _ in want)


def test_letters_in_another_order_are_no_likeness(spark):
    from ledgerloom.operators.fuzzy import similar_keys

    a, b = (spark.createDataFrame([(n,)], "key string") for n in ("abcdefghij", "jihgfedcba"))
    assert similar_keys(a, b, 75.0).collect() == []


def test_names_that_share_most_letters_are_compared_in_time(spark):
    import itertools
    import random
    import time

    from ledgerloom.operators.fuzzy import similar_keys

    random.seed(7)
    names = sorted({f"{a}{b} {c}{d} technologies" for a, b, c, d in itertools.product(("tin", "kor", "vel", "mas", "dru", "pon", "shi"), repeat=4)})
    x, y = random.sample(names, 1500), random.sample(names, 1500)
    began = time.time()
    got = {(r["x"], r["y"]): r["score"] for r in similar_keys(*(spark.createDataFrame([(n,) for n in d], "key string") for d in (x, y)), 90.0).collect()}
    assert time.time() - began < 60
    some = set(random.sample(x, 10))
    assert {k: s for k, s in got.items() if k[0] in some} == {(n, m): s for n in some for m in y if (s := _aligned(n, m)) >= 90}


def test_samples_are_stable(spark):
    df = spark.range(100).withColumn("g", (F.col("id") % 3).cast("string"))
    assert [r[0] for r in sample(df, "id", 5).collect()] == [r[0] for r in sample(df.repartition(7), "id", 5).collect()]
    s, key = stratified_sample(df.withColumnRenamed("id", "doc"), "doc", "g", 10)
    assert s.count() == 30 and "g" not in s.columns and key.groupBy("g").count().where("count = 10").count() == 3


def test_reports(spark):
    r = spark.createDataFrame([("<A>", 0.5, None, 1), ("B", None, "zero_denominator", None)], "company_name string, s double, s_reason string, rank int")
    h = inputs_review(r, ["s"])
    assert "&lt;A&gt;" in h and "class='zero'" in h
    s = spark.createDataFrame([("A", "item_1", "regex", 4, 3, "We use AI & more.")], "company_name string, item string, source string, sentence_idx int, elided int, sentence string")
    assert "… 3 …" in sentence_review(s) and "AI &amp; more" in sentence_review(s)
    x = spark.createDataFrame([("A", 1, 50.0, 0.5, 1.0, None), ("B", None, None, None, 0.0, None)], "company_name string, rank int, index_0_100 double, score_d double, coverage_d double, cluster_label string")
    assert "Excluded" in index_report(x, ["d"])
    with pytest.raises(ValueError):
        sentence_review(s.union(s), most=1)


def test_stream_scores_each_sentence_once(spark, tmp_path):
    from ledgerloom.streaming.incremental import score_stream

    src, cache = tmp_path / "in", str(tmp_path / "cache")
    schema = "ts timestamp, sentence string"
    spark.createDataFrame([("2024-01-01 00:00:00", "a gain"), ("2024-01-01 01:00:00", "a gain"), ("2024-01-01 02:00:00", "a loss")], "ts string, sentence string").selectExpr("cast(ts AS timestamp) ts", "sentence").write.parquet(str(src))
    for _ in range(2):
        score_stream(spark.readStream.schema(schema).parquet(str(src)), cache, str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(cache).count() == 2
