import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import names as N
from pyspark.sql import functions as F

KEYS = [
    ("Foo Holdings Group Co., Ltd.", "foo"), ("Johnson & Johnson", "johnson johnson"), ("Apple Inc &", "apple inc"), ("Foo-co", "fooco"), ("Nestlé S.A.", "nestl sa"), ("Group", "group"), (None, ""), ("", ""),
]


def test_company_key(spark):
    df = spark.createDataFrame([(a,) for a, _ in KEYS], "n string")
    assert [r[0] for r in df.select(N.company_key(F.col("n"))).collect()] == [b for _, b in KEYS]


def test_merge_name(spark):
    df = spark.createDataFrame([("Nestlé S.A.",), ("The Foo International Group",), ("Anheuser-Busch InBev",), (None,), ("  ",)], "n string")
    assert [r[0] for r in df.select(N.merge_name(F.col("n"))).collect()] == ["nestle s a", "foo", "anheuser-busch inbev", "", ""]


def test_tickers_and_ids(spark):
    df = spark.createDataFrame([("BRK.A",), ("BRK-A",), (" brka",), ("~",), ("NAN",), (None,)], "t string")
    assert [r[0] for r in df.select(N.ticker_form(F.col("t"))).collect()] == ["BRKA"] * 3 + [""] * 3
    ids = spark.createDataFrame([("12",), ("12345678901",), (None,)], "i string")
    assert [r[0] for r in ids.select(N.padded_id(F.col("i"), 10)).collect()] == ["0000000012", "12345678901", None]
    nums = spark.createDataFrame([("1000402.0",), (" 0007 ",), ("x",)], "i string")
    assert [r[0] for r in nums.select(N.plain_number(F.col("i"))).collect()] == [1000402, 7, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("aB .,&-é'incltdgroup", max_size=25), min_size=5, max_size=30))
def test_company_key_has_key_signs_only(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "n string")
    out = [r[0] for r in df.select(N.company_key(F.col("n"))).collect()]
    assert all(set(o) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ") and o == o.strip() and "  " not in o for o in out)


@pytest.mark.parametrize("name,want", [("The Gap", "Gap"), ("the  Gap", "Gap"), ("Theory", "Theory")])
def test_article(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(N.without_article(F.col("n"))).first()[0] == want
