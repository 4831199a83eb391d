"""Ratio indicators with the reason of every missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.index import quantiles


def ratio(num: Column, den: Column) -> Column:
    """num / den, null unless den is positive."""
    return num / F.when(den > 0, den)


def reason(matched: Column, den: Column) -> Column:
    """Why a ratio cannot exist: no record of the firm, or no positive denominator (unknown ones included)."""
    return F.when(~matched, "unmatched").when(den.isNull() | (den <= 0), "zero_denominator")


def mechanism(ind: str) -> Column:
    """What an indicator value is: its reason, else ``defined`` or null where a value is missing without reason."""
    why = F.col(f"{ind}_reason")
    return F.coalesce(why, F.when(F.col(ind).isNotNull(), "defined"))


def text_mechanism(value: Column, filing: Column, parsed: Column, n_ai: Column) -> Column:
    """The same for indicators read from filings."""
    return F.when(value.isNotNull(), "defined").when(filing.isNull(), "no_filing").when(F.coalesce(parsed, F.lit(0)) == 0, "item_unparsed").when(F.coalesce(n_ai, F.lit(0)) == 0, "no_ai_sentences")


def fill_structural_zeros(df: DataFrame, inds: list[str]) -> DataFrame:
    """0 where the reason is a zero denominator, with a flag ``<ind>_imputed``."""
    cols = {}
    for i in inds:
        hit = F.coalesce(F.col(f"{i}_reason") == "zero_denominator", F.lit(False))
        cols[i] = F.when(hit, 0.0).otherwise(F.col(i))
        cols[f"{i}_imputed"] = hit
    return df.withColumns(cols)


def sector_median(df: DataFrame, value: str, sector: str, least: int = 5) -> DataFrame:
    """``df`` with ``<value>_filled``: missing values from the sector's median if it has ``least`` values, else the
    overall one. A null sector takes the overall one. Values keep their NaN as missing."""
    v = F.when(~F.isnan(value), F.col(value))
    long = df.select(F.col(sector).cast("string").alias("key"), v.cast("double").alias("value")).where("value IS NOT NULL")
    per = quantiles(long.where("key IS NOT NULL"), {"_m": 0.5}).join(long.groupBy("key").agg(F.count("*").alias("_n")), "key").withColumnRenamed("key", "_s")
    overall = quantiles(long.withColumn("key", F.lit("all")), {"_all": 0.5}).select("_all").unionByName(df.sparkSession.createDataFrame([(None,)], "_all double")).agg(F.max("_all").alias("_all"))
    j = df.join(per, F.col(sector).cast("string") == F.col("_s"), "left").crossJoin(F.broadcast(overall))  # one row
    return j.select(*df.columns, F.coalesce(v, F.when(F.col("_n") >= least, F.col("_m")), F.col("_all")).alias(f"{value}_filled"))


def mechanism_counts(df: DataFrame, shares: list[str], read: dict[str, tuple[str, str, str]]) -> DataFrame:
    """``(indicator, n, n_defined, pct_missing, n_<mechanism> ...)``: of every indicator how many values there are and why
    the others are missing. ``shares`` carry a reason column; ``read`` names for an indicator read from filings the
    columns that say whether there is a filing, whether its Item was parsed, and how many sentences speak of it."""
    value = lambda i: F.when(~F.isnan(F.col(i).cast("double")), F.col(i).cast("double"))
    parts = [F.struct(F.lit(i).alias("indicator"), value(i).alias("v"), F.when(value(i).isNotNull(), "defined").otherwise(F.col(f"{i}_reason")).alias("m")) for i in shares]
    parts += [F.struct(F.lit(i).alias("indicator"), value(i).alias("v"), text_mechanism(value(i), F.col(f), F.col(p), F.col(n)).alias("m")) for i, (f, p, n) in read.items()]
    g = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").groupBy("indicator")
    names = ("zero_denominator", "unmatched", "no_ai_sentences", "item_unparsed", "no_filing")
    r = g.agg(F.count("*").alias("n"), F.count("v").alias("n_defined"), *(F.count_if(F.col("m") == m).alias(f"n_{m}") for m in names))
    return r.select("indicator", "n", "n_defined", F.round(100.0 * (F.col("n") - F.col("n_defined")) / F.col("n"), 6).alias("pct_missing"), *(f"n_{m}" for m in names))
