"""Deterministic samples: the same rows for a seed on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffle_key(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, hidden key): ``n`` rows per stratum, reshuffled and numbered, and which number came from which stratum."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(shuffle_key(key, seed), key))).where(F.col("_r") <= n).drop("_r")
    numbered = r.withColumn("id", F.row_number().over(W.orderBy(shuffle_key(key, seed + 1), key)))  # n rows per stratum
    return numbered.drop(stratum), numbered.select("id", stratum)
