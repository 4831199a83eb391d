"""Entity resolution: unambiguous keys, ordered cascades, demotion of weaker duplicates, preferred and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(key, value, ambiguous)``: each key with its value, or with a null value if it has several. Null and empty
    keys and null values are dropped."""
    pairs = df.select(key.alias("key"), value.alias("value")).where(F.col("key").isNotNull() & F.col("value").isNotNull() & (F.col("key").cast("string") != ""))
    g = pairs.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"), (F.col("lo") != F.col("hi")).alias("ambiguous"))


def cascade(firms: DataFrame, passes: Sequence[tuple[str, Column, DataFrame]], id_name: str, method_name: str) -> DataFrame:
    """Match firms by the first pass with an unambiguous hit. A pass is (method, key of the firm, ``key_values``
    table). Without any hit the method is ``ambiguous`` if some pass met an ambiguous key, else ``unmatched``."""
    out, found, amb = firms, [], []
    for i, (_, key, table) in enumerate(passes):
        t = table.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}"), F.col("ambiguous").alias(f"_a{i}"))
        out = out.withColumn(f"_f{i}", key).join(t, F.col(f"_f{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
        amb.append(F.coalesce(F.col(f"_a{i}"), F.lit(False)))
    method = F.when(amb[0] if len(amb) == 1 else F.array_max(F.array(*amb)), "ambiguous").otherwise("unmatched")
    for i in reversed(range(len(passes))):
        method = F.when(found[i].isNotNull(), passes[i][0]).otherwise(method)
    return out.select(*firms.columns, F.coalesce(*found).alias(id_name), method.alias(method_name))


def demote_duplicates(df: DataFrame, id_name: str, method_name: str, order: Sequence[str]) -> DataFrame:
    """Of several firms with one id all weaker than the strongest method lose it; if all are equally strong, all
    lose it. Losers become ``ambiguous``."""
    rank = F.lit(len(order))
    for i, m in reversed(list(enumerate(order))):
        rank = F.when(F.col(method_name) == m, i).otherwise(rank)
    r = df.withColumn("_rank", rank)
    # grouped, not windowed: a hot id costs no sort
    best = r.where(F.col(id_name).isNotNull()).groupBy(F.col(id_name).alias("_id")).agg(F.count("*").alias("_n"), F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"))
    j = r.join(best, F.col(id_name) == F.col("_id"), "left")
    lost = F.coalesce((F.col("_n") > 1) & ((F.col("_rank") > F.col("_lo")) | (F.col("_lo") == F.col("_hi"))), F.lit(False))
    keep = [c for c in df.columns if c not in (id_name, method_name)]
    return j.select(*keep, F.when(~lost, F.col(id_name)).alias(id_name), F.when(lost, "ambiguous").otherwise(F.col(method_name)).alias(method_name))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by ``order`` (Columns that compare; put missing-last or missing-first into
    them). One aggregate, combined before the shuffle."""
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def preference(weights: dict[str, tuple[str, int]], filled: str | None = None) -> Column:
    """Score of a record: the weights of the codes it carries, and one if ``filled`` has a value."""
    s = F.lit(0)
    for c, (value, w) in weights.items():
        s = s + F.when(F.upper(F.trim(F.col(c))) == value, w).otherwise(0)
    return s + F.when(F.col(filled).isNotNull() & ~F.isnan(filled), 1).otherwise(0) if filled else s


def latest_filings(filings: DataFrame, form: str = "10-K", fiscal_year: int | None = None) -> DataFrame:
    """The latest filing of exactly ``form`` per firm; amendments never win."""
    f = filings.where(F.col("form") == form)
    if fiscal_year is not None:
        f = f.where(F.col("fiscal_year") == fiscal_year)
    return first_by(f, ["cik"], [F.col("filing_date"), F.col("accession_number")])


def known_and_missing(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What a cache holds of the wanted keys, and the wanted keys it lacks."""
    return cache.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(cache.select(key).distinct(), key, "left_anti")
