"""Lost values of the indicator table: which they are, and what the mixture puts in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.mixture import fill_mixture, fit_mixture
from ledgerloom.session import cut

REASONS = ("unmatched", "zero_denominator")
SHARES = ("ai_publication", "ai_worker")
ALL_SHARES = ("ai_publication", "ai_worker", "ai_patent", "tech_team1_worker")


def reason(name: str) -> Column:
    """The reason a share column gives, null where it names none."""
    c = F.lower(F.trim(F.col(f"{name}_share_reason")))
    return F.when(c.contains(REASONS[0]), REASONS[0]).when(c.contains(REASONS[1]), REASONS[1])


def share(name: str) -> Column:
    """The share where it is a possible value."""
    c = F.col(f"{name}_share")
    return F.when(~F.isnan(c) & c.between(0, 2), c)


def fill_indicators(df: DataFrame, components: int = 4, rounds: int = 15) -> DataFrame:
    """The distinct rows of ``df`` with, for each of the three fields, the value with lost ones filled and a mask
    ``<field>_was_filled``.

    A share is lost if it is no possible value (null, NaN, outside 0..2) and its reason names nothing; a patent
    reason is lost if the share is null and the reason names nothing. What the same firm's other years and the same
    industry and year say enters the mixture as variables beside the row's own values. Rows with a null or repeated
    record id are rows like others. An empty table gives an empty result. Filled shares stay within 0..2.
    """
    # rows are known by a number of their own: record ids may be null or stand for several rows
    id_ = "_row"
    rows = cut(df.distinct().withColumn(id_, F.monotonically_increasing_id()))
    lost = {
        **{f"{x}_share": share(x).isNull() & reason(x).isNull() for x in SHARES},
        "ai_patent_share_reason": F.col("ai_patent_share").isNull() & reason("ai_patent").isNull(),
    }
    base = rows.select(
        id_, "normalized_company_name", "industry", F.col("fiscal_year").cast("string").alias("year"),
        *(share(x).alias(x) for x in ALL_SHARES),
        *(F.when(F.col(f"{x}_share").isNull() | F.isnan(f"{x}_share"), reason(x)).otherwise("present").alias(f"{x}_state") for x in ALL_SHARES),
        *(v.alias(f"{k}_was_filled") for k, v in lost.items()),
    )
    # means per firm and per industry and year; grouped sums combine before the shuffle, so a hot firm does no harm
    firm = base.groupBy("normalized_company_name").agg(
        *(F.sum(x).alias(f"{x}_s") for x in ALL_SHARES), *(F.count(x).alias(f"{x}_c") for x in ALL_SHARES),
        F.mode(F.when(F.col("ai_patent_state").isin(*REASONS), F.col("ai_patent_state"))).alias("firm_reason"),
    )
    peers = base.groupBy("industry", "year").agg(*(F.avg(x).alias(f"{x}_peer") for x in SHARES))
    others = lambda x: F.try_divide(F.col(f"{x}_s") - F.coalesce(x, F.lit(0.0)), F.col(f"{x}_c") - F.col(x).isNotNull().cast("int"))
    wide = cut(
        base.join(firm, "normalized_company_name", "left").join(peers.withColumnsRenamed({"industry": "_i", "year": "_y"}), F.col("industry").eqNullSafe(F.col("_i")) & (F.col("year") == F.col("_y")), "left")
        .select(*base.columns, *(others(x).alias(f"{x}_firm") for x in ALL_SHARES), *(f"{x}_peer" for x in SHARES), "firm_reason")
        .withColumn("patent_reason", F.when(F.col("ai_patent_state").isin(*REASONS), F.col("ai_patent_state")))
    )
    num = [*ALL_SHARES, *(f"{x}_firm" for x in ALL_SHARES), *(f"{x}_peer" for x in SHARES)]
    cat = ["industry", "year", "patent_reason", "firm_reason"]
    if wide.isEmpty():
        filled = wide.select(id_, *(F.lit(None).cast("double").alias(f"{x}_filled") for x in SHARES), F.lit(None).cast("string").alias("patent_reason_filled"))
    else:
        m, levels = fit_mixture(wide, num, cat, components, rounds)
        filled = fill_mixture(wide, m, levels, num, cat, id_, SHARES, ["patent_reason"])
    out = rows.join(wide.select(id_, *(f"{k}_was_filled" for k in lost)), id_).join(filled, id_)
    for x in SHARES:
        k = f"{x}_share"
        out = out.withColumn(k, F.when(F.col(f"{k}_was_filled"), F.least(F.greatest(F.col(f"{x}_filled"), F.lit(0.0)), F.lit(2.0))).otherwise(F.col(k)))
    k = "ai_patent_share_reason"
    out = out.withColumn(k, F.when(F.col(f"{k}_was_filled"), F.coalesce("patent_reason_filled", F.lit(REASONS[0]))).otherwise(F.col(k)))
    return out.drop(*(f"{x}_filled" for x in SHARES), "patent_reason_filled", id_)


def filled_cells(df: DataFrame) -> DataFrame:
    """``(record_id, field, value)`` of every filled value of ``fill_indicators``' result."""
    fields = [f"{x}_share" for x in SHARES] + ["ai_patent_share_reason"]
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_was_filled").alias("was")) for f in fields))
    return df.select("record_id", F.explode(cells).alias("c")).where("c.was").select("record_id", "c.field", "c.value")
