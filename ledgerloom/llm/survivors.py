"""Best representative of each duplicate group (problem 7).

Iterative truth discovery: every record's code combination is a source. Alternately, the values of a field (numbers
and codes alike) are voted on in each group with the sources' weights, and a source's weight is re-estimated from how
much its claims are backed, until the weights settle. The highest-supported value survives per field. The record that stands for the group
is the one with the highest preference score, then largest assets, then latest load, then smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

CODES = {"indfmt": ("INDL", 16), "curcd": ("USD", 8), "datafmt": ("STD", 4), "consol": ("C", 2)}
FIELDS = ("emp", "at")


def gvkey8(c: Column) -> Column:
    """A firm key as 8 digits: outer blanks and a decimal tail dropped, zeros restored."""
    k = F.regexp_replace(F.trim(c), r"\.0+$", "")
    return F.when(F.length(k) < 8, F.lpad(k, 8, "0")).otherwise(k)


def number(name: str) -> Column:
    """A double with NaN taken as missing."""
    return F.when(~F.isnan(name), F.col(name))


def records(df: DataFrame) -> DataFrame:
    """Distinct records with keys and codes in normal form; records without a fiscal year belong to no group."""
    code = lambda c: F.upper(F.trim(F.col(c)))
    score = sum((F.when(code(c) == v, w).otherwise(0) for c, (v, w) in CODES.items()), F.lit(0)) + F.when(number("emp").isNotNull(), 1).otherwise(0)
    return df.where(F.col("fyear").isNotNull() & F.col("gvkey").isNotNull()).select(
        gvkey8(F.col("gvkey")).alias("gvkey"), "fyear", "record_id", *(code(c).alias(c) for c in CODES), *(number(f).alias(f) for f in FIELDS), "loaded_at", score.alias("preference")
    ).distinct()


def claims(recs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Field values in long form, ``(gvkey, fyear, source, field, value, bin)``. A number's ``bin`` is half of ``tolerance``
    wide on a log scale, so numbers within the tolerance lie in one bin or in neighbours; a code is its own bin. The
    record's combination of codes is its source."""
    source = F.concat_ws("/", *(F.coalesce(c, F.lit("?")) for c in CODES))
    numbers = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.when(F.col(f) > 0, F.floor(F.log(f) * (2 / tolerance))).otherwise(F.floor(F.col(f)) - (1 << 40)).alias("bin")) for f in FIELDS]
    codes = [F.struct(F.lit(c).alias("field"), F.nullif(c, F.lit("")).alias("value"), F.xxhash64(c).alias("bin")) for c in CODES]
    long = recs.select("gvkey", "fyear", source.alias("source"), F.explode(F.array(*numbers, *codes)).alias("p")).select("gvkey", "fyear", "source", "p.*")
    return long.where("value IS NOT NULL")


def truth(recs: DataFrame, settled: float = 1e-3, most: int = 200) -> DataFrame:
    """``(gvkey, fyear, field, value, support)``: the value with the highest weighted vote of each field.

    A claim is backed by the votes of its bin and, for numbers, of the two bins beside it. A source's weight is the
    negative log of the share of votes that its claims miss; weights move all the way to it, or half as far once they
    no longer come closer, and rounds go on until none moves by ``settled`` (an error if they don't within ``most``). Everything is summed per group,
    bin and source first, so a group of any size is combined before the shuffle."""
    group = ["gvkey", "fyear", "field"]
    long = cut(claims(recs))
    facts = cut(long.groupBy(*group, "bin", "source").agg(F.count("*").alias("n")))
    weights = cut(facts.select("source").distinct().withColumn("weight", F.lit(1.0)))
    near = F.when(F.col("field").isin(*FIELDS), F.array(*(F.col("bin") + i for i in (-1, 0, 1)))).otherwise(F.array("bin"))
    # where all claims lie in one bin nothing depends on the weights: they only count as claims that are fully backed
    spread = facts.groupBy(*group).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    split = cut(facts.join(spread, group).select(*facts.columns, (F.col("_lo") < F.col("_hi")).alias("_open")))
    calm = cut(split.where("NOT _open").groupBy("source").agg(F.sum("n").alias("calm")))
    facts = cut(split.where("_open").drop("_open"))
    total = cut(facts.groupBy(*group, "source").agg(F.sum("n").alias("n")))

    def backed(w: DataFrame) -> DataFrame:
        own = facts.join(w, "source").groupBy(*group, "bin").agg(F.sum(F.col("weight") * F.col("n")).alias("vote"))
        window = own.select(*group, F.explode(near).alias("bin"), "vote").groupBy(*group, "bin").agg(F.sum("vote").alias("vote"))
        every = total.join(w, "source").groupBy(*group).agg(F.sum(F.col("weight") * F.col("n")).alias("all"))
        return window.join(every, group).select(*group, "bin", (F.col("vote") / F.col("all")).alias("support"))

    step, before = 1.0, float("inf")
    for _ in range(most):
        support = backed(weights)
        missed = facts.join(support, [*group, "bin"]).groupBy("source").agg(F.sum((1 - F.col("support")) * F.col("n")).alias("missed"), F.sum("n").alias("claims"))
        every = weights.join(missed, "source", "left").join(calm, "source", "left").na.fill(0, ["missed", "claims", "calm"])
        every = every.withColumn("error", (F.col("missed") + 0.5) / (F.col("claims") + F.col("calm") + 1))
        new = cut(every.select("source", (F.col("weight") + step * (F.greatest(-F.log("error"), F.lit(0.05)) - F.col("weight"))).alias("weight"), F.col("weight").alias("old")))
        moved = new.agg(F.max(F.abs(F.col("weight") - F.col("old")))).first()[0]
        weights = new.drop("old")
        if moved is None or moved < settled:
            break
        step, before = step / 2 if moved > 0.9 * before else step, moved
    else:
        raise RuntimeError(f"source weights still move by {moved} after {most} rounds")
    # of the best backed values the one with most votes of its own, then the larger
    own = long.groupBy(*group, "bin", "value", "source").agg(F.count("*").alias("n")).join(weights, "source").groupBy(*group, "bin", "value").agg(F.sum(F.col("weight") * F.col("n")).alias("vote"))
    order = F.struct(F.round("support", 9), F.round("vote", 9), F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)), "value")
    best = own.join(backed(weights), [*group, "bin"], "left").withColumn("support", F.coalesce("support", F.lit(1.0))).groupBy(*group).agg(F.max_by(F.struct("value", "support"), order).alias("b"))
    return best.select(*group, "b.value", "b.support")


def survivors(df: DataFrame) -> DataFrame:
    """One row per (gvkey, fyear): the surviving record's id and codes, each field's value with the highest support
    over the group's records (codes as ``<code>_voted``) and that support, and the number of records. Groups of one record survive as they are;
    a field that no record of the group fills stays null. Exact copies count once."""
    recs = cut(records(df))
    # one aggregate, combined before the shuffle, so no group, however large, is sorted in one task
    first = F.struct("preference", F.coalesce("at", F.lit(float("-inf"))), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")), -F.col("record_id"))
    best = (
        recs.groupBy("gvkey", "fyear")
        .agg(F.count_distinct("record_id").alias("n_records"), F.max_by(F.struct("record_id", *CODES, "preference"), first).alias("b"))
        .select("gvkey", "fyear", "n_records", "b.*")
    )
    t = truth(recs).groupBy("gvkey", "fyear")
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    values = t.agg(
        *(x for f in FIELDS for x in (pick(f, "value").cast("double").alias(f), pick(f, "support").alias(f"{f}_support"))),
        *(x for f in CODES for x in (pick(f, "value").alias(f"{f}_voted"), pick(f, "support").alias(f"{f}_support"))),
    )
    return best.join(values, ["gvkey", "fyear"], "left")
