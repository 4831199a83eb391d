"""From indicator columns to a ranked composite: composing, treating, normalising, weighting, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut

# --- fixed values ---
DIMENSIONS = {
    "strategy": ("ai_sentence_share", "net_tone"), "operations": ("ai_sentence_share", "net_tone"), "governance": ("ai_sentence_share", "fls_score"),
    "technology": ("ai_publication_share", "ai_patent_share"), "people": ("tech_team1_worker_share", "ai_worker_share"),
}
SKEW_LIMIT, KURTOSIS_LIMIT, GEOMETRIC_FLOOR = 2.0, 3.5, 0.01


def number(name: str) -> Column:
    """The column as a double with NaN as null."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def compose(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Left joins of all indicator tables to the base, their columns prefixed ``<indicator>__``."""
    for name, p in parts.items():
        if p.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: {key} is not unique")
    named = [p.select(key, *(F.col(c).alias(f"{n}__{c}") for c in p.columns if c != key)) for n, p in sorted(parts.items())]
    return reduce(lambda a, b: a.join(b, key, "left"), named, base)


def sqrt_skewed(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Square roots of the columns that pass both limits, and which those are. A negative value raises."""
    bad = [r["column"] for r in moments(df, cols).where("flag").collect()]  # one row per column
    for c in bad:
        x = number(c)
        df = df.withColumn(c, F.when(x < 0, F.raise_error(F.lit(f"{c} has negative values")).cast("double")).otherwise(F.sqrt(x)))
    return df, bad


def normalised(df: DataFrame, cols: list[str], how: str) -> DataFrame:
    """``zscore``, ``minmax`` or ``rankscore`` of the columns. A column without spread (or, for ranks, with at most
    one value) becomes 0 on every row, nulls included; otherwise nulls stay. Flags stay as they are."""
    kinds = dict(df.dtypes)
    binary = [c for c in cols if c.endswith("_flag")]
    other = df.agg(*(F.count_if(~number(c).isin(0.0, 1.0)).alias(c) for c in binary)).first() if binary else {}
    cols = [c for c in cols if not is_passthrough(c, kinds[c], c in binary and not other[c])]
    if not cols:
        return df
    if how == "rankscore":
        return _rankscores(df, cols)
    stats = df.agg(*(f(number(c)).alias(f"_{n}_{c}") for c in cols for n, f in ((("avg", F.avg), ("sd", F.stddev_samp)) if how == "zscore" else (("lo", F.min), ("hi", F.max)))))
    j = df.crossJoin(F.broadcast(stats))  # one row
    out = {}
    for c in cols:
        if how == "zscore":
            mid, spread = F.col(f"_avg_{c}"), F.col(f"_sd_{c}")
        else:
            mid, spread = F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        flat = spread.isNull() | F.isnan(spread) | (spread == 0)
        out[c] = F.when(flat, 0.0).otherwise((number(c) - mid) / F.when(~flat, spread))
    return j.withColumns(out).select(*df.columns)


def counted_before(per: DataFrame, value: str, n: str, descending: bool = False) -> DataFrame:
    """``per`` with ``before``, the sum of ``n`` over all smaller (or larger) values. Values are range-partitioned,
    each partition adds up its own, and the partitions' totals (one number each) give the offsets: no task sees all."""
    key = F.desc(value) if descending else F.asc(value)
    parts = cut(per.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    totals = parts.groupBy("_p").agg(F.sum(n).alias("_t")).withColumn("_one", F.lit(0))  # one row per partition
    offset = totals.select("_p", F.coalesce(F.sum("_t").over(W.partitionBy("_one").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.coalesce(F.sum(n).over(W.partitionBy("_p").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("before", own).join(F.broadcast(offset), "_p").withColumn("before", F.col("before") + F.col("_o")).drop("_p", "_o")


def melted(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(key, value)``: the values of all columns in long form, missing ones left out."""
    parts = F.array(*(F.struct(F.lit(c).alias("key"), number(c).alias("value")) for c in cols))
    return df.select(F.explode(parts).alias("p")).select("p.*").where("value IS NOT NULL")


def ordered(long: DataFrame) -> DataFrame:
    """``(key, value, k, before, n)`` of the distinct values of each key of ``long (key, value)``: how often a value
    occurs, how many smaller ones its key has, how many it has in all. One range-partitioned pass serves all keys, and
    equal values are counted before it, so no task holds a key."""
    per = long.groupBy("key", "value").agg(F.count("*").alias("k")).select(F.struct("key", "value").alias("_at"), "k")
    at = cut(counted_before(per, "_at", "k").select("_at.key", "_at.value", "k", "before"))
    return at.join(at.groupBy("key").agg(F.min("before").alias("_first"), F.sum("k").alias("n")), "key").select("key", "value", "k", (F.col("before") - F.col("_first")).alias("before"), "n")


def quantiles(long: DataFrame, probs: dict[str, float]) -> DataFrame:
    """``(key, <name> ...)``: exact quantiles of each key of ``long (key, value)``, interpolated between neighbours. Only the
    values on either side of a quantile's place are picked from the ordered ones."""
    places = [F.struct(F.lit(n).alias("name"), ((F.col("n") - 1) * p).alias("place")) for n, p in probs.items()]
    hit = ordered(long).select("key", "value", "k", "before", F.explode(F.array(*places)).alias("q"))
    lo, hi = F.floor("q.place"), F.ceil("q.place")
    covers = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("k"))
    hit = hit.where(covers(lo) | covers(hi))
    g = hit.groupBy("key", "q.name").agg(F.max(F.when(covers(lo), F.col("value"))).alias("lo"), F.max(F.when(covers(hi), F.col("value"))).alias("hi"), F.max(F.col("q.place") - lo).alias("f"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")
    return g.groupBy("key").agg(*(F.max(F.when(F.col("name") == n, value)).alias(n) for n in probs))


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """``(value, rank, n)`` of the column's distinct values: ties share the mean rank."""
    return ordered(melted(df, [c])).select("value", (F.col("before") + (F.col("k") + 1) / 2.0).alias("rank"), "n")


def _rankscores(df: DataFrame, cols: list[str]) -> DataFrame:
    """All columns are ranked in one pass; each then finds its values' ranks."""
    df = cut(df)
    at = cut(ordered(melted(df, cols)))
    sizes = {r["key"]: r["n"] for r in at.groupBy("key").agg(F.max("n").alias("n")).collect()}  # one row per column
    for c in cols:
        if sizes.get(c, 0) <= 1:
            df = df.withColumn(c, F.lit(0.0))
            continue
        r = at.where(F.col("key") == c).select(F.col("value").alias("_v"), ((F.col("before") + (F.col("k") - 1) / 2.0) / (F.col("n") - 1)).alias("_s"))
        names = df.columns
        df = df.join(r, number(c) == F.col("_v"), "left").select(*(F.col("_s").alias(c) if x == c else F.col(x) for x in names))
    return df


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: n, bias-corrected skewness and excess kurtosis, min, median, 97.5 % point, max, and whether
    both limits are passed. Skewness needs three values, kurtosis four; a constant column has neither."""
    long = melted(df, cols)
    r = long.groupBy("key").agg(F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"), F.min("value").alias("min"), F.max("value").alias("max"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "key string")
    q = quantiles(long, {"p50": 0.5, "p975": 0.975})
    r = F.broadcast(every).join(r, "key", "left").join(q, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n, flat = F.col("n").cast("double"), F.isnan("g1") | F.col("g1").isNull()
    skew = F.when(~flat & (n >= 3), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(~flat & (n >= 4), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return r.select(F.col("key").alias("column"), "n", skew.alias("skew"), kurt.alias("kurtosis"), F.coalesce((F.abs(skew) > SKEW_LIMIT) & (kurt > KURTOSIS_LIMIT), F.lit(False)).alias("flag"), "min", "p50", "p975", "max")


def dimension_score(values: list[Column], weights: list[Column] | None = None) -> tuple[Column, Column]:
    """(score, coverage) of a dimension: weighted mean of its indicators, and the weight there is of the weight there
    could be. A missing value weighs 0, an unspecified weight is 1."""
    w = [F.when(v.isNotNull(), F.coalesce(weights[i], F.lit(1.0)) if weights else F.lit(1.0)).otherwise(0.0) for i, v in enumerate(values)]
    total = reduce(lambda a, b: a + b, w)
    num = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) * x for v, x in zip(values, w)])
    return num / F.when(total > 0, total), total / float(len(values))


def linear_composite(scores: list[Column], weights: list[Column]) -> Column:
    """Weighted mean times 100; null if any weight is 0."""
    any_zero = reduce(lambda a, b: a | b, [(w == 0) | w.isNull() for w in weights])
    return F.when(~any_zero, reduce(lambda a, b: a + b, [s * w for s, w in zip(scores, weights)]) / reduce(lambda a, b: a + b, weights) * 100)


def geometric_composite(scores: list[Column], weights: list[Column], floor: float = GEOMETRIC_FLOOR) -> Column:
    """Weighted geometric mean times 100, scores floored; null if any weight is 0."""
    any_zero = reduce(lambda a, b: a | b, [(w == 0) | w.isNull() for w in weights])
    logs = reduce(lambda a, b: a + b, [F.log(F.greatest(s, F.lit(floor))) * w for s, w in zip(scores, weights)])
    return F.when(~any_zero, F.exp(logs / reduce(lambda a, b: a + b, weights)) * 100)


def competition_rank(df: DataFrame, c: str, out: str = "rank") -> DataFrame:
    """1, 1, 3 ...: largest first; missing values have no rank."""
    df = cut(df)
    per = df.select(number(c).alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("_k"))
    ranks = counted_before(per, "_v", "_k", descending=True).select("_v", (F.col("before") + 1).cast("int").alias(out))
    return df.join(ranks, number(c) == F.col("_v"), "left").drop("_v")


def is_passthrough(name: str, kind: str, binary: bool = False) -> bool:
    """Flags that normalising leaves alone: booleans, ``_flag`` columns of zeros and ones, ``has_`` features."""
    return kind == "boolean" or (name.endswith("_flag") and binary) or name.split("__")[-1].startswith("has_")


def rank_shift(df: DataFrame, key: str, main: str, variant: str) -> DataFrame:
    """How far a variant's ranking is from the main one: firms in both, Spearman correlation over them, mean and
    largest shift of average ranks (over all of each)."""
    df = cut(df.select(key, main, variant))
    a, b = (average_ranks(df.withColumn("_neg", -number(c)), "_neg").select(F.col("value").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}")) for i, c in enumerate((main, variant)))
    j = df.select(key, (-number(main)).alias("_m"), (-number(variant)).alias("_x")).where("_m IS NOT NULL AND _x IS NOT NULL").join(a, F.col("_m") == F.col("_v0")).join(b, F.col("_x") == F.col("_v1"))
    j = cut(j)
    shift = j.agg(F.count("*").alias("n_common"), F.avg(F.abs(F.col("_r0") - F.col("_r1"))).alias("mean_shift"), F.max(F.abs(F.col("_r0") - F.col("_r1"))).alias("max_shift"))
    r0, r1 = (average_ranks(j, f"_r{i}").select(F.col("value").alias(f"_q{i}"), F.col("rank").alias(f"_s{i}")) for i in (0, 1))
    rho = j.join(r0, F.col("_r0") == F.col("_q0")).join(r1, F.col("_r1") == F.col("_q1")).agg(F.corr("_s0", "_s1").alias("spearman"))
    return shift.crossJoin(rho).select(F.lit(variant).alias("variant"), "n_common", "spearman", "mean_shift", "max_shift")


# --- fixed values: columns beside the indicators that say how far a text indicator can be trusted ---
QA_COLUMNS = ("parse_complete", "item_parsed", "n_ai_sentences", "n_total_sentences", "has_ai_mention")


def qa_columns(dimension: str) -> list[str]:
    """Quality columns of a dimension in the composed matrix; only dimensions read from text have them."""
    return [f"{dimension}__{c}" for c in QA_COLUMNS] if set(DIMENSIONS[dimension]) & {"net_tone", "fls_score"} else []


def tone_reliability(n: Column, k: float | Column) -> Column:
    """Weight of a mean of ``n`` sentences: n / (n + k), k being the within to between variance; 0 without sentences."""
    m = F.coalesce(n.cast("double"), F.lit(0.0))
    return F.when(m > 0, m / (m + k)).otherwise(0.0)


def presence(value: Column) -> Column:
    """Weight of an indicator that is either there or not."""
    return value.isNotNull().cast("double")


def index_variant(df: DataFrame, key: str, dims: dict[str, list[str]], how: str = "minmax", aggregate: str = "linear", weights: dict[str, Column] | None = None) -> DataFrame:
    """``(key, index)`` of one way to build the index: normaliser, aggregation and reliability weights of indicators
    (presence only if none are given)."""
    cols = [c for cs in dims.values() for c in cs]
    extra = {f"_w_{c}": (weights or {}).get(c, F.lit(None).cast("double")) for c in cols}
    x = normalised(df.withColumns(extra), cols, how)
    scores, cover = zip(*(dimension_score([F.col(c) for c in cs], [F.col(f"_w_{c}") for c in cs]) for cs in dims.values()))
    w = [(c > 0).cast("double") for c in cover]
    return x.select(key, (geometric_composite if aggregate == "geometric" else linear_composite)(list(scores), w).alias("index"))


def sensitivity(main: DataFrame, variants: dict[str, DataFrame], key: str) -> DataFrame:
    """``rank_shift`` of every variant against the main index, both ``(key, index)``."""
    out = None
    for name, v in variants.items():
        j = main.select(key, F.col("index").alias("_main")).join(v.select(key, F.col("index").alias(name)), key, "full")
        r = rank_shift(j, key, "_main", name)
        out = r if out is None else out.unionByName(r)
    return out


def modeling_frame(index: DataFrame, scores: DataFrame, key: str = "normalized_company_name") -> DataFrame:
    """The index with an outside score per firm where there is one; the outside list must know a firm once."""
    if scores.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique in the scores")
    return index.join(scores, key, "left")
