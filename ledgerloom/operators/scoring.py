"""Scoring sentences behind a content-addressed cache with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import best_label, text_hash
from ledgerloom.session import cut

TONE = [("pos", "positive"), ("neu", "neutral"), ("neg", "negative")]
OUTLOOK = [("p_specific", "specific"), ("p_nonspecific", "nonspecific"), ("p_not", "not")]

# --- fixed values: words of the stand-in scorer (the models of the original need libraries that are absent here) ---
POSITIVE = "improved grew rose expanded stronger recover profit gain gains benefit".split()
NEGATIVE = "fell weaker decline loss delayed fails failure penalties volatile muted uneven".split()


def lexicon_tone(c: Column) -> tuple[Column, Column, Column]:
    """(pos, neu, neg) from word counts: a deterministic stand-in behind the model's interface."""
    words = F.split(F.lower(c), "[^a-z]+")
    n = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws))).cast("double")
    pos, neg = n(POSITIVE), n(NEGATIVE)
    total = pos + neg + 1.0
    return pos / total, F.lit(1.0) / total, neg / total


# --- fixed values: words of the stand-in for the forward-looking scorer ---
AHEAD = "will shall expect expects anticipate anticipates plan plans intend intends may might could should would believe estimate estimates target forecast outlook".split()


def lexicon_outlook(c: Column) -> tuple[Column, Column, Column]:
    """(p_specific, p_nonspecific, p_not): words that look ahead, with figures or without them; a deterministic
    stand-in behind the model's interface."""
    words = F.split(F.lower(c), "[^a-z]+")
    ahead = F.size(F.filter(words, lambda w: w.isin(*AHEAD))).cast("double")
    figures = F.regexp_count(c, F.lit("[0-9]+")).cast("double")
    look = ahead / (ahead + 1.0)
    share = figures / (figures + 1.0)
    return look * share, look * (1 - share), 1 - look


_MODELS: dict = {}


def split_hits(sentences: DataFrame, cache: DataFrame, text: str = "sentence") -> tuple[DataFrame, DataFrame]:
    """Sentences with cached scores, and the distinct sentences the cache lacks. Copies are scored once."""
    s = sentences.withColumn("hash", text_hash(F.col(text)))
    return s.join(cache, "hash"), s.join(cache.select("hash"), "hash", "left_anti").select("hash", text).dropDuplicates(["hash"])


def score_missing(misses: DataFrame, load: Callable[[], Callable[[list[str]], list[dict]]], columns: list[str], text: str = "sentence", batch: int = 32) -> DataFrame:
    """Scores of a model over the misses. ``load`` returns the scorer of a batch; it runs once per worker process,
    whatever number of tasks that process gets (functions of one module and name are one loader)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = (load.__module__, load.__qualname__, getattr(load, "__code__", None))
        model = _MODELS[name] if name in _MODELS else _MODELS.setdefault(name, load())
        for pdf in it:
            rows = []
            for i in range(0, len(pdf), batch):
                rows += model(pdf[text].iloc[i : i + batch].tolist())
            yield pd.DataFrame({"hash": pdf["hash"].to_numpy(), **{c: [r[c] for r in rows] for c in columns}})

    return misses.mapInPandas(run, "hash string, " + ", ".join(f"{c} double" for c in columns))


def with_labels(scored: DataFrame, labels: list[tuple[str, str]], fallback: str) -> DataFrame:
    """Missing scores become the fallback class with certainty; then label and confidence."""
    full = scored.withColumns({c: F.coalesce(c, F.lit(1.0 if c == fallback else 0.0)) for c, _ in labels})
    label, top = best_label(labels)
    return full.withColumns({"label": label, "confidence": top})


def append_cache(scores: DataFrame, path: str) -> None:
    """Add scores to a parquet cache; what is there already is not written again. The new rows are checkpointed before the
    cache is touched, so a job that fails half way and runs again adds the rest only."""
    try:
        have = scores.sparkSession.read.parquet(path).select("hash")
        scores = scores.join(have, "hash", "left_anti")
    except AnalysisException as e:  # first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    cut(scores.dropDuplicates(["hash"])).write.mode("append").parquet(path)


def dimension_features(filings: DataFrame, totals: DataFrame, scored: DataFrame, item: str, items: tuple[str, ...] = ("item_1", "item_1a", "item_7"), floor: int = 25) -> DataFrame:
    """Per filing: sentences and dictionary sentences of ``item``, whether it and all items were parsed, the share
    and its mention flag (null if the item was not parsed), net tone (null without sentences). Every filing keeps a row."""
    t = totals.groupBy("accession_number").pivot("item", list(items)).agg(F.first("n_sentences"))
    s = scored.where(F.col("item") == item).groupBy("accession_number").agg(F.count("*").alias("n_ai"), (F.sum("pos") - F.sum("neg")).alias("_tone"))
    j = filings.join(t, "accession_number", "left").join(s, "accession_number", "left").na.fill(0, [*items, "n_ai"])
    parsed = F.col(item) >= floor
    complete = F.least(*(F.col(i) for i in items)) >= floor
    share = F.when(parsed, F.col("n_ai") / F.nullif(F.col(item), F.lit(0)))
    return j.select(
        *filings.columns, complete.cast("int").alias("parse_complete"), parsed.cast("int").alias("item_parsed"), F.col("n_ai").alias("n_ai_sentences"), F.col(item).alias("n_total_sentences"),
        F.when(parsed, (F.col("n_ai") > 0).cast("double")).alias("has_ai_mention"), share.alias("ai_sentence_share"), F.when(parsed & (F.col("n_ai") > 0), F.col("_tone") / F.col("n_ai")).alias("net_tone"),
    )
