"""Evaluation texts leaking into training text (problem 9).

Prefix-filtered set join. Items and documents become sequences of words (case, punctuation and spacing dropped) and
of word shingles. Shingles are ordered by rarity in the corpus. A leaked stretch is at least ``window`` words of an
item with about one word in eight changed, so of the window's shingles some ``least`` survive; by the prefix
principle one of its ``n - least + 1`` rarest must occur in the document, so only those are joined. The
positions of the shared shingles give the window of the document to look at (positional bound) and how much of it
can match (length bound); an exact alignment of item and window then decides: it must be long enough, hold the
item's words in order, and hold its facts (the words that other items don't share, such as names and figures),
for a text that only follows the item's wording with other facts is no leak. A stretch with hardly a fact must stand
there word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.session import cut

WORD = r"[\p{L}\p{M}\p{N}]+"


def _words(text: str):
    """Words in lower case; a comma between digits is no boundary, each sign of a script without blanks is a word."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"(?<=\d),(?=\d)", "")
    return F.regexp_extract_all(plain, F.lit(r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}]|[\p{L}\p{M}\p{N}&&[^\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}]]+"), F.lit(0))


def _shingles(df: DataFrame, *keep: str, n: int) -> DataFrame:
    """``keep``, position and hash of every ``n``-word shingle of the array ``w``."""
    m = F.size("w") - (n - 1)
    parts = [F.slice("w", F.lit(i + 1), F.greatest(m, F.lit(0))).alias(f"s{i}") for i in range(n)]
    z = df.where(m > 0).select(*keep, *parts).select(*keep, F.posexplode(F.arrays_zip(*[f"s{i}" for i in range(n)])).alias("pos", "s"))
    return z.select(*keep, "pos", F.xxhash64(*[F.col("s")[f"s{i}"] for i in range(n)]).alias("h"))


def longest_stretch(item: list[str], doc: list[str], penalty: float = 2.0) -> tuple[int, int, int]:
    """Best local alignment of the two word sequences (match 1, changed, added or dropped word ``-penalty``):
    first word of the item and first after, words matched."""
    best, m = (0.0, 0, 0, 0), len(doc)
    score, start, hits = [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i, a in enumerate(item):
        diag_s, diag_b, diag_h = 0.0, i, 0
        row_s, row_b, row_h = 0.0, i + 1, 0
        for j in range(m):
            up_s, up_b, up_h = score[j + 1], start[j + 1], hits[j + 1]
            if a == doc[j]:
                s, b, h = (diag_s + 1, diag_b, diag_h + 1) if diag_s > 0 else (1.0, i, 1)
            else:
                s, b, h = diag_s - penalty, diag_b, diag_h
            if up_s - penalty > s:
                s, b, h = up_s - penalty, up_b, up_h
            if row_s - penalty > s:
                s, b, h = row_s - penalty, row_b, row_h
            if s <= 0:
                s, b, h = 0.0, i + 1, 0
            diag_s, diag_b, diag_h = up_s, up_b, up_h
            score[j + 1], start[j + 1], hits[j + 1] = s, b, h
            row_s, row_b, row_h = s, b, h
            if s > best[0]:
                best = (s, i + 1 - b, h, i + 1)
    return best[3] - best[1], best[3], best[2]


def common_words(item: list[str], doc: list[str]) -> int:
    """Words that the two sequences have in common, in order."""
    row = [0] * (len(doc) + 1)
    for a in item:
        diag = 0
        for j, b in enumerate(doc):
            diag, row[j + 1] = row[j + 1], diag + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def verbatim(item: list[str], doc: list[str], least: int) -> int:
    """Words of the longest stretch of the item that stands unchanged in ``doc``; 0 below ``least``."""
    have = {tuple(doc[j : j + least]) for j in range(len(doc) - least + 1)}
    if not any(tuple(item[i : i + least]) in have for i in range(len(item) - least + 1)):
        return 0
    return SequenceMatcher(None, item, doc, autojunk=False).find_longest_match().size


def _short_hits(docs: DataFrame, items: DataFrame, below: int) -> DataFrame:
    """``(doc, item, n_words, n_matched)`` for items of fewer than ``below`` words: too short to lose a word, they leak
    only whole. Their word sequences are compared by hash, one shingle length after the other."""
    short = cut(items.withColumn("n", F.size("w")).where(F.col("n").between(1, below - 1)))
    out = None
    for n in sorted(r[0] for r in short.select("n").distinct().collect()):  # fewer than ``below`` lengths
        mine = short.where(F.col("n") == n).select("item", F.xxhash64(*(F.col("w")[i] for i in range(n))).alias("h"))
        hit = _shingles(docs, "doc", n=n).select("doc", "h").join(mine, "h").select("doc", "item", F.lit(n).alias("n_words"), F.lit(n).alias("n_matched")).distinct()
        out = hit if out is None else out.unionByName(hit)
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = 3, window: int = 15, least: int = 4, span: int = 14, matched: float = 0.78, facts: float = 0.5, common: float = 0.01, per_row: int = 256) -> DataFrame:
    """``(doc, item, n_words, n_matched)`` for each document and each item it reproduces in full or in a stretch of
    ``window`` words or more.

    ``least``: shingles that survive in a leaked window (two to three changed words of fifteen), fewer in an item shorter
    than a window. An item of fewer than eight words leaks word for word. ``span`` and ``matched``: least
    words and least share of matched words of the aligned stretch (its outermost words may be changed ones, which
    no alignment shows). ``facts``: least share of the stretch's fact words that are matched; a word is a fact of an item
    if no other item holds it, or at most the share ``common`` of those that share the item's wording. ``per_row``: about
    how many candidate items of a document are checked in one row; a document with more takes several rows. Null and
    empty texts leak nothing; copies give their pairs once; one text under several ids gives each of them.
    """
    iw = cut(items.where(F.col(text).isNotNull()).select(F.col(item_key).alias("item"), _words(text).alias("w")).distinct())
    dw = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text).alias("text"))
    words = dw.select("doc", _words("text").alias("w"))
    long = iw.where(F.size("w") >= 8)
    ish = cut(_shingles(long, "item", n=n).withColumnRenamed("pos", "ipos"))
    # one text under several ids is one item here, or none of its words would be its own
    one = iw.select("item", "w", F.xxhash64("w").alias("t"))
    held_by = one.select("t", F.explode(F.array_distinct("w")).alias("x")).groupBy("x").agg(F.count_distinct("t").alias("k"))
    siblings = ish.join(one.select("item", "t"), "item").groupBy("h").agg(F.count_distinct("t").alias("m"))
    wording = ish.join(siblings, "h").groupBy("item").agg(F.max("m").alias("m"))
    fact = cut(
        long.join(wording, "item").select("item", "m", F.explode(F.array_distinct("w")).alias("x")).join(held_by, "x")
        .where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("m") * common))).groupBy("item").agg(F.collect_set("x").alias("facts"))
    )
    # shingles that must survive: each of the one in eight changed words costs n of them
    size = window - n + 1
    many = long.select("item", F.size("w").alias("_l")).select("item", F.least(F.lit(least), F.greatest(F.lit(1), F.col("_l") - (n - 1) - n * F.ceil(F.col("_l") / 8))).cast("int").alias("least"))
    dsh = _shingles(words, "doc", n=n)
    wanted = ish.select("h").distinct()
    # only shingles of items are kept of the corpus; this is also what rarity is counted from
    hit = cut(dsh.join(wanted, "h", "left_semi").distinct())
    rarity = hit.groupBy("h").agg(F.count_distinct("doc").alias("df"))
    # prefix: of each window of the item, the rarest n_shingles - least + 1
    windows = F.explode(F.sequence(F.greatest(F.col("ipos") - (size - 1), F.lit(0)), F.col("ipos"))).alias("win")
    at = ish.join(rarity, "h").select("item", "ipos", "h", "df", windows)
    every = ish.select("item", "ipos", windows).groupBy("item", "win").agg(F.count("*").alias("all"))
    order = F.row_number().over(W.partitionBy("item", "win").orderBy("df", "ipos"))  # a window's shingles
    seen = F.count("*").over(W.partitionBy("item", "win"))
    prefix = (
        at.withColumn("_r", order).withColumn("_n", seen).join(every, ["item", "win"]).join(many, "item")
        # shingles that no document holds are the rarest of all and fill the prefix first
        .where(F.col("_r") + F.col("all") - F.col("_n") <= F.greatest(F.col("all") - (F.col("least") - 1), F.lit(1)))
        .select("item", "ipos", "h").distinct()
    )
    pair = cut(hit.join(prefix, "h").select("doc", "item").distinct())
    # positional and length bounds: all shared shingles of a candidate pair lie on its diagonals. The pairs come first:
    # a shingle that many items share with many documents is only looked at where it can decide
    shared = pair.join(ish, "item").join(hit, ["doc", "h"])
    cand = (
        shared.withColumn("block", F.floor((F.col("pos") - F.col("ipos")) / 16))
        .select("doc", "item", "pos", "ipos", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"))
        .groupBy("doc", "item", "block").agg(F.count_distinct("ipos").alias("c"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        .join(many, "item").where(F.col("c") >= F.col("least"))
    )
    spans = cut(cand.groupBy("doc", "item").agg(F.collect_set(F.struct("lo", "hi")).alias("at")))
    # a document may hold a whole benchmark: its items are spread over rows of bounded size
    load = spans.groupBy("doc").agg(F.ceil(F.count("*") / per_row).alias("_m"))
    near = spans.join(load, "doc").withColumn("_s", F.pmod(F.xxhash64("item"), F.col("_m"))).groupBy("doc", "_s").agg(F.collect_list(F.struct("item", "at")).alias("c"))
    # inside the lambda the words of the document are a value: they are made once for all its windows
    cut_out = lambda w: F.transform("c", lambda x: F.struct(x["item"].alias("item"), F.transform(x["at"], lambda s: F.slice(w, F.greatest(s["lo"] - 3, F.lit(0)) + 1, s["hi"] - s["lo"] + n + 6)).alias("parts")))
    parts = dw.join(near, "doc").select("doc", F.explode(F.flatten(F.transform(F.array(_words("text")), cut_out))).alias("c")).select("doc", "c.item", "c.parts")
    full = parts.join(iw, "item").join(fact, "item", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {"doc": [], "item": [], "n_words": [], "n_matched": []}
            for d, i, parts, w, fs in zip(*(b.column(c).to_pylist() for c in ("doc", "item", "parts", "w", "facts"))):
                fs, best = set(fs), (0, 0)
                whole = f" {' '.join(w)} "
                if any(whole in f" {' '.join(p)} " for p in parts):
                    best, parts = (len(w), len(w)), []
                for p in parts:
                    held = fs & set(p)
                    if len(held) < 2 and len(held) < len(fs):
                        # too few facts to tell a changed quote from other facts in the same wording: only word for word
                        run = verbatim(w, p, min(window, len(w)))
                        best = max(best, (run, run))
                    elif len(w) < window:
                        # an item shorter than a window leaks whole, but for about one word in eight
                        m = common_words(w, p)
                        if m >= len(w) - max(1, round(len(w) / 8)) and len(held) >= facts * len(fs):
                            best = max(best, (len(w), m))
                    else:
                        lo, hi, m = longest_stretch(w, p)
                        own = fs & set(w[lo:hi])
                        if hi - lo >= span and m >= matched * (hi - lo) and len(own & held) >= facts * len(own):
                            best = max(best, (hi - lo, m))
                if best[0]:
                    for k, v in zip(out, (d, i, *best)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc", kinds[0]), ("item", kinds[1]), ("n_words", pa.int32()), ("n_matched", pa.int32())]))

    kd, ki = docs.schema[doc_key].dataType, items.schema[item_key].dataType
    kinds = (to_arrow_type(kd), to_arrow_type(ki))
    out = full.select("doc", "item", "parts", "w", "facts").mapInArrow(verify, f"doc {kd.simpleString()}, item {ki.simpleString()}, n_words int, n_matched int")
    short = _short_hits(words, iw, 8)
    out = out if short is None else out.unionByName(short)
    return out.withColumnsRenamed({"doc": doc_key, "item": item_key}).distinct()
