"""Garbled text from wrong character encoding (problem 10).

Every distinct word of the corpus (runs of signs beyond ASCII, and words that hold such signs) is garbled under all
encoding chains; the forms that pass a bitmap of the words' hashes are hash-joined with the words that occur. A word is garbled if it is such a form of a
word that the corpus holds in more texts (copies of the garbled count once), or an unmistakable form of a word that it holds at all,
and is replaced by that verified original. U+FFFD marks what a decoder could
not read: garbled, and restored only where a chain still tells the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

# --- fixed values: encodings a text may be stored in, and read as ---
STORED = "utf-8 cp1252 latin-1 cp1250 cp1251 koi8-r cp866 iso8859-15 iso8859-2 mac-roman cp437 cp850 mac-cyrillic iso8859-5 cp932 euc-jp gbk big5 euc-kr".split()
READ_AS = "cp1252 latin-1 mac-roman cp437 cp850 cp1250 cp1251 cp1253 cp1254 iso8859-2 iso8859-15 koi8-r cp866 mac-cyrillic iso8859-5 gbk big5 cp932 euc-kr euc-jp".split()
TWICE = "cp1252 latin-1 mac-roman cp437 cp850 cp1250 cp1251".split()
WORD = r"[A-Za-z\x{80}-\x{10FFFF}]*[\x{80}-\x{10FFFF}][A-Za-z\x{80}-\x{10FFFF}]*"
RUN = r"[\x{80}-\x{10FFFF}]+"
CJK = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
FOREIGN = r"[\x{80}-\x{2E7F}\x{FB00}-\x{FDFF}\x{FFF0}-\x{10FFFF}]{4,}"

_RUN = re.compile("[^\x00-\x7f]+")
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_CJK = re.compile("[⺀-鿿가-힯＀-￯]")
_MULTI = {"gbk", "big5", "cp932", "euc-kr", "euc-jp"}


def _table(enc: str) -> dict[int, str]:
    """A single-byte encoding as readers apply it: bytes it leaves undefined become control characters."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_READ = {e: _table(e) for e in READ_AS if e not in _MULTI}
_STRICT = {e: "".join(t[b] for b in range(256)) for e, t in _READ.items()}


def _read(raw: bytes, enc: str) -> str | None:
    if enc in _MULTI:
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            return None
    return raw.decode("latin-1").translate(_READ[enc])


def garbled_forms(word: str) -> Iterator[tuple[str, str]]:
    """(form, chain) of ``word`` under every chain that changes it."""
    seen = set()
    for a in STORED:
        try:
            raw = word.encode(a)
        except UnicodeEncodeError:
            continue
        if raw in seen:
            continue
        seen.add(raw)
        for b in READ_AS:
            g = _read(raw, b) if b != a else None
            if g and g != word:
                yield g, f"{a}>{b}"
    raw = word.encode("utf-8", "ignore")
    for b, c in product(TWICE, TWICE):
        yield _read(_read(raw, b).encode("utf-8"), c), f"utf-8>{b}>utf-8>{c}"


def document_tokens(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """``(key, *more, token)``: the distinct words of each text with signs beyond ASCII. Words are runs of such signs, with
    and without the letters around them. Scripts without blanks have no words to compare, so the signs of their
    runs count singly and in pairs, and the runs that could be their garbled forms in pieces as long as those."""
    t = F.col(text)
    every = lambda pat: F.regexp_extract_all(t, F.lit(pat), F.lit(0))

    def pieces(runs, n: int):
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, n))))

    long = lambda runs, n: F.filter(runs, lambda r: F.length(r) >= n)
    foreign = F.filter(every(FOREIGN), lambda r: r.rlike(r"[^\p{L}\p{M}]|\p{IsLatin}"))
    cjk = every(CJK + "+")
    parts = [every(WORD), every(RUN), pieces(cjk, 1), pieces(long(cjk, 2), 2), pieces(foreign, 4), pieces(long(foreign, 6), 6)]
    return df.where(t.rlike(RUN)).select(key, *more, F.explode(F.array_distinct(F.concat(*parts))).alias("token"))


# bits of the filter that tells which forms occur at all: 8 MB whatever the corpus
FILTER_BITS = 26


def word_filter(counts: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of ``counts.token``, of fixed size. A form whose bit is not set stands nowhere in the corpus;
    one whose bit is set goes on to the join, so a full filter costs time and no result."""
    at = F.pmod(F.xxhash64("token"), F.lit(1 << FILTER_BITS))
    parts = counts.groupBy(F.shiftright(at, 15).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.collect():  # at most 2 ** 11 rows of 4 KB
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def garbled_tokens(tokens: DataFrame) -> DataFrame:
    """``(token, original, chain, weak)``: the tokens that are garbled forms of more frequent ones, or unmistakable
    ones of any. ``tokens`` has one row for a token of a different text, with the number of ``copies`` of the text;
    copies count for an original, but not for what may be its garbled form. ``original`` is
    null for a token with U+FFFD that no chain explains and for a form that spreads over several tokens. ``weak``
    forms are too short to prove anything by themselves; they hold where the same chain is proven nearby."""

    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("n"), F.sum("copies").alias("n_copies")))
    bits = counts.sparkSession.sparkContext.broadcast(word_filter(counts))  # of fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, mask = bits.value, (1 << FILTER_BITS) - 1
        for b in it:
            rows: dict[str, list] = {k: [] for k in ("form", "original", "chain", "longer", "weak", "sure", "n_original")}
            for w, n in zip(b.column("token").to_pylist(), b.column("n_copies").to_pylist()):
                cjk = bool(_CJK.search(w))
                if cjk and not _RUN.fullmatch(w) or "�" in w:
                    continue
                done = set()
                for g, chain in garbled_forms(w):
                    short = not cjk and len(g) < 3
                    if (g, chain if short else "") in done:
                        continue
                    done.add((g, chain if short else ""))
                    whole = bool(_WORD.fullmatch(g))
                    for f in [g] if whole else [x for x in _WORD.findall(g) if sum(c > "\x7f" for c in x) >= 3]:
                        h = xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass"), 42) & mask
                        if not there[h >> 3] >> (h & 7) & 1:
                            continue  # no text holds this form
                        beyond = sum(c > "\x7f" for c in f)
                        longer = (len(f) > len(w) or not whole) and beyond >= 2
                        if cjk and len(f) < (6 if len(w) == 1 else 4):
                            continue  # too short to tell from a clean word
                        # letters alone, and two of them only, could be a sound word (Её is also Ÿ in UTF-8 read as cp1251)
                        sure = longer and (beyond >= 3 or any(c > "\x7f" and (not c.isalpha() or c in "ªºµ") for c in f))
                        for k, v in zip(rows, (f, w if whole else None, chain, longer, not longer and len(f) < 3, sure, n)):
                            rows[k].append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    # few distinct words are much work: all cores share them
    cores = counts.sparkSession.sparkContext.defaultParallelism
    forms = counts.repartition(max(cores, counts.rdd.getNumPartitions()), "token").mapInArrow(run, "form string, original string, chain string, longer boolean, weak boolean, sure boolean, n_original long")
    hit = cut(forms.join(counts, forms.form == counts.token).where(F.col("sure") | F.when(F.col("longer") | F.col("weak"), F.col("n_original") >= F.col("n")).otherwise(F.col("n_original") > 3 * F.col("n"))))
    # a word garbled twice is also a form of the word garbled once, which may stand in more texts than the sound one
    unsound = hit.where("sure").select(F.col("token").alias("original")).distinct().withColumn("_bad", F.lit(True))
    best = hit.where("NOT weak").join(unsound, "original", "left").groupBy("token").agg(F.max(F.struct(F.col("original").isNotNull().alias("o"), F.col("_bad").isNull().alias("sound"), "n_original", "original", "chain")).alias("b"))
    weak = hit.where("weak").groupBy("token", "chain").agg(F.max_by("original", F.struct("n_original", "original")).alias("original"))
    lost = counts.where(F.col("token").contains("�")).select("token", F.lit(None).cast("string").alias("original"), F.lit("lost").alias("chain"))
    strong = best.select("token", "b.original", "b.chain").unionByName(lost).withColumn("weak", F.lit(False))
    return strong.unionByName(weak.select("token", "original", "chain", F.lit(True).alias("weak")))


def garbled_documents(df: DataFrame, key: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """``(key, token, original, chain)`` for each garbled token of each document; with ``short`` also the tokens of one
    or two signs, where a longer one of the document proves their chain. Null and ASCII texts give no row; copies of
    a document give its rows once each."""
    # forms are counted over different texts: the copies of a garbled text prove nothing
    ids = df.where(F.col(text).rlike(RUN)).select(key, F.xxhash64(text).alias("_text"), F.col(text).alias("_t"))
    texts = ids.groupBy("_text").agg(F.first("_t").alias("_t"), F.count_distinct(key).alias("copies"))
    counted = document_tokens(texts, "_text", "_t", "copies")
    bad, tokens = cut(garbled_tokens(counted)), counted.drop("copies")
    found = cut(tokens.join(bad.where("NOT weak"), "token").select("_text", "token", "original", "chain"))
    if short:
        near = tokens.join(bad.where("weak"), "token").join(found.select("_text", "chain").distinct(), ["_text", "chain"], "left_semi")
        near = near.groupBy("_text", "token").agg(F.min(F.struct("chain", "original")).alias("b")).select("_text", "token", "b.original", "b.chain")
        found = found.unionByName(near.join(found.select("_text", "token"), ["_text", "token"], "left_anti"))
    return ids.drop("_t").join(found, "_text").select(key, "token", "original", "chain")


def restore(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``restored_text`` (garbled words replaced by their verified originals, longest first),
    ``is_garbled`` and ``n_unrestored`` (garbled words without a verified original)."""
    bad = garbled_documents(df, key, text, short=True).distinct().groupBy(key).agg(
        F.collect_list(F.when(F.col("original").isNotNull(), F.struct("token", "original"))).alias("_fix"),
        F.sum(F.col("original").isNull().cast("int")).alias("_lost"),
    )

    @F.pandas_udf("string")
    def apply(texts, fixes):
        import pandas as pd

        def one(t, fix):
            if t is None or fix is None or not len(fix):
                return t
            m = {f["token"]: f["original"] for f in fix}
            # what is no longer than its original could stand within a sound word: only whole words of it are replaced
            edge = lambda x: re.escape(x) if len(x) > len(m[x]) else f"(?<![A-Za-z\x80-\U0010ffff]){re.escape(x)}(?![A-Za-z\x80-\U0010ffff])"
            pat = re.compile("|".join(edge(x) for x in sorted(m, key=len, reverse=True)))
            return pat.sub(lambda x: m[x.group()], t)

        return pd.Series([one(t, f) for t, f in zip(texts, fixes)])

    out = df.join(bad, key, "left")
    return out.select(
        *df.columns,
        F.when(F.col("_lost").isNull(), F.col(text)).otherwise(apply(F.col(text), F.col("_fix"))).alias("restored_text"),
        F.col("_lost").isNotNull().alias("is_garbled"),
        F.coalesce("_lost", F.lit(0)).alias("n_unrestored"),
    )
