"""Text cut off by field limits (problem 6), in pure SQL.

Every text is brought to lines (hard wraps joined; a paragraph, list line or table row is a line) and every line to
words, numbers being ``0`` and longer capitalised words ``Xx`` (names say nothing about where a text may stop, and
without them the trigrams of a corpus stay few). Counted over all different texts: how often a word trigram stands inside a
line and how often at the end of one, by the line's kind. The final trigram of each text is joined to these counts.
A text is cut if its final trigram is frequent inside but almost never terminal; where the trigram is too rare to
say, the final bigram decides, then the last word, then the last word's form. A final trigram that known trigrams
begin with, their last word being longer, is cut inside that word if the stump hardly ever stands inside a line; so is
one whose last word is seen nowhere else, in a place where the corpus has only known words. A sign left in place of the rest (…) is a cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

# --- fixed values: signs left in place of the rest ---
SIGNS = r"(…|\.\.\.|[\[(<]\s*(…|\.\.\.?|more|cont\.?|contd\.?|cont.d|continued|truncated|cut|snip)\s*[\])>]?|[-‐–—~\[(<])$"

TRIM = r"trim(BOTH ' \n\t\r' FROM text)"


def _words(text: str) -> str:
    """SQL for the lines of ``text`` in normal form."""
    return rf"""split(regexp_replace(regexp_replace(regexp_replace({text},
      '[0-9]+([.,:/][0-9]+)*', '0'),
      '(?<= )\\p{{Lu}}\\p{{Ll}}{{4,}}', 'Xx'),
      '([\\u3040-\\u30ff\\u3400-\\u9fff])', ' $1 '), '\\n(?=[\\s•])\\s*')"""


KIND = "CASE WHEN w[0] IN ('•', '-', '*', '–') THEN 'list' WHEN w[0] IN ('Signed', 'By') THEN w[0] ELSE 'text' END"


def trigram_counts_sql(src: str) -> str:
    """How often each word trigram stands inside a line and at its end; ``src`` has each text once."""
    return rf"""
WITH lines AS (
  SELECT split(trim(line), '[ \\n\\t\\r]+') AS w FROM (SELECT explode({_words(TRIM)}) AS line FROM {src} WHERE {TRIM} <> '')
), padded AS (
  SELECT {KIND} AS kind, concat(array('^', '^'), w) AS w, size(w) AS n FROM lines
), grams AS (
  SELECT kind, n, slice(w, 1, n) AS a, slice(w, 2, n) AS b, slice(w, 3, n) AS c FROM padded
)
SELECT kind, g.a AS a, g.b AS b, g.c AS c, sum(if(i < n - 1, 1, 0)) AS inside, sum(if(i < n - 1, 0, 1)) AS terminal
FROM (SELECT kind, n, posexplode(arrays_zip(a, b, c)) AS (i, g) FROM grams)
GROUP BY kind, g.a, g.b, g.c"""


def finals_sql(src: str) -> str:
    """The final trigram of each text: only its last paragraph is brought to words."""
    signs = SIGNS.replace("\\", "\\\\")
    tail = rf"substring_index({TRIM}, '\n\n', -1)"
    return rf"""
SELECT k, {KIND} AS kind, p[n - 1] AS a, p[n] AS b, p[n + 1] AS c, p[n + 1] RLIKE '{signs}' OR p[n + 1] RLIKE '^[\\[(]?(…|[.]{{3}})' AS sign
FROM (SELECT k, w, size(w) AS n, concat(array('^', '^'), w) AS p
  FROM (SELECT k, split(trim(element_at({_words(tail)}, -1)), '[ \\n\\t\\r]+') AS w FROM {src} WHERE {TRIM} <> ''))"""


def judge_sql(counts: str, finals: str, least: int = 25, share: float = 0.02, rare: int = 3) -> str:
    """``least``: occurrences from which a gram may decide; ``share``: terminal share below which it is called
    non-terminal; ``rare``: occurrences below which a word is unknown."""
    return rf"""
WITH wanted AS (
  SELECT DISTINCT kind, a, b, c FROM {finals}
), form AS (
  SELECT *, CASE WHEN c RLIKE '[\\p{{IsThai}}]$' THEN 'thai' WHEN c RLIKE '[\\p{{IsAlphabetic}}\\p{{M}}]$' THEN 'letter' WHEN c RLIKE '[0-9]$' THEN 'digit' ELSE right(c, 1) END AS f
  FROM {counts}
), uni AS (
  SELECT kind, c, f, sum(inside) AS inside, sum(terminal) AS terminal FROM form GROUP BY kind, c, f
), word AS (
  SELECT c, sum(inside + terminal) AS seen, sum(inside) AS within FROM uni GROUP BY c
), bi AS (
  SELECT kind, b, c, sum(inside) AS inside, sum(terminal) AS terminal FROM {counts} GROUP BY kind, b, c
), forms AS (
  SELECT kind, f, sum(inside) AS inside, sum(terminal) AS terminal, sum(if(w.seen < {rare}, inside + terminal, 0)) AS unknown
  FROM uni JOIN word w USING (c) GROUP BY kind, f
), place AS (
  SELECT kind, a, b, sum(inside + terminal) AS seen, sum(if(w.seen < {rare}, inside + terminal, 0)) AS unknown
  FROM {counts} JOIN word w USING (c) GROUP BY kind, a, b
), stem AS (
  SELECT w.kind, w.a, w.b, w.c, max(t.inside + t.terminal) AS whole
  FROM wanted w JOIN word ON w.c = word.c AND word.within <= 0.3 * word.seen JOIN {counts} t ON w.kind = t.kind AND w.a = t.a AND w.b = t.b AND left(w.c, 1) = left(t.c, 1)
  WHERE t.c <> w.c AND startswith(t.c, w.c) GROUP BY w.kind, w.a, w.b, w.c
), levels AS (
  SELECT w.kind, w.a, w.b, w.c, t.inside AS i3, t.terminal - 1 AS t3, bi.inside AS i2, bi.terminal - 1 AS t2, uni.inside AS i1, uni.terminal - 1 AS t1,
    fo.inside AS i0, fo.terminal AS t0, word.seen - 1 AS seen, fo.unknown / (fo.inside + fo.terminal) AS form_unknown, place.seen AS place_seen, place.unknown AS place_unknown, t.f, coalesce(stem.whole, 0) AS whole
  FROM wanted w
  JOIN form t ON w.kind = t.kind AND w.a = t.a AND w.b = t.b AND w.c = t.c
  JOIN bi ON w.kind = bi.kind AND w.b = bi.b AND w.c = bi.c
  JOIN uni ON w.kind = uni.kind AND w.c = uni.c
  JOIN word ON w.c = word.c
  JOIN forms fo ON w.kind = fo.kind AND t.f = fo.f
  JOIN place ON w.kind = place.kind AND w.a = place.a AND w.b = place.b
  LEFT JOIN stem ON w.kind = stem.kind AND w.a = stem.a AND w.b = stem.b AND w.c = stem.c
), judged AS (
  SELECT *, CASE WHEN whole >= {rare} THEN 'begun trigram' WHEN i3 + t3 >= {least} THEN 'trigram'
      WHEN seen < {rare} - 1 AND (f = 'thai' AND form_unknown < 0.1 OR kind <> 'text' AND place_seen >= {least} AND place_unknown < 0.1 * place_seen) THEN 'unknown word'
      WHEN i2 + t2 >= {least} AND i2 > 0 THEN 'bigram' WHEN i1 + t1 >= {least} AND i1 > 0 THEN 'word' ELSE 'form' END AS level
  FROM levels
), verdict AS (
  SELECT kind, a, b, c, level, CASE level WHEN 'trigram' THEN t3 < {share} * (i3 + t3) WHEN 'begun trigram' THEN true WHEN 'unknown word' THEN true WHEN 'bigram' THEN t2 < {share} * (i2 + t2)
    WHEN 'word' THEN t1 < {share} * (i1 + t1) ELSE t0 < {share} * (i0 + t0) END AS cut
  FROM judged
)
SELECT f.k, CASE WHEN f.sign THEN 'sign' ELSE v.level END AS level, f.sign OR v.cut AS cut
FROM {finals} f JOIN verdict v ON f.kind = v.kind AND f.a = v.a AND f.b = v.b AND f.c = v.c"""


def truncated(df: DataFrame, key: str = "section_id", text: str = "text", **kw) -> DataFrame:
    """``(key, level, cut)`` for every row with a text; ``level`` names what decided. Null and blank texts give no
    row; copies of a row give copies of the result but count once, as a text under several keys does; other columns don't
    matter."""
    spark = df.sparkSession
    src, texts, counts, finals = (f"_truncation_{x}_{id(df)}" for x in ("src", "texts", "counts", "finals"))
    df.select(F.col(key).alias("k"), F.col(text).alias("text")).createOrReplaceTempView(src)
    # the judge takes off a text's own end once, so each text may have one only
    df.select(F.col(text).alias("text")).distinct().createOrReplaceTempView(texts)
    # the counts feed every level, the finals both ends of the judging: each is computed once
    counted, final = cut(spark.sql(trigram_counts_sql(texts))), cut(spark.sql(finals_sql(src)))
    counted.createOrReplaceTempView(counts)
    final.createOrReplaceTempView(finals)
    out = spark.sql(judge_sql(counts, finals, **kw)).withColumnRenamed("k", key)
    for view in (src, texts, counts, finals):
        spark.catalog.dropTempView(view)
    return out


def deciding_levels(df: DataFrame, key: str = "section_id", text: str = "text", **kw) -> DataFrame:
    """``(level, n_texts, n_cut)``: what decided how many texts, and how many of them are cut."""
    return truncated(df, key, text, **kw).distinct().groupBy("level").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))


def truncation_report(df: DataFrame, key: str = "section_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """By source: records, cut records and their share; each key counts once, rows without text count as whole."""
    flags = truncated(df, key, text, **kw).where("cut").select(key).distinct().withColumn("_cut", F.lit(1))
    rows = df.select(key, source).distinct()
    return (
        rows.join(flags, key, "left").groupBy(source)
        .agg(F.count("*").alias("n_records"), F.count("_cut").alias("n_cut"))
        .withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_records"), 6))
    )
