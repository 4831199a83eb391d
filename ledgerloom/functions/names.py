"""Name, ticker and id normal forms as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------------------------------------------
TRAILING_FORMS = "inc incorporated corp corporation co company ltd limited plc llc lp holdings group the".split()
LEGAL_WORDS = "inc corp corporation ltd limited llc co company ag gmbh sa se plc ab as nv pty".split()
FILLER_WORDS = "holdings holding group international intl the and".split()


def company_key(c: Column) -> Column:
    """Key form of a company name: lower case, `. , ' ’ &` deleted, trailing legal forms stripped until none is
    left, other signs deleted. Null gives ''. A removed sign at the end leaves a blank that shields the form before
    it (``Apple Inc &`` -> ``apple inc``); accented letters are deleted."""
    s = F.regexp_replace(F.trim(F.lower(c)), "[.,'’&]", "")
    s = F.regexp_replace(s, "\\s+", " ")
    s = F.regexp_replace(s, f"( ({'|'.join(TRAILING_FORMS)}))+$", "")
    s = F.regexp_replace(s, "[^a-z0-9 ]", "")
    return F.coalesce(F.trim(F.regexp_replace(s, "\\s+", " ")), F.lit(""))


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def merge_name(c: Column) -> Column:
    """Name form for merging lists: transliterated, signs but hyphens to blanks, legal and filler words dropped
    wherever they stand. Null and blank give ''."""
    words = F.split(F.lower(F.regexp_replace(_ascii(c), "[^\\w\\s-]", " ")), "\\s+")
    return F.coalesce(F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS, *FILLER_WORDS, "")), " "), F.lit(""))


def ticker_form(c: Column) -> Column:
    """Letters and digits of a ticker in upper case; placeholders (null, '', ~, NAN) give ''."""
    t = F.upper(F.trim(c))
    return F.when(c.isNull() | t.isin("", "~", "NAN"), "").otherwise(F.regexp_replace(t, "[^A-Z0-9]", ""))


def without_article(c: Column) -> Column:
    """A name without a leading The."""
    return F.regexp_replace(c, "^[Tt]he\\s+", "")


def padded_id(c: Column, width: int) -> Column:
    """Zero-padded id; longer ids stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def plain_number(c: Column) -> Column:
    """An id as a number, with or without a decimal tail; null if it is none."""
    return F.regexp_replace(F.trim(c), "[.]0+$", "").try_cast("long")
