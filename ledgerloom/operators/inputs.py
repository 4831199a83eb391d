"""From universes and vendors' tables to the structured inputs, and from a universe to its filings."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import company_key, padded_id, ticker_form
from ledgerloom.operators.resolve import cascade, demote_duplicates, first_by, key_values
from ledgerloom.operators.sections import assemble_sections, structured_view
from ledgerloom.operators.shares import ratio, reason
from ledgerloom.session import cut

# --- fixed values: a renamed firm by its key name and its id, checked by hand; tickers that are none ---
MANUAL_ETO = {"everest": 2312}
NO_TICKER = ("", "nan", "none", "-", "~")
TECHNOLOGY = {"ai_publication_share": ("ai_publications", "total_publications"), "ai_patent_share": ("ai_patents", "total_patents")}
PEOPLE = {"tech_team1_worker_share": ("tech_team1_workers", "employees_wrds"), "ai_worker_share": ("ai_workers", "employees_wrds")}


def headcount(emp: Column) -> Column:
    """Employees of a record in thousands as a number of people; zero stays, NaN is missing."""
    return F.when(~F.isnan(emp), emp * 1000.0)


def match_eto(firms: DataFrame, core: DataFrame, tickers: DataFrame, aliases: DataFrame, manual: dict[str, int] = MANUAL_ETO) -> DataFrame:
    """``firms`` (name, tick and more) with ``eto_id`` and ``method``: pairs fixed by hand, then ticker, name and alias,
    each only where it is unambiguous. Tickers and aliases of ids that ``core`` lacks don't count."""
    known = core.select("eto_id").distinct()
    hand = firms.sparkSession.createDataFrame(list(manual.items()), "k string, v long")  # a short fixed list
    only = lambda d: d.join(known, "eto_id", "left_semi")
    passes = [
        ("manual", F.col("name"), key_values(hand, F.col("k"), F.col("v"))), ("ticker", F.col("tick"), key_values(only(tickers), ticker_form(F.col("ticker")), F.col("eto_id"))),
        ("name", F.col("name"), key_values(core, company_key(F.col("eto_name")), F.col("eto_id"))), ("alias", F.col("name"), key_values(only(aliases), company_key(F.col("alias")), F.col("eto_id"))),
    ]
    return demote_duplicates(cascade(firms, passes, "eto_id", "method"), "eto_id", "method", ["manual", "ticker", "name", "alias"])


def match_gvkey(universe: DataFrame, wrds: DataFrame) -> DataFrame:
    """A universe that carries a gvkey by that alone: ``gvkey`` and ``wrds_conm`` where the record exists,
    ``employees_wrds`` and the method. ``wrds`` has one record per gvkey."""
    w = wrds.select(F.col("gvkey").alias("_g"), F.col("conm").alias("wrds_conm"), headcount(F.col("emp")).alias("employees_wrds"))
    j = universe.join(w, F.col("gvkey") == F.col("_g"), "left")
    return j.select(*(c for c in universe.columns if c != "gvkey"), F.col("_g").alias("gvkey"), "wrds_conm", "employees_wrds", F.when(F.col("_g").isNotNull(), "gvkey").otherwise("unmatched").alias("wrds_match_method"))


def structured_inputs(firms: DataFrame, eto: DataFrame, core: DataFrame, wrds: DataFrame, key: str) -> DataFrame:
    """One row per firm: the match of both vendors (``eto``: key, eto_id, method; ``wrds``: key, gvkey, employees_wrds,
    wrds_match_method), the four shares with the reason of every missing one, and whether a dimension is complete. A share
    of people needs both vendors: a firm that either lacks is unmatched."""
    c = core.select("eto_id", *(x for pair in (*TECHNOLOGY.values(), *PEOPLE.values()) for x in pair if x != "employees_wrds")).distinct()
    j = firms.join(eto, key, "left").join(c, "eto_id", "left").join(wrds, key, "left")
    has_eto, has_both = F.col("eto_id").isNotNull(), F.col("eto_id").isNotNull() & F.col("gvkey").isNotNull()
    out = {}
    for group, matched in ((TECHNOLOGY, has_eto), (PEOPLE, has_both)):
        for name, (num, den) in group.items():
            out[name] = ratio(F.col(num), F.col(den))
            out[f"{name}_reason"] = reason(matched, F.col(den))
    j = j.withColumns(out)
    full = lambda group: [F.col(n).isNotNull() for n in group]
    t, p = full(TECHNOLOGY), full(PEOPLE)
    return j.withColumns({"technology_complete": t[0] & t[1], "people_complete": p[0] & p[1]})


def match_report(inputs: DataFrame, core: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Matched firms beside the names that the vendors know them by, for reading: ``(company_name, method, eto_name,
    wrds_match_method, conm)`` of firms that both vendors know."""
    e = core.select("eto_id", "eto_name").distinct()
    w = fundamentals.select("gvkey", "conm").distinct()
    return inputs.join(e, "eto_id").join(w, "gvkey").select("company_name", "method", "eto_name", "wrds_match_method", "conm")


def beside(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Frames of the same rows side by side, columns prefixed ``<name>__``: matched by key, never by position."""
    out = None
    for name, f in frames.items():
        part = f.select(*keys, *(F.col(c).alias(f"{name}__{c}") for c in f.columns if c not in keys))
        out = part if out is None else out.join(part, keys, "full")
    return out


def in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that both frames hold."""
    return a.select(column).where(F.col(column).isNotNull()).intersect(b.select(column))


def resolve_filings(universe: DataFrame, filings: DataFrame, fiscal_year: int | None = None, form: str = "10-K") -> tuple[DataFrame, DataFrame]:
    """(one filing per firm, skipped firms with the reason). ``universe`` has company, ticker, normalized_company_name and
    maybe cik, ``filings`` cik, ticker, accession_number, fiscal_year, filing_date and form. A firm is looked up by cik,
    else by ticker; the latest filing of exactly ``form`` counts, of ``fiscal_year`` if one is asked for."""
    cik = padded_id(F.trim(F.col("cik").cast("string")), 10) if "cik" in universe.columns else F.lit(None).cast("string")
    tick = F.when(~F.lower(F.trim("ticker")).isin(*NO_TICKER), ticker_form(F.col("ticker")))
    u = universe.select("company", "ticker", "normalized_company_name", F.when(cik != "", cik).alias("_cik"), tick.alias("_tick")).distinct()
    f = filings.select(padded_id(F.trim("cik"), 10).alias("cik"), ticker_form(F.col("ticker")).alias("_t"), "accession_number", "fiscal_year", "filing_date", "form").distinct()
    by_ticker = key_values(f, F.col("_t"), F.col("cik")).where("value IS NOT NULL").select(F.col("key").alias("_tick"), F.col("value").alias("_by"))
    u = u.join(by_ticker, "_tick", "left").withColumn("cik", F.coalesce("_cik", "_by")).drop("_by")
    year = F.lit(True) if fiscal_year is None else F.col("fiscal_year") == fiscal_year
    per = f.groupBy("cik").agg(F.count_if(F.col("form") == form).alias("_exact"), F.count_if((F.col("form") == form) & year).alias("_fit"))
    latest = first_by(f.where((F.col("form") == form) & year).drop("_t"), ["cik"], [F.col("filing_date"), F.col("accession_number")])
    j = u.join(per, "cik", "left")
    why = (
        F.when(F.col("_cik").isNull() & F.col("_tick").isNull(), "no ticker").when(F.col("cik").isNull() | F.col("_exact").isNull(), "lookup failed")
        .when(F.col("_exact") == 0, "only amendments").when(F.col("_fit") == 0, "no filing of the year")
    )
    skipped = j.withColumn("reason", why).where("reason IS NOT NULL").select("company", "ticker", "reason")
    found = j.where("_fit > 0").join(latest, "cik").select("cik", "ticker", F.col("company").alias("company_name"), "normalized_company_name", "accession_number", F.coalesce("fiscal_year", F.expr("try_cast(substr(filing_date, 1, 4) AS int)")).alias("fiscal_year"), "filing_date", "form")
    return found, skipped


def client_identity(variable: str = "EDGAR_IDENTITY") -> str:
    """Who asks the filing service, which wants a name and an address; an error if nobody says so."""
    who = os.environ.get(variable, "").strip()
    if "@" not in who:
        raise RuntimeError(f"set {variable} to a name and mail address before fetching filings")
    return who


def fetch_filings(filings: DataFrame, fetch: Callable[[str], tuple[dict[str, dict[str, str]], str]]) -> DataFrame:
    """``(accession_number, parser, item, text)`` by a connector that runs on the workers: ``fetch(accession_number)`` returns
    the structured views, parser -> item -> text, and the raw text, which comes out as parser ``raw`` without an item. A
    filing whose fetch fails has one row with null text, so that it can be told from an empty one."""

    def run(it):
        for pdf in it:
            rows = []
            for acc in pdf["accession_number"]:
                try:
                    views, raw = fetch(acc)
                except Exception:  # one filing must not end the others
                    rows.append((acc, "raw", None, None))
                    continue
                rows += [(acc, p, i, t) for p, items in (views or {}).items() for i, t in items.items()] + [(acc, "raw", None, raw)]
            yield pd.DataFrame(rows, columns=["accession_number", "parser", "item", "text"])

    return filings.select("accession_number").distinct().mapInPandas(run, "accession_number string, parser string, item string, text string")


def extract_items(filings: DataFrame, fetch: Callable[[str], tuple[dict[str, dict[str, str]], str]], parsers: list[str]) -> DataFrame:
    """Fetched and assembled in one go: ``(accession_number, cik, item, source, text)`` of the filings (accession_number,
    cik); of the parsers' views of an Item the longest valid one counts, equal ones in the order of ``parsers``."""
    pages = cut(fetch_filings(filings, fetch))
    raw = filings.select("accession_number", "cik").distinct().join(pages.where("parser = 'raw'").select("accession_number", "text"), "accession_number")
    return assemble_sections(structured_view(pages.where("parser <> 'raw'"), parsers), raw)
