"""Company lists and data vendors' files: explicit schemas, pruned and renamed columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import company_key, padded_id, plain_number, ticker_form, without_article
from ledgerloom.operators.resolve import first_by, preference

# --- fixed values ---
FORTUNE = "rank int, company string, ticker string, industry string, city string, state string, country string, revenue string, profit string, assets string, employees string"
FUNDAMENTALS = "gvkey string, fyear int, cik string, tic string, conm string, emp double, at double, indfmt string, curcd string, datafmt string, consol string, gsector string"
ETO_CORE = "eto_id long, eto_name string, parat_link string, ai_publications double, total_publications double, eto_ai_publication_pct double, ai_patents double, total_patents double, eto_ai_patent_pct double, ai_workers double, tech_team1_workers double"
CODES = {"indfmt": ("INDL", 16), "curcd": ("USD", 8), "datafmt": ("STD", 4), "consol": ("C", 2)}
ITEM_FIELDS = FORTUNE.replace(" int", "").replace(" string", "").split(", ")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header; ids stay text, and columns are found by name, so only wanted ones are read."""
    head = spark.read.csv(path, header=True, inferSchema=False)
    return head.select(*(F.expr(f"try_cast(`{n}` AS {t})").alias(n) for n, t in (c.strip().split(" ") for c in schema.split(","))))


def fortune(df: DataFrame, top: int = 500, listed_only: bool = False) -> DataFrame:
    """The largest firms with name and ticker in key form; copies count once."""
    d = df.dropDuplicates(["rank"]).orderBy("rank").limit(top)
    d = d.withColumns({"normalized_company_name": company_key(F.col("company")), "ticker": F.upper(F.trim("ticker"))})
    return d.where("ticker <> '~'") if listed_only else d


def cik_by_gvkey(fundamentals: DataFrame) -> DataFrame:
    """The cik of the latest year of each gvkey; a record without a year counts as latest, ties go to the largest cik."""
    d = fundamentals.where(F.col("cik").isNotNull())
    return first_by(d.select("gvkey", "fyear", "cik"), ["gvkey"], [F.coalesce("fyear", F.lit(99999)), F.col("cik")]).select("gvkey", "cik")


def sp500(members: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Index members (row, gvkey, tic, companyname): first row per gvkey in file order, rank by position, cik added."""
    first = first_by(members, ["gvkey"], [-F.col("row")])
    from pyspark.sql import Window as W

    d = first.withColumn("company", without_article(F.col("companyname"))).withColumn("rank", F.row_number().over(W.orderBy("row")))  # some hundred rows
    d = d.select("rank", "company", F.upper("tic").alias("ticker"), company_key(F.col("company")).alias("normalized_company_name"), "gvkey")
    return d.join(cik_by_gvkey(fundamentals), "gvkey", "left")


def universe(name: str, **tables: DataFrame) -> DataFrame:
    """The firm universe by name."""
    makers = {"fortune500": lambda: fortune(tables["fortune"]), "sp500": lambda: sp500(tables["members"], tables["fundamentals"])}
    if name not in makers:
        raise ValueError(f"unknown universe {name!r}; known: {sorted(makers)}")
    return makers[name]()


def fundamentals_year(df: DataFrame, fyear: int = 2024) -> DataFrame:
    """One preferred record per gvkey of a year, with key forms."""
    d = df.where(F.col("fyear") == fyear).withColumn("_p", preference(CODES, "emp"))
    at = F.when(~F.isnan("at"), F.col("at"))
    best = first_by(d, ["gvkey"], [F.col("_p"), F.coalesce(at, F.lit(float("-inf"))), F.col("loaded_at"), -F.col("record_id")]).drop("_p")
    return best.withColumns({"norm_ticker": ticker_form(F.col("tic")), "normalized_conm": company_key(F.col("conm")), "cik_int": plain_number(F.col("cik"))})


def eto_core(spark: SparkSession, path: str) -> DataFrame:
    """The organisations' table with the columns of ``ETO_CORE``, copies once."""
    return csv(spark, path, ETO_CORE).distinct()


def eto_tickers(df: DataFrame) -> DataFrame:
    return df.withColumn("norm_ticker", ticker_form(F.col("ticker")))


def eto_aliases(df: DataFrame) -> DataFrame:
    return df.withColumn("normalized_alias", company_key(F.col("alias")))


def gics_sector(universe_df: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """The universe with its latest known sector; needs a gvkey."""
    if "gvkey" not in universe_df.columns:
        raise ValueError("sectors are known by gvkey, which this universe lacks")
    s = first_by(fundamentals.where(F.col("gsector").isNotNull()).select("gvkey", "fyear", "gsector"), ["gvkey"], [F.coalesce("fyear", F.lit(99999)), F.col("gsector")])
    return universe_df.join(s.select("gvkey", "gsector"), "gvkey", "left")


def filings(df: DataFrame) -> DataFrame:
    """Filings with padded cik and the fiscal year of the period, else of the filing date."""
    year = F.coalesce(F.expr("try_cast(substr(period_of_report, 1, 4) AS int)"), F.expr("try_cast(substr(filing_date, 1, 4) AS int)"))
    return df.withColumns({"cik": padded_id(F.col("cik"), 10), "fiscal_year": year})


def json_list(spark: SparkSession, path: str, fields: list[str] = ITEM_FIELDS) -> DataFrame:
    """A list API's answer, either the list itself or an object with it under ``data``: text fields, '' if absent."""
    d = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if "data" in d.columns:
        d = d.select(F.explode("data").alias("r")).select("r.*")
    return d.select(*((F.trim(F.coalesce(F.col(f), F.lit(""))) if f in d.columns else F.lit("")).alias(f) for f in fields))


def json_response(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A REST answer with its rows under ``response``, typed by ``schema``; a field of another type is null."""
    d = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).select(F.explode("response").alias("r")).select("r.*")
    return d.select(*((F.expr(f"try_cast(`{n}` AS {t})") if n in d.columns else F.lit(None).cast(t)).alias(n) for n, t in (c.strip().split(" ") for c in schema.split(","))))


class _Tables(HTMLParser):
    """Cells of every table with the class or id of the nearest container around it."""

    def __init__(self):
        super().__init__()
        self.around, self.rows, self.cell, self.n, self.open = [], [], None, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("div", "section"):
            a = dict(attrs)
            self.around.append(f"{a.get('id') or ''} {a.get('class') or ''}")
        elif tag == "table":
            self.n += 1
            self.open.append(self.n)
        elif tag == "tr" and self.open:
            self.rows.append([self.open[-1], " ".join(self.around), []])
        elif tag in ("td", "th") and self.open and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("div", "section") and self.around:
            self.around.pop()
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1][2].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, table_no, container, row_no, cells)`` of every table row of the pages."""
    kind = pages.schema[key].dataType.simpleString()

    def run(it):
        for pdf in it:
            out = []
            for k, h in zip(pdf[key], pdf[html]):
                p = _Tables()
                p.feed(h or "")
                seen: dict[int, int] = {}
                for t, where, cells in p.rows:
                    seen[t] = seen.get(t, -1) + 1
                    out.append((k, t, where, seen[t], cells))
            yield pd.DataFrame(out, columns=[key, "table_no", "container", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, table_no int, container string, row_no int, cells array<string>")


def ranked_html_table(pages: DataFrame, key: str, html: str, container: str, columns: list[str]) -> DataFrame:
    """The first table of each page within ``container`` (else the first at all) as columns, with its position as
    rank where the first column holds none; numbers are coerced, other text is null there."""
    r = html_rows(pages, key, html).where(F.size("cells") >= len(columns))
    pick = r.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("container").contains(container), F.col("table_no"))), F.min("table_no")).alias("_t"))
    body = r.join(pick, key).where("table_no = _t AND row_no > 0")
    num = lambda i: F.expr(f"try_cast(regexp_replace(cells[{i}], ',', '') AS double)")
    return body.select(key, F.coalesce(num(0).cast("long"), F.col("row_no").cast("long")).alias("rank"), F.col("cells")[1].alias(columns[1]), *(num(i).alias(c) for i, c in enumerate(columns) if i > 1))


def ranked_rows(rows: DataFrame, fix: dict[int, str], last: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a scanned ranking (rank, score and name as text) typed, first of each rank kept, names of ``fix`` set;
    and the ranks of 1..last that are missing."""
    name = F.trim(F.regexp_replace("company_name", "\\s+", " "))
    t = rows.select(F.expr("try_cast(regexp_replace(rank, ',', '') AS int)").alias("rank"), F.expr("try_cast(ai_maturity_score AS double)").alias("ai_maturity_score"), name.alias("company_name")).where("rank IS NOT NULL")
    t = first_by(t, ["rank"], [F.coalesce("ai_maturity_score", F.lit(-1.0)), F.col("company_name")])
    fixed = F.col("company_name")
    for r, n in fix.items():
        fixed = F.when(F.col("rank") == r, n).otherwise(fixed)
    t = t.withColumn("company_name", fixed)
    return t, rows.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("rank")).join(t, "rank", "left_anti")


def pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, page, line_no, line)`` of PDF files, by whichever PDF library the workers have."""

    def run(it):
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading PDF needs pdfplumber on the workers") from e
        import io

        for pdf in it:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                with pdfplumber.open(io.BytesIO(raw)) as doc:
                    out += [(p, i, k, s) for i, page in enumerate(doc.pages) for k, s in enumerate((page.extract_text() or "").split("\n"))]
            yield pd.DataFrame(out, columns=["path", "page", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, line_no int, line string")


def pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(path, page, table_no, row_no, cells)`` of the tables of PDF files, by whichever PDF library the workers have."""

    def run(it):
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading PDF needs pdfplumber on the workers") from e
        import io

        for pdf in it:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                with pdfplumber.open(io.BytesIO(raw)) as doc:
                    out += [(p, i, t, r, [" ".join((c or "").split()) for c in row]) for i, page in enumerate(doc.pages) for t, rows in enumerate(page.extract_tables()) for r, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "page", "table_no", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, table_no int, row_no int, cells array<string>")


def ranked_pdf_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Table rows of at least as many cells as ``columns`` (rank, ai_maturity_score and company_name among them) as text
    columns, for ``ranked_rows``."""
    return cells.where(F.size("cells") >= len(columns)).select(*(F.col("cells")[i].alias(c) for i, c in enumerate(columns)))


def annotations(labels: DataFrame, key: DataFrame) -> DataFrame:
    """Labelled sample with its hidden key; a prediction is 1 for records drawn as positive, a gold label that is no
    number is null."""
    j = labels.join(key, "id")
    return j.select(*labels.columns, "source", (F.col("source") == "pos").cast("int").alias("predicted"), F.expr("try_cast(gold AS int)").alias("gold_int"))


