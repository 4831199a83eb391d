"""Queries of the index pipeline's operators over the test tables, each with the same in DuckDB's SQL.

Exact copies of rows are taken once. Floats are rounded where the order of summing shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import names as N
from ledgerloom.functions import text as T
from ledgerloom.operators import index as I
from ledgerloom.operators import resolve as R
from ledgerloom.operators import dimensions as D
from ledgerloom.operators import inputs, sampling, scoring, sections, shares, stats
from ledgerloom.session import read_table
from ledgerloom.plans import filing_sql
from ledgerloom.sources import lists

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- SQL pieces ------------------------------------------------------------------------------------------------------
_FORMS = "|".join(N.TRAILING_FORMS)


def _key(c: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '[.,''’&]', '', 'g'), '\\s+', ' ', 'g'), '( ({_FORMS}))+$', ''), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')), '')"


def _tick(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR upper(trim({c})) IN ('', '~', 'NAN') THEN '' ELSE regexp_replace(upper(trim({c})), '[^A-Z0-9]', '', 'g') END"


def _num(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def _r(*cols: str, n: int = 6):
    return [F.round(c, n).alias(c) for c in cols]


# --- scans and names ---------------------------------------------------------------------------------------------------
@query(f"SELECT rank, company, upper(trim(ticker)) AS ticker, {_key('company')} AS normalized_company_name FROM (SELECT DISTINCT rank, company, ticker FROM fortune) ORDER BY rank LIMIT 500")
def universe_fortune(spark, d):
    return lists.fortune(_t(spark, d, "fortune")).select("rank", "company", "ticker", "normalized_company_name")


@query(f"SELECT DISTINCT conm, {_key('conm')} AS key_name, {_key(chr(39) + 'The ' + chr(39) + ' || conm')} AS with_article FROM fundamentals")
def company_keys(spark, d):
    return _t(spark, d, "fundamentals").select("conm", N.company_key(F.col("conm")).alias("key_name"), N.company_key(F.concat(F.lit("The "), "conm")).alias("with_article")).distinct()


@query(
    "WITH n AS (SELECT DISTINCT alias FROM eto_alias) SELECT alias, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(nfc_normalize(strip_accents(alias)), '[^\\x00-\\x7f]', '', 'g'), '[^\\w\\s-]', ' ', 'g')), '\\s+'), "
    f"lambda w: w NOT IN ({', '.join(repr(w) for w in [*N.LEGAL_WORDS, *N.FILLER_WORDS, ''])})), ' ') AS merge_name FROM n"
)
def merge_names(spark, d):
    return _t(spark, d, "eto_alias").select("alias").distinct().select("alias", N.merge_name(F.col("alias")).alias("merge_name"))


@query(f"SELECT ticker, {_tick('ticker')} AS norm_ticker, count(*) AS n FROM (SELECT ticker FROM eto_ticker UNION ALL SELECT ticker FROM fortune UNION ALL SELECT tic FROM fundamentals) GROUP BY ALL")
def ticker_normalize(spark, d):
    t = _t(spark, d, "eto_ticker").select("ticker").union(_t(spark, d, "fortune").select("ticker")).union(_t(spark, d, "fundamentals").select("tic"))
    return t.groupBy("ticker", N.ticker_form(F.col("ticker")).alias("norm_ticker")).agg(F.count("*").alias("n"))


@query("SELECT gvkey, cik FROM (SELECT *, row_number() OVER (PARTITION BY gvkey ORDER BY fyear DESC NULLS FIRST, cik DESC) AS r FROM (SELECT DISTINCT gvkey, fyear, cik FROM fundamentals WHERE cik IS NOT NULL)) WHERE r = 1")
def cik_by_gvkey(spark, d):
    return lists.cik_by_gvkey(_t(spark, d, "fundamentals"))


@query(
    f"""SELECT gvkey, record_id, {_tick('tic')} AS norm_ticker, {_key('conm')} AS normalized_conm, try_cast(regexp_replace(trim(cik), '[.]0+$', '') AS BIGINT) AS cik_int FROM (
  SELECT *, row_number() OVER (PARTITION BY gvkey ORDER BY (16 * (coalesce(upper(trim(indfmt)), '') = 'INDL')::INT + 8 * (coalesce(upper(trim(curcd)), '') = 'USD')::INT + 4 * (coalesce(upper(trim(datafmt)), '') = 'STD')::INT
    + 2 * (coalesce(upper(trim(consol)), '') = 'C')::INT + (emp IS NOT NULL AND NOT coalesce(isnan(emp), false))::INT) DESC, CASE WHEN isnan("at") THEN NULL ELSE "at" END DESC NULLS LAST, loaded_at DESC, record_id) AS r
  FROM (SELECT DISTINCT * FROM fundamentals WHERE fyear = 2024)) WHERE r = 1"""
)
def dedupe_preference(spark, d):
    f = lists.fundamentals_year(_t(spark, d, "fundamentals").distinct())
    return f.select("gvkey", "record_id", "norm_ticker", "normalized_conm", "cik_int")


@query("SELECT cik, accession_number, fiscal_year, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS r FROM (SELECT DISTINCT * FROM filings WHERE form = '10-K' AND fiscal_year = 2024)) WHERE r = 1")
def latest_filings(spark, d):
    return R.latest_filings(_t(spark, d, "filings").distinct(), "10-K", 2024).select("cik", "accession_number", "fiscal_year", "filing_date")


@query("SELECT accession_number, lpad(cik, 10, '0') AS cik, coalesce(try_cast(substr(filing_date, 1, 4) AS INT), NULL) AS fiscal_year FROM (SELECT DISTINCT accession_number, cik, filing_date FROM filings)")
def filing_years(spark, d):
    f = _t(spark, d, "filings").select("accession_number", "cik", "filing_date", F.lit(None).cast("string").alias("period_of_report")).distinct()
    return lists.filings(f).select("accession_number", "cik", "fiscal_year")


# --- resolution ----------------------------------------------------------------------------------------------------------
@query(f"SELECT key, CASE WHEN lo = hi THEN lo END AS value, lo <> hi AS ambiguous FROM (SELECT {_tick('ticker')} AS key, min(eto_id) AS lo, max(eto_id) AS hi FROM eto_ticker WHERE {_tick('ticker')} <> '' GROUP BY 1)")
def unambiguous_map(spark, d):
    return R.key_values(_t(spark, d, "eto_ticker"), N.ticker_form(F.col("ticker")), F.col("eto_id"))


def _maps(*passes: tuple[str, str, str]) -> str:
    return ", ".join(f"m{i} AS (SELECT k, CASE WHEN min(v) = max(v) THEN min(v) END AS v, min(v) <> max(v) AS amb FROM (SELECT {k} AS k, {v} AS v FROM {src}) WHERE k IS NOT NULL AND k <> '' GROUP BY k)" for i, (k, v, src) in enumerate(passes))


_FIRMS = f"firms AS (SELECT DISTINCT rank, {_key('company')} AS name, {_tick('ticker')} AS tick FROM fortune)"


def _demoted(idn: str, ranks: list[str]) -> str:
    case = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(ranks))
    return f"""r AS (SELECT *, CASE method {case} ELSE {len(ranks)} END AS s FROM c), b AS (SELECT {idn} AS bid, count(*) AS n, min(s) AS lo, max(s) AS hi FROM r WHERE {idn} IS NOT NULL GROUP BY 1)
SELECT rank, name, CASE WHEN coalesce(n > 1 AND (s > lo OR lo = hi), false) THEN NULL ELSE {idn} END AS {idn}, CASE WHEN coalesce(n > 1 AND (s > lo OR lo = hi), false) THEN 'ambiguous' ELSE method END AS method FROM r LEFT JOIN b ON {idn} = bid"""


_CORE_IDS = "WHERE eto_id IN (SELECT eto_id FROM eto_core)"
_HAND = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in inputs.MANUAL_ETO.items()) + " END"
_ETO_SQL = f"""WITH {_FIRMS}, {_maps((_tick('ticker'), 'eto_id', f'eto_ticker {_CORE_IDS}'), (_key('eto_name'), 'eto_id', 'eto_core'), (_key('alias'), 'eto_id', f'eto_alias {_CORE_IDS}'))},
c AS (SELECT rank, name, coalesce({_HAND}, m0.v, m1.v, m2.v) AS eto_id, CASE WHEN {_HAND} IS NOT NULL THEN 'manual' WHEN m0.v IS NOT NULL THEN 'ticker' WHEN m1.v IS NOT NULL THEN 'name' WHEN m2.v IS NOT NULL THEN 'alias'
  WHEN coalesce(m0.amb, false) OR coalesce(m1.amb, false) OR coalesce(m2.amb, false) THEN 'ambiguous' ELSE 'unmatched' END AS method
  FROM firms LEFT JOIN m0 ON tick = m0.k LEFT JOIN m1 ON name = m1.k LEFT JOIN m2 ON name = m2.k), {_demoted('eto_id', ['manual', 'ticker', 'name', 'alias'])}"""


def _firms(spark, d):
    return _t(spark, d, "fortune").select("rank", N.company_key(F.col("company")).alias("name"), N.ticker_form(F.col("ticker")).alias("tick")).distinct()


def _eto(spark, d):
    return inputs.match_eto(_firms(spark, d), *(_t(spark, d, x) for x in ("eto_core", "eto_ticker", "eto_alias")))


@query(_ETO_SQL)
def eto_match(spark, d):
    return _eto(spark, d).select("rank", "name", "eto_id", "method")


_WRDS_SQL = f"""WITH {_FIRMS}, fc AS (SELECT {_key('company_name')} AS fname, max(try_cast(trim(cik) AS BIGINT)) AS fcik FROM filings GROUP BY 1),
w AS (SELECT DISTINCT gvkey, try_cast(regexp_replace(trim(cik), '\\.0+$', '') AS BIGINT)::VARCHAR AS cik, {_tick('tic')} AS tick, {_key('conm')} AS name FROM fundamentals WHERE fyear = 2024),
{_maps(('cik', 'gvkey', 'w'), ('tick', 'gvkey', 'w'), ('name', 'gvkey', 'w'))},
c AS (SELECT rank, firms.name, coalesce(m0.v, m1.v, m2.v) AS gvkey, CASE WHEN m0.v IS NOT NULL THEN 'cik' WHEN m1.v IS NOT NULL THEN 'ticker' WHEN m2.v IS NOT NULL THEN 'name'
  WHEN coalesce(m0.amb, false) OR coalesce(m1.amb, false) OR coalesce(m2.amb, false) THEN 'ambiguous' ELSE 'unmatched' END AS method
  FROM firms LEFT JOIN fc ON fname = name LEFT JOIN m0 ON fcik::VARCHAR = m0.k LEFT JOIN m1 ON tick = m1.k LEFT JOIN m2 ON name = m2.k), {_demoted('gvkey', ['cik', 'ticker', 'name'])}"""


def _wrds(spark, d):
    w = _t(spark, d, "fundamentals").where("fyear = 2024").select(
        "gvkey", F.expr("try_cast(regexp_replace(trim(cik), '[.]0+$', '') AS bigint)").cast("string").alias("cik"), N.ticker_form(F.col("tic")).alias("tick"), N.company_key(F.col("conm")).alias("name")
    ).distinct()
    fc = _t(spark, d, "filings").groupBy(N.company_key(F.col("company_name")).alias("fname")).agg(F.max(F.expr("try_cast(trim(cik) AS bigint)")).cast("string").alias("fcik"))
    firms = _firms(spark, d).join(fc, F.col("name") == F.col("fname"), "left").drop("fname")
    g = F.col("gvkey")
    passes = [("cik", F.col("fcik"), R.key_values(w, F.col("cik"), g)), ("ticker", F.col("tick"), R.key_values(w, F.col("tick"), g)), ("name", F.col("name"), R.key_values(w, F.col("name"), g))]
    return R.demote_duplicates(R.cascade(firms, passes, "gvkey", "method"), "gvkey", "method", ["cik", "ticker", "name"])


@query(_WRDS_SQL)
def wrds_match(spark, d):
    return _wrds(spark, d).select("rank", "name", "gvkey", "method")


_FY = """fy AS (SELECT gvkey, conm, CASE WHEN isnan(emp) THEN NULL ELSE emp END * 1000e0 AS employees_wrds FROM (
  SELECT *, row_number() OVER (PARTITION BY gvkey ORDER BY (16 * (coalesce(upper(trim(indfmt)), '') = 'INDL')::INT + 8 * (coalesce(upper(trim(curcd)), '') = 'USD')::INT + 4 * (coalesce(upper(trim(datafmt)), '') = 'STD')::INT
    + 2 * (coalesce(upper(trim(consol)), '') = 'C')::INT + (emp IS NOT NULL AND NOT coalesce(isnan(emp), false))::INT) DESC, CASE WHEN isnan("at") THEN NULL ELSE "at" END DESC NULLS LAST, loaded_at DESC, record_id) AS r
  FROM (SELECT DISTINCT * FROM fundamentals WHERE fyear = 2024)) WHERE r = 1)"""


def _share_sql(name: str, num: str, den: str, matched: str) -> str:
    return f"{num} / CASE WHEN {den} > 0 THEN {den} END AS {name}, CASE WHEN NOT ({matched}) THEN 'unmatched' WHEN {den} IS NULL OR {den} <= 0 THEN 'zero_denominator' END AS {name}_reason"


_SHARES = {**inputs.TECHNOLOGY, **inputs.PEOPLE}
_INPUTS_SQL = f"""m AS ({_ETO_SQL}), g AS (SELECT rank, gvkey, method AS wrds_match_method FROM ({_WRDS_SQL})), core AS (SELECT DISTINCT * FROM eto_core), {_FY},
inp AS (SELECT m.rank, m.name, m.eto_id, m.method, g.gvkey, wrds_match_method, employees_wrds, {', '.join(_share_sql(n, a, b, 'm.eto_id IS NOT NULL' + (' AND g.gvkey IS NOT NULL' if n in inputs.PEOPLE else '')) for n, (a, b) in _SHARES.items())}
  FROM m JOIN g USING (rank) LEFT JOIN core ON m.eto_id = core.eto_id LEFT JOIN fy ON g.gvkey = fy.gvkey)"""


def _inputs(spark, d):
    fy = lists.fundamentals_year(_t(spark, d, "fundamentals").distinct()).select("gvkey", inputs.headcount(F.col("emp")).alias("employees_wrds"))
    wrds = _wrds(spark, d).select("rank", "gvkey", F.col("method").alias("wrds_match_method")).join(fy, "gvkey", "left")
    return inputs.structured_inputs(_firms(spark, d).select("rank", "name"), _eto(spark, d).select("rank", "eto_id", "method"), _t(spark, d, "eto_core"), wrds, "rank")


@query(f"WITH {_INPUTS_SQL} SELECT rank, name, eto_id, method, gvkey, wrds_match_method, employees_wrds, " + ", ".join(f"round({n}, 6) AS {n}, {n}_reason" for n in _SHARES) + ", ai_publication_share IS NOT NULL AND ai_patent_share IS NOT NULL AS technology_complete, tech_team1_worker_share IS NOT NULL AND ai_worker_share IS NOT NULL AS people_complete FROM inp")
def structured_inputs(spark, d):
    flags = ["technology_complete", "people_complete"]
    return _inputs(spark, d).select("rank", "name", "eto_id", "method", "gvkey", "wrds_match_method", "employees_wrds", *_r(*_SHARES), *(f"{n}_reason" for n in _SHARES), *flags)


@query(f"WITH {_INPUTS_SQL} SELECT DISTINCT name AS company_name, method, eto_name, wrds_match_method, f.conm FROM inp JOIN (SELECT DISTINCT eto_id, eto_name FROM eto_core) e ON inp.eto_id = e.eto_id JOIN (SELECT DISTINCT gvkey, conm FROM fundamentals) f ON inp.gvkey = f.gvkey")
def match_report(spark, d):
    x = _inputs(spark, d).withColumnRenamed("name", "company_name")
    return inputs.match_report(x, _t(spark, d, "eto_core"), _t(spark, d, "fundamentals")).distinct()


@query(f"WITH {_FY}, u AS (SELECT gvkey, min(conm) AS company FROM fundamentals GROUP BY 1) SELECT company, fy.gvkey, fy.conm AS wrds_conm, employees_wrds, CASE WHEN fy.gvkey IS NULL THEN 'unmatched' ELSE 'gvkey' END AS wrds_match_method FROM u LEFT JOIN fy ON u.gvkey = fy.gvkey")
def gvkey_match(spark, d):
    u = _t(spark, d, "fundamentals").groupBy("gvkey").agg(F.min("conm").alias("company"))
    return inputs.match_gvkey(u, lists.fundamentals_year(_t(spark, d, "fundamentals").distinct()).select("gvkey", "conm", "emp"))


@query(
    """SELECT eto_id, round(ai_publications / CASE WHEN total_publications > 0 THEN total_publications END * 100 - CASE WHEN isnan(eto_ai_publication_pct) THEN NULL ELSE eto_ai_publication_pct END, 6) AS deviation
FROM (SELECT DISTINCT * FROM eto_core) WHERE abs(ai_publications / CASE WHEN total_publications > 0 THEN total_publications END * 100 - CASE WHEN isnan(eto_ai_publication_pct) THEN NULL ELSE eto_ai_publication_pct END) >= 0.15"""
)
def share_crosscheck(spark, d):
    dev = shares.ratio(F.col("ai_publications"), F.col("total_publications")) * 100 - I.number("eto_ai_publication_pct")
    return _t(spark, d, "eto_core").distinct().select("eto_id", F.round(dev, 6).alias("deviation"), dev.alias("_d")).where(F.abs("_d") >= 0.15).drop("_d")


# --- text --------------------------------------------------------------------------------------------------------------------
def _doubled_terms() -> str:
    import re

    ordered = sorted(set(T.AI_TERMS), key=lambda t: (-len(t), t))
    return "|".join(re.sub(r"[^a-z0-9]", lambda m: m[0] * 2, t) for t in ordered)


_FOUND = f"regexp_extract_all(' ' || regexp_replace(lower(text), '([^a-z0-9])', '\\1\\1', 'g') || ' ', '(?:^|[^a-z0-9])({_doubled_terms()})(?:[^a-z0-9]|$)', 1)"
_CANON = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.CANONICAL.items()) + " ELSE k END"
_CONCEPTS = ", ".join(f"('{t}')" for t in sorted({T.CANONICAL.get(t, t) for t in T.AI_TERMS}))


@query(
    f"""WITH hits AS (SELECT {_CANON} AS keyword FROM (SELECT regexp_replace(unnest({_FOUND}), '([^a-z0-9])[^a-z0-9]', '\\1', 'g') AS k FROM documents)),
n AS (SELECT v.keyword, count(h.keyword) AS count FROM (VALUES {_CONCEPTS}) v(keyword) LEFT JOIN hits h ON v.keyword = h.keyword GROUP BY 1)
SELECT keyword, count, coalesce(round_even(count * 100e0 / nullif(sum(count) OVER (), 0), 2), 0e0) AS share_pct FROM n"""
)
def keyword_distribution(spark, d):
    return sections.term_distribution(_t(spark, d, "documents"))


_SPLIT = "string_split(regexp_replace(text, '([.!?])[ \\n\\t\\r]+', '\\1' || chr(31), 'g'), chr(31))"
_VALID = "length(s) BETWEEN 30 AND 800 AND len(string_split_regex(trim(s), '[ \\n\\t\\r]+')) >= 5 AND length(regexp_replace(s, '[^\\p{L}]', '', 'g')) >= 0.4 * length(s)"
_HAS_AI = f"regexp_matches(' ' || lower(s) || ' ', '(^|[^a-z0-9])({'|'.join(T.AI_TERMS)})([^a-z0-9]|$)')"
_SENTENCES = f"(SELECT source, lang, trim(p) AS s FROM (SELECT source, lang, unnest({_SPLIT}) AS p FROM documents))"


def _doc_sentences(spark, d):
    s = _t(spark, d, "documents").select("source", "lang", F.explode(T.rough_sentences(F.col("text"))).alias("p")).select("source", "lang", F.trim("p").alias("s"))
    return s.where(T.is_sentence(F.col("s"))).withColumn("ai", T.mentions(F.col("s")).cast("int"))


@query(f"SELECT source, count(*) AS n_sentences, sum(({_HAS_AI})::INT)::BIGINT AS n_ai, round(sum(({_HAS_AI})::INT) / count(*)::DOUBLE, 6) AS ai_sentence_share FROM {_SENTENCES} WHERE {_VALID} GROUP BY source")
def ai_sentence_share(spark, d):
    g = _doc_sentences(spark, d).groupBy("source").agg(F.count("*").alias("n_sentences"), F.sum("ai").alias("n_ai"))
    return g.withColumn("ai_sentence_share", F.round(F.col("n_ai") / F.col("n_sentences"), 6))


_SEC = "(SELECT DISTINCT section_id, accession_number, cik, item, source, text FROM sections WHERE text IS NOT NULL AND text <> '')"


def _sec(spark, d):
    return _t(spark, d, "sections").where("text IS NOT NULL AND text <> ''").select("section_id", "accession_number", "cik", "item", "source", "text").distinct()


@query(
    f"""WITH t AS (SELECT accession_number, item, count(*) FILTER (WHERE {_VALID}) AS n FROM (SELECT accession_number, item, trim(unnest({_SPLIT})) AS s FROM {_SEC}) GROUP BY ALL),
w AS (SELECT accession_number, min(n) AS lo, count(*) AS k FROM t GROUP BY 1), u AS (SELECT * FROM t UNION ALL SELECT accession_number, 'all', CASE WHEN k = 3 THEN lo ELSE 0 END FROM w)
SELECT item, count(*) AS n_filings, sum((n >= 25)::INT)::BIGINT AS n_parsed, sum((n >= 5)::INT)::BIGINT AS n_with_five, sum(n)::BIGINT AS n_sentences FROM u GROUP BY item"""
)
def parse_coverage(spark, d):
    s = _sec(spark, d).select("accession_number", "item", F.explode(T.rough_sentences(F.col("text"))).alias("p")).select("accession_number", "item", F.trim("p").alias("s"))
    n = s.groupBy("accession_number", "item").agg(F.sum(T.is_sentence(F.col("s")).cast("int")).alias("n"))
    every = n.groupBy("accession_number").agg(F.min("n").alias("lo"), F.count("*").alias("k")).select("accession_number", F.lit("all").alias("item"), F.when(F.col("k") == len(sections.ITEMS), F.col("lo")).otherwise(0).alias("n"))
    over = lambda k: F.sum((F.col("n") >= k).cast("int"))
    return n.unionByName(every).groupBy("item").agg(F.count("*").alias("n_filings"), over(25).alias("n_parsed"), over(5).alias("n_with_five"), F.sum("n").alias("n_sentences"))


_GATES = filing_sql.gates("text", "item")
_GATES["density"] = f"round({_GATES['density']}, 6)"


@query(f"SELECT section_id, item, {', '.join(f'{v} AS {k}' for k, v in _GATES.items())} FROM {_SEC}")
def narrative_gates(spark, d):
    return sections.gates(_sec(spark, d))


_WS = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH s AS {_SEC}, p AS (SELECT x.section_id AS a, y.section_id AS b, {_WS.format('CASE WHEN length(x.text) <= length(y.text) THEN x.text ELSE y.text END')} AS sh, {_WS.format('CASE WHEN length(x.text) <= length(y.text) THEN y.text ELSE x.text END')} AS lo
  FROM s x JOIN s y ON x.accession_number = y.accession_number AND x.item < y.item)
SELECT a, b, CASE WHEN length(sh) - 200 > 25 THEN list_sum(list_transform(range(25), lambda i: contains(lo, substr(sh, (i * ((length(sh) - 200) // 25) + 1)::BIGINT, 200))::INT)) / 25e0 ELSE 0e0 END AS share FROM p"""
)
def containment(spark, d):
    s = _sec(spark, d)
    x, y = (s.select("accession_number", F.col("section_id").alias(n), F.col("item").alias(f"i{n}"), F.col("text").alias(f"t{n}")) for n in "ab")
    j = x.join(y, "accession_number").where("ia < ib")
    short = F.length("ta") <= F.length("tb")
    return j.select("a", "b", T.containment(F.when(short, F.col("ta")).otherwise(F.col("tb")), F.when(short, F.col("tb")).otherwise(F.col("ta"))).alias("share"))


@query(
    f"""WITH c AS (SELECT DISTINCT accession_number, item, {_WS.format('c')} AS c FROM (SELECT accession_number, item, unnest({_SPLIT.replace('[ \\n\\t\\r]+', '[\\s\\x{a0}]+')}) AS c FROM {_SEC}) WHERE length(c) > 80),
n AS (SELECT accession_number, item, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT a.accession_number, a.item AS ia, b.item AS ib, count(*) AS n_dup FROM c a JOIN c b ON a.accession_number = b.accession_number AND a.c = b.c AND a.item < b.item GROUP BY ALL HAVING count(*) >= 3)
SELECT p.accession_number, ia || '+' || ib AS pair, n_dup, n_dup / greatest(least(x.n, y.n), 1)::DOUBLE AS pct_of_smaller FROM p JOIN n x ON p.accession_number = x.accession_number AND ia = x.item JOIN n y ON p.accession_number = y.accession_number AND ib = y.item"""
)
def duplication_audit(spark, d):
    return sections.duplication_audit(_sec(spark, d))


_LETTERS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"
_TIDY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({0}, '[\\s\\x{{a0}}]+', ' ', 'g')), '^[•●▪·⁌⁍⁃*]+ *', ''), ' *[•●▪·⁌⁍⁃] *', '. ', 'g'), '([.] *){{2,}}', '. ', 'g'))"
)
_KEPT = (
    f"b <> '' AND NOT ({_LETTERS.format('b')} < 5 OR length(regexp_replace(b, '[^\\p{{Lu}}]', '', 'g')) > 0.7 * {_LETTERS.format('b')}) AND NOT (length(b) = 0 OR {_LETTERS.format('b')} < 0.5 * length(b) OR "
    "(length(regexp_replace(b, '[^0-9]', '', 'g')) > 0.15 * length(b) AND len(regexp_extract_all(b, '[$(]?[0-9][0-9,.]*%?[)]?')) >= 3))"
)
_BLOCKS_SQL = f"""(SELECT section_id, unnest(bs) AS block, unnest(range(len(bs))) AS block_no FROM (SELECT section_id, CASE WHEN len(ps) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce(ps, lambda acc, b:
  CASE WHEN NOT regexp_matches(acc, '[.!?:;][''")\\]]*$') AND regexp_matches(substr(b, 1, 1), '\\p{{Ll}}') THEN acc || ' ' || b ELSE acc || chr(30) || b END), chr(30)) END AS bs
  FROM (SELECT section_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {_TIDY.format('x')}), lambda b: {_KEPT}) AS ps FROM {_SEC})))"""


@query(f"SELECT section_id, block_no::INT AS block_no, block FROM {_BLOCKS_SQL}")
def section_blocks(spark, d):
    return sections.section_blocks(_sec(spark, d), ["section_id"])


_VALID_SENTENCES = f"(SELECT section_id, s AS sentence, row_number() OVER (PARTITION BY section_id ORDER BY block_no, i) - 1 AS sentence_idx FROM (SELECT section_id, block_no, trim(unnest(ps)) AS s, unnest(range(len(ps))) AS i FROM (SELECT section_id, block_no, {_SPLIT.replace('text', 'block')} AS ps FROM {_BLOCKS_SQL})) WHERE {_VALID})"


@query(f"SELECT section_id, sentence_idx::INT AS sentence_idx, sentence FROM {_VALID_SENTENCES}")
def section_sentences(spark, d):
    return sections.section_sentences(_sec(spark, d), ["section_id"])


@query(f"SELECT section_id, sentence_idx::INT AS sentence_idx, (sentence_idx - coalesce(lag(sentence_idx) OVER (PARTITION BY section_id ORDER BY sentence_idx), -1) - 1)::INT AS elided FROM {_VALID_SENTENCES} WHERE {_HAS_AI.replace('lower(s)', 'lower(sentence)')}")
def sentence_gaps(spark, d):
    s = sections.section_sentences(_sec(spark, d), ["section_id"])
    return sections.sentence_gaps(s.where(T.mentions(F.col("sentence"))), ["section_id"])


@query(f"WITH r AS (SELECT DISTINCT accession_number, text FROM raw_text WHERE text IS NOT NULL), {filing_sql.candidates('r')} SELECT accession_number, item, md5(body) AS body, n_chars, round(density, 6) AS density, runs_on, sound, strict FROM cand")
def section_candidates(spark, d):
    c = sections.candidates(_t(spark, d, "raw_text").select("accession_number", "text").distinct(), ["accession_number"])
    return c.select("accession_number", "item", F.md5("body").alias("body"), "n_chars", *_r("density"), "runs_on", "sound", "strict").distinct()


@query(filing_sql.assembly("(SELECT DISTINCT accession_number, item, text FROM sections WHERE source = 'edgartools')", "(SELECT DISTINCT accession_number, cik, text FROM raw_text)"))
def section_assembly(spark, d):
    found = _t(spark, d, "sections").where("source = 'edgartools'").select("accession_number", "item", "text").distinct()
    return sections.assemble_sections(found, _t(spark, d, "raw_text").distinct()).select("accession_number", "cik", "item", "source", F.length("text").alias("n_chars"))


# --- scores ------------------------------------------------------------------------------------------------------------------
_W = "list_count(list_filter(string_split_regex(lower(s), '[^a-z]+'), lambda w: w IN ({})))::DOUBLE"
_POS, _NEG = (_W.format(", ".join(repr(w) for w in ws)) for ws in (scoring.POSITIVE, scoring.NEGATIVE))


def _toned(spark, d):
    pos, neu, neg = scoring.lexicon_tone(F.col("s"))
    return scoring.with_labels(_doc_sentences(spark, d).where("ai = 1").withColumns({"pos": pos, "neu": neu, "neg": neg}), scoring.TONE, "neu")


@query(
    f"""WITH t AS (SELECT source, p / (p + n + 1e0) AS pos, 1e0 / (p + n + 1e0) AS neu, n / (p + n + 1e0) AS neg FROM (SELECT source, {_POS} AS p, {_NEG} AS n FROM {_SENTENCES} WHERE {_VALID} AND {_HAS_AI}))
SELECT source, CASE WHEN pos = greatest(pos, neu, neg) THEN 'positive' WHEN neu = greatest(pos, neu, neg) THEN 'neutral' ELSE 'negative' END AS label, count(*) AS n, round((sum(pos) - sum(neg)) / count(*), 6) AS net_tone, round(avg(greatest(pos, neu, neg)), 6) AS confidence FROM t GROUP BY 1, 2"""
)
def tone_labels(spark, d):
    g = _toned(spark, d).groupBy("source", "label").agg(F.count("*").alias("n"), ((F.sum("pos") - F.sum("neg")) / F.count("*")).alias("net_tone"), F.avg("confidence").alias("confidence"))
    return g.select("source", "label", "n", *_r("net_tone", "confidence"))


@query(
    f"""WITH s AS (SELECT DISTINCT sha256(s) AS hash, lang FROM {_SENTENCES} WHERE {_VALID} AND {_HAS_AI}), cache AS (SELECT DISTINCT hash FROM s WHERE substr(hash, 1, 1) < '8')
SELECT coalesce(lang, '?') AS lang, count(*) FILTER (WHERE hash IN (SELECT hash FROM cache)) AS hits, count(*) FILTER (WHERE hash NOT IN (SELECT hash FROM cache)) AS misses FROM s GROUP BY 1"""
)
def score_cache_join(spark, d):
    s = _doc_sentences(spark, d).where("ai = 1").select(F.col("s").alias("sentence"), F.coalesce("lang", F.lit("?")).alias("lang")).distinct()
    cache = s.select(T.text_hash(F.col("sentence")).alias("hash")).where("substr(hash, 1, 1) < '8'").distinct()
    hit, _ = scoring.split_hits(s, cache)
    h = hit.groupBy("lang").agg(F.count("*").alias("hits"))
    return s.groupBy("lang").agg(F.count("*").alias("n")).join(h, "lang", "left").select("lang", F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("n") - F.coalesce("hits", F.lit(0))).alias("misses"))


@query(
    f"""WITH t AS (SELECT accession_number, item, s FROM (SELECT accession_number, item, trim(unnest({_SPLIT})) AS s FROM {_SEC}) WHERE {_VALID}),
tot AS (SELECT accession_number, count(*) FILTER (WHERE item = 'item_1') AS n1, count(*) FILTER (WHERE item = 'item_1a') AS n1a, count(*) FILTER (WHERE item = 'item_7') AS n7 FROM t GROUP BY 1),
sc AS (SELECT accession_number, count(*) AS n_ai, sum((p - n) / (p + n + 1e0)) AS tone FROM (SELECT accession_number, {_POS} AS p, {_NEG} AS n FROM t WHERE item = 'item_7' AND {_HAS_AI}) GROUP BY 1),
f AS (SELECT DISTINCT accession_number, cik FROM filings)
SELECT accession_number, cik, (least(coalesce(n1, 0), coalesce(n1a, 0), coalesce(n7, 0)) >= 5)::INT AS parse_complete, (coalesce(n7, 0) >= 5)::INT AS item_parsed, coalesce(n_ai, 0) AS n_ai_sentences, coalesce(n7, 0) AS n_total_sentences,
  CASE WHEN coalesce(n7, 0) >= 5 THEN (coalesce(n_ai, 0) > 0)::INT::DOUBLE END AS has_ai_mention, round(CASE WHEN coalesce(n7, 0) >= 5 THEN coalesce(n_ai, 0) / n7::DOUBLE END, 6) AS ai_sentence_share, round(CASE WHEN coalesce(n7, 0) >= 5 AND n_ai > 0 THEN tone / n_ai END, 6) AS net_tone
FROM f LEFT JOIN tot USING (accession_number) LEFT JOIN sc USING (accession_number)"""
)
def dimension_features(spark, d):
    s = _sec(spark, d).select("accession_number", "item", F.explode(T.rough_sentences(F.col("text"))).alias("p")).select("accession_number", "item", F.trim("p").alias("s")).where(T.is_sentence(F.col("s")))
    pos, neu, neg = scoring.lexicon_tone(F.col("s"))
    scored = s.where(T.mentions(F.col("s"))).withColumns({"pos": pos, "neu": neu, "neg": neg})
    totals = s.groupBy("accession_number", "item").agg(F.count("*").alias("n_sentences"))
    out = scoring.dimension_features(_t(spark, d, "filings").select("accession_number", "cik").distinct(), totals, scored, "item_7", floor=5)
    return out.withColumns({c: F.round(c, 6) for c in ("ai_sentence_share", "net_tone")})


_AHEAD = _W.format(", ".join(repr(w) for w in scoring.AHEAD))
_FLS_SQL = f"SELECT accession_number, item, p - n AS ignored, (p - n) / (p + n + 1e0) AS sentiment, a / (a + 1e0) AS ahead FROM (SELECT accession_number, item, {_POS} AS p, {_NEG} AS n, {_AHEAD} AS a FROM t WHERE {_HAS_AI})"


def _scored_sentences(spark, d):
    s = _sec(spark, d).select("accession_number", "item", F.explode(T.rough_sentences(F.col("text"))).alias("p")).select("accession_number", "item", F.trim("p").alias("s")).where(T.is_sentence(F.col("s")) & T.mentions(F.col("s")))
    named = zip(("pos", "neu", "neg", "p_specific", "p_nonspecific", "p_not"), (*scoring.lexicon_tone(F.col("s")), *scoring.lexicon_outlook(F.col("s"))))
    return s.withColumns(dict(named))


_T_SQL = f"t AS (SELECT accession_number, item, s FROM (SELECT accession_number, item, trim(unnest({_SPLIT})) AS s FROM {_SEC}) WHERE {_VALID})"


@query(f"WITH {_T_SQL} SELECT accession_number, count(*) AS n_ai, round(avg(ahead), 6) AS fls_score FROM ({_FLS_SQL}) WHERE item = 'item_1a' GROUP BY 1")
def governance_outlook(spark, d):
    g = D.TEXT_DIMENSIONS["governance"]
    s = _scored_sentences(spark, d).where(F.col("item") == g.item).groupBy("accession_number").agg(F.count("*").alias("n_ai"), F.avg(g.value).alias("fls_score"))
    return s.select("accession_number", "n_ai", *_r("fls_score"))


@query(
    f"""WITH {_T_SQL}, sc AS ({_FLS_SQL}), y AS (SELECT 'strategy' AS dimension, accession_number, sentiment AS y FROM sc WHERE item = 'item_1' UNION ALL SELECT 'operations', accession_number, sentiment FROM sc WHERE item = 'item_7' UNION ALL SELECT 'governance', accession_number, ahead FROM sc WHERE item = 'item_1a'),
g AS (SELECT dimension, accession_number, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM y GROUP BY 1, 2),
s AS (SELECT dimension, count(*) AS g, sum(n) AS nn, sum(n * n) AS n2, sum(n * m) AS s1, sum(n * m * m) AS q, sum(n * v) AS ssw, median(n) AS med, sum(n * v) FILTER (WHERE n > 1) / sum(n - 1) FILTER (WHERE n > 1) AS s2, var_samp(m) AS vm, avg(1e0 / n) AS inv FROM g GROUP BY 1),
r AS (SELECT *, ssw / (nn - g) AS msw, greatest(((q - s1 * s1 / nn) / (g - 1) - ssw / (nn - g)) / ((nn - n2 / nn::DOUBLE) / (g - 1)), 1e-12) AS tau2 FROM s)
SELECT dimension, g AS groups, nn::BIGINT AS n, med AS median_n, round(msw, 6) AS msw, round(tau2, 6) AS tau2, round(tau2 / (tau2 + msw), 4) AS icc, CASE WHEN tau2 > 1e-12 THEN round(msw / tau2, 3) END AS k, CASE WHEN vm - s2 * inv > 1e-12 THEN round(s2 / (vm - s2 * inv), 3) END AS k_moments_check FROM r"""
)
def tone_reliability_fit(spark, d):
    f = D.tone_fit(_scored_sentences(spark, d))
    # no spread between filings leaves no ratio
    f = f.withColumns({"k": F.when(F.col("tau2") > 1e-12, F.col("k")), "k_moments_check": F.when(F.col("k_moments_check") < 1e9, F.col("k_moments_check"))})
    return f.select("dimension", "groups", "n", "median_n", *_r("msw", "tau2"), *_r("icc", n=4), *_r("k", "k_moments_check", n=3))


# --- missingness -------------------------------------------------------------------------------------------------------------
_INDS = ["ai_publication_share", "ai_patent_share", "ai_worker_share", "tech_team1_worker_share"]


def _ind(spark, d):
    return _t(spark, d, "indicators").distinct().withColumns({i: I.number(i) for i in _INDS})


def _ind_sql(i: str) -> str:
    return f"SELECT '{i}' AS indicator, count(*) AS n, count(v) AS n_defined, round(100e0 * (count(*) - count(v)) / count(*), 6) AS pct_missing, sum((m = 'unmatched')::INT)::BIGINT AS n_unmatched, sum((m = 'zero_denominator')::INT)::BIGINT AS n_zero_denominator FROM (SELECT {_num(i)} AS v, {i}_reason AS m FROM (SELECT DISTINCT * FROM indicators))"


@query(" UNION ALL ".join(_ind_sql(i) for i in _INDS))
def missingness_table(spark, d):
    x = _ind(spark, d)
    parts = F.array(*(F.struct(F.lit(i).alias("indicator"), F.col(i).alias("v"), shares.mechanism(i).alias("m")) for i in _INDS))
    g = x.select(F.explode(parts).alias("p")).select("p.*").groupBy("indicator")
    n = lambda m: F.sum(F.coalesce(F.col("m") == m, F.lit(False)).cast("int"))
    r = g.agg(F.count("*").alias("n"), F.count("v").alias("n_defined"), n("unmatched").alias("n_unmatched"), n("zero_denominator").alias("n_zero_denominator"))
    return r.select("indicator", "n", "n_defined", F.round(100.0 * (F.col("n") - F.col("n_defined")) / F.col("n"), 6).alias("pct_missing"), "n_unmatched", "n_zero_denominator")


@query(
    f"""WITH t AS (SELECT accession_number, item, s FROM (SELECT accession_number, item, trim(unnest({_SPLIT})) AS s FROM {_SEC}) WHERE {_VALID}),
tot AS (SELECT accession_number, count(*) FILTER (WHERE item = 'item_7') AS n7, count(*) FILTER (WHERE item = 'item_7' AND {_HAS_AI}) AS n_ai FROM t GROUP BY 1),
u AS (SELECT DISTINCT r.rank, f.accession_number FROM (SELECT DISTINCT rank, {_key('company')} AS k FROM fortune) r LEFT JOIN (SELECT DISTINCT accession_number, {_key('company_name')} AS k FROM filings WHERE form = '10-K' AND fiscal_year = 2024) f USING (k)),
x AS (SELECT accession_number, CASE WHEN coalesce(n7, 0) >= 5 THEN 1 ELSE 0 END AS parsed, coalesce(n_ai, 0) AS n_ai FROM u LEFT JOIN tot USING (accession_number))
SELECT 'net_tone' AS indicator, count(*) AS n, count(*) FILTER (WHERE parsed = 1 AND n_ai > 0 AND accession_number IS NOT NULL) AS n_defined, round(100e0 * (count(*) - count(*) FILTER (WHERE parsed = 1 AND n_ai > 0 AND accession_number IS NOT NULL)) / count(*), 6) AS pct_missing,
  0::BIGINT AS n_zero_denominator, 0::BIGINT AS n_unmatched, count(*) FILTER (WHERE accession_number IS NOT NULL AND parsed = 1 AND n_ai = 0) AS n_no_ai_sentences, count(*) FILTER (WHERE accession_number IS NOT NULL AND parsed = 0) AS n_item_unparsed, count(*) FILTER (WHERE accession_number IS NULL) AS n_no_filing FROM x
UNION ALL SELECT * FROM ({" UNION ALL ".join(f"SELECT '{i}', count(*), count(v), round(100e0 * (count(*) - count(v)) / count(*), 6), sum((v IS NULL AND m = 'zero_denominator')::INT)::BIGINT, sum((v IS NULL AND m = 'unmatched')::INT)::BIGINT, 0, 0, 0 FROM (SELECT {_num(i)} AS v, coalesce({i}_reason, '') AS m FROM (SELECT DISTINCT * FROM indicators))" for i in _INDS)})"""
)
def missing_mechanisms(spark, d):
    f = _t(spark, d, "filings").where("form = '10-K' AND fiscal_year = 2024").select("accession_number", N.company_key(F.col("company_name")).alias("k")).distinct()
    u = _t(spark, d, "fortune").select("rank", N.company_key(F.col("company")).alias("k")).distinct().join(f, "k", "left").select("rank", "accession_number").distinct()
    feats = dimension_features(spark, d).select("accession_number", "item_parsed", "n_ai_sentences", "net_tone").dropDuplicates(["accession_number"])
    text = shares.mechanism_counts(u.join(feats, "accession_number", "left"), [], {"net_tone": ("accession_number", "item_parsed", "n_ai_sentences")})
    return text.unionByName(shares.mechanism_counts(_ind(spark, d), _INDS, {}))


_Z = "coalesce({0}_reason = 'zero_denominator', false)"


@query("SELECT record_id, " + ", ".join(f"CASE WHEN {_Z.format(i)} THEN 0e0 ELSE {_num(i)} END AS {i}" for i in _INDS) + ", " + " + ".join(f"({_Z.format(i)})::INT" for i in _INDS) + " AS n_imputed FROM (SELECT DISTINCT * FROM indicators)")
def structural_zeros(spark, d):
    x = shares.fill_structural_zeros(_ind(spark, d), _INDS)
    return x.select("record_id", *_INDS, sum((F.col(f"{i}_imputed").cast("int") for i in _INDS), F.lit(0)).alias("n_imputed"))


@query(
    """WITH x AS (SELECT DISTINCT record_id, industry, CASE WHEN isnan(ai_worker_share) THEN NULL ELSE ai_worker_share END AS v FROM indicators), m AS (SELECT industry, median(v) AS m, count(v) AS n FROM x WHERE industry IS NOT NULL GROUP BY 1)
SELECT record_id, round(coalesce(v, CASE WHEN n >= 5 THEN m END, (SELECT median(v) FROM x)), 9) AS filled FROM x LEFT JOIN m USING (industry)"""
)
def sector_median_impute(spark, d):
    x = shares.sector_median(_ind(spark, d), "ai_worker_share", "industry")
    return x.select("record_id", F.round("ai_worker_share_filled", 9).alias("filled"))


# --- index --------------------------------------------------------------------------------------------------------------------
_COLS = ["acctbal", "n_orders", "total", "largest"]
_CUST_SQL = "cust AS (SELECT c_custkey, c_mktsegment, c_acctbal AS acctbal, n_orders, total, largest FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n_orders, sum(o_totalprice) AS total, max(o_totalprice) AS largest FROM orders GROUP BY 1) ON c_custkey = o_custkey)"


def _cust(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("largest"))
    return _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("acctbal")).join(o, "c_custkey", "left")


@query(
    f"WITH {_CUST_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis, coalesce(abs(skewness({c})) > 2 AND kurtosis({c}) > 3.5, false) AS flag, round(min({c}), 2) AS min, round(quantile_cont({c}, 0.5), 2) AS p50, round(quantile_cont({c}, 0.975), 2) AS p975, round(max({c}), 2) AS max FROM cust"
        for c in _COLS
    )
)
def distribution_table(spark, d):
    m = I.moments(_cust(spark, d), _COLS)
    return m.select("column", "n", *_r("skew", "kurtosis", n=4), "flag", *_r("min", "p50", "p975", "max", n=2))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, power(l_extendedprice / 10000, 4) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN (SELECT abs(skewness(v)) > 2 AND kurtosis(v) > 3.5 FROM x) THEN sqrt(v) ELSE v END, 4) AS v FROM x"
)
def sqrt_treat(spark, d):
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pow(F.col("l_extendedprice") / 10000, F.lit(4)).alias("v"))
    return I.sqrt_skewed(x, ["v"])[0].withColumn("v", F.round("v", 4))


@query(f"WITH {_CUST_SQL} SELECT c_custkey, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in _COLS) + " FROM cust")
def zscore(spark, d):
    return I.normalised(_cust(spark, d), _COLS, "zscore").select("c_custkey", *_r(*_COLS))


@query(f"WITH {_CUST_SQL} SELECT c_custkey, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in _COLS) + " FROM cust")
def minmax(spark, d):
    return I.normalised(_cust(spark, d), _COLS, "minmax").select("c_custkey", *_r(*_COLS))


def _avg_rank(c: str, part: str = "") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 END"


@query(f"WITH {_CUST_SQL} SELECT c_custkey, " + ", ".join(f"round(({_avg_rank(c)} - 1) / (count({c}) OVER () - 1), 6) AS {c}" for c in _COLS) + " FROM cust")
def rankscore(spark, d):
    return I.normalised(_cust(spark, d), _COLS, "rankscore").select("c_custkey", *_r(*_COLS))


@query(f"WITH {_CUST_SQL} SELECT c_custkey, acctbal AS balance__acctbal, n_orders AS orders__n_orders, round(total, 2) AS orders__total FROM cust")
def compose_indicators(spark, d):
    c = _cust(spark, d)
    out = I.compose(c.select("c_custkey"), {"balance": c.select("c_custkey", "acctbal"), "orders": c.where("n_orders IS NOT NULL").select("c_custkey", "n_orders", "total")}, "c_custkey")
    return out.withColumn("orders__total", F.round("orders__total", 2))


_MM = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in _COLS)
_SCORED_SQL = f"""{_CUST_SQL}, mm AS (SELECT c_custkey, {_MM} FROM cust), sc AS (SELECT c_custkey,
  (coalesce(acctbal, 0) + coalesce(n_orders, 0)) / nullif((acctbal IS NOT NULL)::INT + (n_orders IS NOT NULL)::INT, 0) AS score_a, ((acctbal IS NOT NULL)::INT + (n_orders IS NOT NULL)::INT) / 2e0 AS coverage_a,
  (coalesce(total, 0) + coalesce(largest, 0)) / nullif((total IS NOT NULL)::INT + (largest IS NOT NULL)::INT, 0) AS score_b, ((total IS NOT NULL)::INT + (largest IS NOT NULL)::INT) / 2e0 AS coverage_b FROM mm),
ix AS (SELECT *, CASE WHEN coverage_a > 0 AND coverage_b > 0 THEN (score_a + score_b) / 2 * 100 END AS linear, CASE WHEN coverage_a > 0 AND coverage_b > 0 THEN exp((ln(greatest(score_a, 0.01)) + ln(greatest(score_b, 0.01))) / 2) * 100 END AS geometric FROM sc)"""


def _index(spark, d):
    x = I.normalised(_cust(spark, d), _COLS, "minmax")
    (sa, ca), (sb, cb) = I.dimension_score([F.col("acctbal"), F.col("n_orders")]), I.dimension_score([F.col("total"), F.col("largest")])
    x = x.select("c_custkey", sa.alias("score_a"), ca.alias("coverage_a"), sb.alias("score_b"), cb.alias("coverage_b"))
    w = [(F.col(c) > 0).cast("double") for c in ("coverage_a", "coverage_b")]
    s = [F.col("score_a"), F.col("score_b")]
    return x.select("*", I.linear_composite(s, w).alias("linear"), I.geometric_composite(s, w).alias("geometric"))


@query(f"WITH {_SCORED_SQL} SELECT c_custkey, round(score_a, 6) AS score_a, coverage_a, round(score_b, 6) AS score_b, coverage_b FROM sc")
def dimension_scores(spark, d):
    return _index(spark, d).select("c_custkey", *_r("score_a"), "coverage_a", *_r("score_b"), "coverage_b")


@query(f"WITH {_SCORED_SQL} SELECT c_custkey, round(linear, 4) AS linear, round(geometric, 4) AS geometric, CASE WHEN linear IS NOT NULL THEN rank() OVER (ORDER BY round(linear, 4) DESC NULLS LAST)::INT END AS rank FROM ix")
def composite_rank(spark, d):
    x = _index(spark, d).select("c_custkey", *_r("linear", "geometric", n=4))
    return I.competition_rank(x, "linear")


@query(
    f"""WITH {_SCORED_SQL}, q AS (SELECT c_custkey, round(linear, 4) AS m, round(geometric, 4) AS x FROM ix WHERE linear IS NOT NULL), r AS (SELECT {_avg_rank('m')} AS a, {_avg_rank('x')} AS b FROM q)
SELECT 'geometric' AS variant, count(*) AS n_common, round(corr(a, b), 6) AS spearman, round(avg(abs(a - b)), 6) AS mean_shift, max(abs(a - b)) AS max_shift FROM r"""
)
def sensitivity(spark, d):
    x = _index(spark, d).select("c_custkey", *_r("linear", "geometric", n=4))
    return I.rank_shift(x, "c_custkey", "linear", "geometric").select("variant", "n_common", *_r("spearman", "mean_shift"), "max_shift")


# --- statistics -----------------------------------------------------------------------------------------------------------------
@query(
    """WITH g AS (SELECT o_orderpriority AS dim, o_custkey, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT dim, count(*) AS g, sum(n) AS nn, sum(n * n) AS n2, sum(n * m) AS s1, sum(n * m * m) AS q, sum(n * v) AS ssw, median(n) AS med FROM g GROUP BY 1),
r AS (SELECT dim, g, nn, (q - s1 * s1 / nn) / (g - 1) AS msb, ssw / (nn - g) AS msw, (nn - n2 / nn::DOUBLE) / (g - 1) AS n0, med FROM s)
SELECT dim, g AS groups, nn::BIGINT AS n, round(msb / 1e6, 1) AS msb, round(msw / 1e6, 1) AS msw, round(n0, 6) AS n0, med AS median_n FROM r"""
)
def variance_components(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("dim"), "o_custkey", "o_totalprice")
    r = stats.variance_components(o, ["dim"], "o_custkey", "o_totalprice")
    return r.select("dim", "groups", "n", F.round(F.col("msb") / 1e6, 1).alias("msb"), F.round(F.col("msw") / 1e6, 1).alias("msw"), *_r("n0"), "median_n")


_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


@query(f"WITH {_CUST_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) >= 30 THEN corr({a}, {b}) END, 6) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM cust" for a, b in _PAIRS))
def correlation_long(spark, d):
    return stats.correlations(_cust(spark, d), _COLS).select("a", "b", *_r("r"), "n")


@query(f"WITH {_CUST_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM cust" for a, b in _PAIRS) + ") SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) > 0.9")
def double_counting(spark, d):
    return stats.collinear(stats.correlations(_cust(spark, d), _COLS)).select("a", "b", *_r("r"))


_EMB = [f"e{i}" for i in range(5)]
_EMB_SQL = "emb AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(5)) + " FROM embeddings)"


def _emb(spark, d, n: int = 5):
    return _t(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)))


def _alpha_sql(cols: list[str]) -> str:
    k = len(cols)
    r = "(" + " + ".join(f"corr({a}, {b})" for i, a in enumerate(cols) for b in cols[i + 1 :]) + f") / {k * (k - 1) // 2}"
    return f"{k} * ({r}) / (1 + {k - 1} * ({r}))"


@query(f"WITH {_EMB_SQL} SELECT 'all' AS deleted, round({_alpha_sql(_EMB)}, 4) AS alpha FROM emb " + " ".join(f"UNION ALL SELECT '{c}', round({_alpha_sql([x for x in _EMB if x != c])}, 4) FROM emb" for c in _EMB))
def cronbach_alpha(spark, d):
    e = _emb(spark, d)
    rows = [("all", stats.cronbach_alpha(e, _EMB)), *stats.alpha_if_deleted(e, _EMB).items()]
    return spark.createDataFrame(rows, "deleted string, alpha double").withColumn("alpha", F.round("alpha", 4))


@query()
def pca_variance(spark, d):
    return spark.createDataFrame(stats.pca(_emb(spark, d, 64), [f"e{i}" for i in range(64)]))


@query()
def kmo_bartlett(spark, d):
    return spark.createDataFrame([tuple(stats.kmo_bartlett(_emb(spark, d, 64), [f"e{i}" for i in range(64)]).values())], "n long, chi2 double, dof double, p double, kmo double")


@query()
def kmeans_profiles(spark, d):
    cols = [f"e{i}" for i in range(64)]
    return stats.cluster_profiles(D.best_k(stats.kmeans_scan(_emb(spark, d, 64), "vec_id", cols, starts=2))["labels"], cols)


@query(f"WITH {_CUST_SQL}, q AS (SELECT acctbal AS x, total AS y FROM cust WHERE acctbal IS NOT NULL AND total IS NOT NULL), r AS (SELECT {_avg_rank('x')} AS a, {_avg_rank('y')} AS b FROM q) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return stats.spearman(_cust(spark, d), "acctbal", "total").select(*_r("rho"), "n")


@query(
    """WITH e AS (SELECT vec_id, round(embedding[1]::DOUBLE, 1) AS x, round(embedding[2]::DOUBLE, 1) AS y FROM embeddings), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id),
n AS (SELECT count(*) AS n FROM e), t AS (SELECT (SELECT sum(k * (k - 1) / 2e0) FROM (SELECT count(*) AS k FROM e GROUP BY x)) AS tx, (SELECT sum(k * (k - 1) / 2e0) FROM (SELECT count(*) AS k FROM e GROUP BY y)) AS ty)
SELECT round((SELECT sum(s) FROM p) / sqrt((n * (n - 1) / 2e0 - tx) * (n * (n - 1) / 2e0 - ty)), 6) AS tau, n FROM n, t"""
)
def kendall(spark, d):
    e = _t(spark, d, "embeddings").select(F.round(F.col("embedding")[0].cast("double"), 1).alias("x"), F.round(F.col("embedding")[1].cast("double"), 1).alias("y"))
    return stats.kendall(e, "x", "y").select(*_r("tau"), "n")


@query(f"WITH {_CUST_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50, round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM cust" for c in _COLS))
def descriptive_stats(spark, d):
    return stats.describe(_cust(spark, d), _COLS).select("column", "count", *_r("mean", "std", "min", "p25", "p50", "p75", "max", n=2))


_AI_DOC = f"regexp_matches(' ' || lower(text) || ' ', '(^|[^a-z0-9])({'|'.join(T.AI_TERMS)})([^a-z0-9]|$)')::INT"


@query(
    f"""WITH p AS (SELECT {_AI_DOC} AS p, coalesce(lang = 'en', false)::INT AS g FROM documents), c AS (SELECT sum(p * g)::BIGINT AS tp, sum(p * (1 - g))::BIGINT AS fp, sum((1 - p) * g)::BIGINT AS fn, sum((1 - p) * (1 - g))::BIGINT AS tn FROM p)
SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c"""
)
def dictionary_prf(spark, d):
    p = _t(spark, d, "documents").select(T.mentions(F.col("text")).cast("int").alias("p"), F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int").alias("g"))
    return stats.classification(p, "p", "g").select("tp", "fp", "fn", "tn", *_r("precision", "recall", "f1"))


# --- sets, samples, top-k ----------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS r FROM documents) WHERE r <= 10")
def stratified_sample(spark, d):
    s, key = sampling.stratified_sample(_t(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 10)
    return s.join(key, "id").select("doc_id", "source")


@query("SELECT c_custkey, 'cached' AS how FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'fetched' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def seed_and_fetch(spark, d):
    cache = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    have, need = R.known_and_missing(_t(spark, d, "customer").select("c_custkey"), cache, "c_custkey")
    return have.withColumn("how", F.lit("cached")).unionByName(need.withColumn("how", F.lit("fetched")))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 4")
def topk_per_group(spark, d):
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return _t(spark, d, "customer").withColumn("r", r).where("r <= 4").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS value, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def event_json(spark, d):
    e = _t(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.sum("p.k").alias("k"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ledgerloom.streaming.incremental import event_windows as windows

    return windows(_t(spark, d, "events")).withColumn("value", F.round("value", 4))


@query()
def list_merge(spark, d):
    from ledgerloom.operators.fuzzy import merge_lists

    base = _t(spark, d, "fortune").groupBy(F.col("company").alias("name")).agg(F.min("rank").cast("long").alias("row"))
    other = _t(spark, d, "eto_core").groupBy(F.col("eto_name").alias("name")).agg(F.min("eto_id").alias("row"))
    return merge_lists(base, other)


@query()
def html_tables(spark, d):
    raw = _t(spark, d, "raw_text").where(F.lower("text").contains("<table")).select("accession_number", "text").distinct()
    return lists.html_rows(raw, "accession_number", "text")


# --- reliability, variants, skips ----------------------------------------------------------------------------------------------------
@query(
    f"WITH {_CUST_SQL} SELECT c_custkey, round(CASE WHEN coalesce(n_orders, 0) > 0 THEN n_orders / (n_orders + 7.5) ELSE 0 END, 6) AS tone_weight, (total IS NOT NULL)::INT::DOUBLE AS presence FROM cust"
)
def indicator_reliability(spark, d):
    c = _cust(spark, d)
    return c.select("c_custkey", F.round(I.tone_reliability(F.col("n_orders"), 7.5), 6).alias("tone_weight"), I.presence(F.col("total")).alias("presence"))


_DIMS = {"a": ["acctbal", "n_orders"], "b": ["total", "largest"]}


def _variant_sql(name: str, norm: str) -> str:
    cols = ", ".join(f"{norm.format(c=c, r=_avg_rank(c))} AS {c}" for c in _COLS)
    return f"""SELECT '{name}' AS variant, count(*) AS n_common, round(corr(a, b), 4) AS spearman FROM (SELECT {_avg_rank('m')} AS a, {_avg_rank('x')} AS b FROM (
  SELECT main.i AS m, v.i AS x FROM (SELECT c_custkey, linear AS i FROM ix WHERE linear IS NOT NULL) main JOIN (
    SELECT c_custkey, ((coalesce(acctbal, 0) + coalesce(n_orders, 0)) / nullif((acctbal IS NOT NULL)::INT + (n_orders IS NOT NULL)::INT, 0) + (coalesce(total, 0) + coalesce(largest, 0)) / nullif((total IS NOT NULL)::INT + (largest IS NOT NULL)::INT, 0)) / 2 * 100 AS i
    FROM (SELECT c_custkey, {cols} FROM cust)) v USING (c_custkey) WHERE v.i IS NOT NULL))"""


@query(f"WITH {_SCORED_SQL} " + _variant_sql("rankscore", "({r} - 1) / (count({c}) OVER () - 1)") + " UNION ALL " + _variant_sql("zscore", "({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"))
def sensitivity_variants(spark, d):
    from ledgerloom.session import cut

    c = cut(_cust(spark, d))
    made = {how: I.index_variant(c, "c_custkey", _DIMS, how) for how in ("rankscore", "zscore")}
    return I.sensitivity(I.index_variant(c, "c_custkey", _DIMS), made, "c_custkey").select("variant", "n_common", F.round("spearman", 4).alias("spearman"))


@query("SELECT DISTINCT cik, CASE WHEN cik IN (SELECT cik FROM filings WHERE form = '10-K') THEN 'no filing of the year' ELSE 'no filing of the form' END AS reason FROM filings WHERE cik NOT IN (SELECT cik FROM filings WHERE form = '10-K' AND fiscal_year = 2024)")
def filing_skips(spark, d):
    f = _t(spark, d, "filings").select("cik", "form", "fiscal_year").distinct()
    _, skipped = R.known_and_missing(f.select("cik").distinct(), R.latest_filings(f.withColumns({"filing_date": F.lit(""), "accession_number": F.lit("")}), "10-K", 2024), "cik")
    form = f.where("form = '10-K'").select("cik").distinct().withColumn("_f", F.lit(True))
    return skipped.join(form, "cik", "left").select("cik", F.when(F.col("_f"), "no filing of the year").otherwise("no filing of the form").alias("reason"))


@query(f"WITH {_SCORED_SQL} SELECT ix.c_custkey, round(linear, 4) AS linear, n_orders AS outside FROM ix LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON ix.c_custkey = o_custkey")
def modeling_frame(spark, d):
    scores = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("outside"))
    return I.modeling_frame(_index(spark, d).select("c_custkey", *_r("linear", n=4)), scores, "c_custkey")


# --- filings of a universe, sets, frames side by side ------------------------------------------------------------------------
_U_SQL = f"""u AS (SELECT DISTINCT company, ticker, CASE WHEN lower(trim(ticker)) IN ('', 'nan', 'none', '-', '~') OR ticker IS NULL THEN NULL ELSE {_tick('ticker')} END AS t FROM fortune),
f AS (SELECT DISTINCT lpad(trim(cik), 10, '0') AS cik, {_tick('ticker')} AS t, accession_number, fiscal_year, filing_date, form FROM filings),
byt AS (SELECT t, min(cik) AS cik FROM f WHERE t <> '' GROUP BY 1 HAVING min(cik) = max(cik)), x AS (SELECT company, ticker, u.t, byt.cik FROM u LEFT JOIN byt ON u.t = byt.t),
per AS (SELECT cik, count(*) FILTER (WHERE form = '10-K') AS e, count(*) FILTER (WHERE form = '10-K' AND fiscal_year = 2024) AS y FROM f GROUP BY 1)"""


@query(f"WITH {_U_SQL} SELECT company AS company_name, ticker, x.cik, accession_number, fiscal_year, filing_date FROM x JOIN per USING (cik) JOIN (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS r FROM f WHERE form = '10-K' AND fiscal_year = 2024) l ON x.cik = l.cik AND r = 1")
def resolved_filings(spark, d):
    u = _t(spark, d, "fortune").select("company", "ticker", "normalized_company_name")
    return inputs.resolve_filings(u, _t(spark, d, "filings"), 2024)[0].select("company_name", "ticker", "cik", "accession_number", "fiscal_year", "filing_date").distinct()


@query(f"WITH {_U_SQL} SELECT company, ticker, CASE WHEN t IS NULL THEN 'no ticker' WHEN x.cik IS NULL OR e IS NULL THEN 'lookup failed' WHEN e = 0 THEN 'only amendments' ELSE 'no filing of the year' END AS reason FROM x LEFT JOIN per USING (cik) WHERE coalesce(y, 0) = 0")
def unresolved_filings(spark, d):
    u = _t(spark, d, "fortune").select("company", "ticker", "normalized_company_name")
    return inputs.resolve_filings(u, _t(spark, d, "filings"), 2024)[1].distinct()


@query("SELECT cik FROM filings WHERE cik IS NOT NULL INTERSECT SELECT cik FROM sections")
def shared_ciks(spark, d):
    return inputs.in_both(_t(spark, d, "filings"), _t(spark, d, "sections"), "cik")


@query("SELECT accession_number, f.form AS filing__form, r.n_chars AS raw__n_chars FROM (SELECT accession_number, max(form) AS form FROM filings GROUP BY 1) f FULL JOIN (SELECT accession_number, max(length(text)) AS n_chars FROM raw_text GROUP BY 1) r USING (accession_number)")
def filings_beside_texts(spark, d):
    f = _t(spark, d, "filings").groupBy("accession_number").agg(F.max("form").alias("form"))
    r = _t(spark, d, "raw_text").groupBy("accession_number").agg(F.max(F.length("text")).alias("n_chars"))
    return inputs.beside({"filing": f, "raw": r}, ["accession_number"])


@query(f"WITH {_CUST_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM cust" for n, (a, b) in _DIMS.items()))
def within_dimension_correlation(spark, d):
    return D.within_correlations(_cust(spark, d), {n: tuple(c) for n, c in _DIMS.items()}).select("dimension", "a", "b", *_r("r"), "n")


@query(f"WITH {_SCORED_SQL} SELECT c_mktsegment AS cluster, round(avg(linear), 4) AS mean_linear, count(*) AS n FROM ix JOIN (SELECT c_custkey, c_mktsegment FROM customer) USING (c_custkey) GROUP BY 1")
def cluster_mean_index(spark, d):
    x = _index(spark, d).join(_t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("cluster")), "c_custkey")
    return D.cluster_means(x, "linear").select("cluster", *_r("mean_linear", n=4), "n")


# --- the eight ways to build the index -----------------------------------------------------------------------------------------
_K = 7.5
_SKEWED = "(abs(skewness({c})) > 2 AND kurtosis({c}) > 3.5)"


def _treated_sql(src: str, out: str) -> str:
    return f"{out} AS (SELECT c_custkey, n_sent, " + ", ".join(f"CASE WHEN (SELECT coalesce({_SKEWED.format(c=c)}, false) FROM {src}) THEN sqrt({c}) ELSE {c} END AS {c}" for c in _V_COLS) + f" FROM {src})"


_V_COLS = ["n_orders", "total", "largest", "level"]
_V_DIMS = {"a": ["n_orders", "level"], "b": ["total", "largest"]}
_V_BASE = "v0 AS (SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_sent, n_orders, total, largest, acctbal + 1000 AS level FROM cust)"
_V_FILL = "vm AS (SELECT c_mktsegment, " + ", ".join(f"median({c}) AS m_{c}, count({c}) AS k_{c}" for c in _V_COLS) + " FROM v0 GROUP BY 1), vf AS (SELECT c_custkey, n_sent, " + ", ".join(f"coalesce({c}, CASE WHEN k_{c} >= 5 THEN m_{c} END, (SELECT median({c}) FROM v0)) AS {c}" for c in _V_COLS) + " FROM v0 LEFT JOIN vm USING (c_mktsegment))"


def _way_sql(name: str, src: str, times: float | None, norm: str = "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", aggregate: str = "linear", coverage: bool = False) -> str:
    norms = ", ".join(f"{norm.format(c=c, r=_avg_rank(c))} AS {c}" for c in _V_COLS)
    w = {c: f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {f'CASE WHEN n_sent > 0 THEN n_sent / (n_sent + {_K * times}) ELSE 0e0 END' if times and c == 'n_orders' else '1e0'} END" for c in _V_COLS}
    dims = ", ".join(f"({' + '.join(f'coalesce({c}, 0) * {w[c]}' for c in cs)}) / nullif({' + '.join(w[c] for c in cs)}, 0) AS s_{n}, ({' + '.join(w[c] for c in cs)}) / 2e0 AS c_{n}" for n, cs in _V_DIMS.items())
    by = {n: f"c_{n}" if coverage else f"(c_{n} > 0)::INT" for n in _V_DIMS}
    mean = f"(s_a * {by['a']} + s_b * {by['b']}) / ({by['a']} + {by['b']}) * 100" if aggregate == "linear" else f"exp((ln(greatest(s_a, 0.01)) * {by['a']} + ln(greatest(s_b, 0.01)) * {by['b']}) / ({by['a']} + {by['b']})) * 100"
    return f"SELECT c_custkey, '{name}' AS variant, CASE WHEN c_a > 0 AND c_b > 0 THEN {mean} END AS i FROM (SELECT c_custkey, {dims} FROM (SELECT c_custkey, n_sent, {norms} FROM {src}))"


_WAYS_SQL = " UNION ALL ".join([
    _way_sql("main", "vt", 1.0), _way_sql("coverage_weighted", "vt", 1.0, coverage=True), _way_sql("no_reliability", "vt", None), _way_sql("k_doubled", "vt", 2.0), _way_sql("no_treatment", "v0", 1.0),
    _way_sql("rank_norm", "vt", 1.0, norm="({r} - 1) / (count({c}) OVER () - 1)"), _way_sql("geometric", "vt", 1.0, aggregate="geometric"), _way_sql("sector_median", "vft", None),
])


@query(f"WITH {_CUST_SQL}, {_V_BASE}, {_V_FILL}, {_treated_sql('v0', 'vt')}, {_treated_sql('vf', 'vft')} SELECT c_custkey, variant, round(i, 4) AS index FROM ({_WAYS_SQL})".replace(" AS index", ' AS "index"'))
def index_variants(spark, d):
    from ledgerloom.session import cut

    c = cut(_cust(spark, d).withColumns({"n_sent": F.coalesce("n_orders", F.lit(0.0)), "level": F.col("acctbal") + 1000}).drop("acctbal"))
    filled = c
    for x in _V_COLS:
        filled = shares.sector_median(filled, x, "c_mktsegment").drop(x).withColumnRenamed(f"{x}_filled", x)
    made = D.index_variants(c, "c_custkey", _V_DIMS, {"n_orders": ("n_sent", _K)}, filled)
    return made.select("c_custkey", "variant", F.round("index", 4).alias("index"))
