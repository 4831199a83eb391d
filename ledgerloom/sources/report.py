"""HTML reviews of small result tables."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "<style>body{font:14px sans-serif}td,th{padding:2px 8px;border-bottom:1px solid #ccc}.missing{background:#eee}.zero{background:#fd9}.over{background:#f99}.gap{color:#888}</style>"


def page(title: str, body: str) -> str:
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title>{STYLE}<h1>{escape(title)}</h1>{body}"


def table(rows: list[dict], columns: list[str], css: dict[str, str] | None = None) -> str:
    """A table; ``css`` names for a column the field with its cell class."""
    css = css or {}
    cell = lambda r, c: f"<td class='{escape(r.get(css.get(c, ''), '') or '')}'>{'' if r.get(c) is None else escape(f'{r[c]:.4g}' if isinstance(r[c], float) else str(r[c]))}</td>"
    return "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + "</tr>" + "".join("<tr>" + "".join(cell(r, c) for c in columns) + "</tr>" for r in rows) + "</table>"


def share_class(share: Column, reason: Column) -> Column:
    """How a share is shown: missing, zero denominator, above one."""
    return F.when(reason == "zero_denominator", "zero").when(share.isNull(), "missing").when(share > 1, "over").otherwise("")


def _rows(df: DataFrame, most: int) -> list[dict]:
    got = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a review shows at most {most} rows; filter the table first")
    return got


def inputs_review(inputs: DataFrame, shares: list[str], key: str = "company_name", most: int = 2000) -> str:
    marked = inputs.withColumns({f"_c_{s}": share_class(F.col(s), F.col(f"{s}_reason")) for s in shares})
    return page("Structured inputs", table(_rows(marked.orderBy(key), most), [key, *shares], {s: f"_c_{s}" for s in shares}))


def sentence_review(flagged: DataFrame, most: int = 5000) -> str:
    """Dictionary sentences (company_name, item, source, sentence_idx, elided, sentence) in document order, with the
    number of sentences left out between them and the section's source."""
    out, last = [], None
    for r in _rows(flagged.orderBy("company_name", "item", "sentence_idx"), most):
        if (r["company_name"], r["item"]) != last:
            out.append(f"<h2>{escape(r['company_name'])} – {escape(r['item'])} <small>[{escape(r['source'] or '')}]</small></h2>")
            last = (r["company_name"], r["item"])
        out.append((f"<p class=gap>… {r['elided']} …</p>" if r["elided"] else "") + f"<p>{escape(r['sentence'])}</p>")
    return page("AI sentences", "".join(out))


def index_report(result: DataFrame, dims: list[str], details: dict[str, list[str]] | None = None, most: int = 5000) -> str:
    """Ranked firms with their dimension scores, and those without a rank with the dimensions they lack. ``details`` names
    the columns behind a dimension: each ranked firm then opens to its scores, coverage and indicators."""
    lacking = F.array_join(F.filter(F.array(*(F.when(F.coalesce(f"coverage_{d}", F.lit(0.0)) == 0, d) for d in dims)), lambda x: x.isNotNull()), ", ")
    df = result.withColumn("lacks", lacking)
    ranked = _rows(df.where("rank IS NOT NULL").orderBy("rank", "company_name"), most)
    rest = _rows(df.where("rank IS NULL").orderBy("company_name"), most)
    below = ""
    for r in ranked if details else []:
        parts = [{"dimension": d, "score": r[f"score_{d}"], "coverage": r[f"coverage_{d}"], "indicator": c, "value": r[c]} for d in dims for c in details.get(d, [])]
        below += f"<details><summary>{escape(str(r['rank']))}. {escape(r['company_name'])}</summary>{table(parts, ['dimension', 'score', 'coverage', 'indicator', 'value'])}</details>"
    top = table(ranked, ["rank", "company_name", "index_0_100", *(f"score_{d}" for d in dims), "cluster_label"])
    return page("Index", top + (f"<h2>Behind the scores</h2>{below}" if below else "") + "<h2>Excluded</h2>" + table(rest, ["company_name", "lacks"]))
