"""Markup residue in text documents (problem 1).

HTML, Markdown, wiki and LaTeX, whole or in remnants, become clean text whose headings, lists, tables, code and
formulas stay marked as such. Site templates go first: every element of a page (an HTML element with all below
it, or a block of another notation) is hashed as a subtree, subtrees are counted per host in Spark, and those that
recur across many pages of one host are deleted from its pages. Headings are never deleted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ledgerloom.session import cut

# --- fixed values ---------------------------------------------------------------------------------------------
TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main "
    "map mark math meta nav nowiki ol option p page pre q ref references s samp script section select small source span strike "
    "strong style sub summary sup syntaxhighlight table tbody td template text textarea tfoot th thead title tr tt u ul var video "
    "document type sequence filename description"
).split()
TEX = (
    "begin end section subsection subsubsection chapter paragraph part title author date maketitle documentclass usepackage item emph textbf "
    "textit texttt textsc textrm underline footnote cite citep citet ref label caption url href frac sqrt sum prod int alpha beta gamma delta "
    "lambda mu sigma cdot times leq geq neq infty left right mathrm mathbf text hline newline newpage noindent centering includegraphics "
    "tableofcontents appendix input par quad qquad small large bf it"
).split()
ENTITY_WORDS = "amp lt gt quot apos nbsp mdash ndash hellip ldquo rdquo lsquo rsquo laquo raquo bull copy reg trade sect para middot deg plusmn times divide euro pound yen cent shy ensp emsp thinsp".split()

_TAG = r"<!--|-->|<!DOCTYPE[^>]*>|<\?xml[^>]*>|<!\[CDATA\[|\]\]>|</?(?:%s)(?![A-Za-z0-9-])(?:\s[^<>]*|\s*)/?(?:>|$)" % "|".join(TAGS)
_ANY_TAG = r"</[A-Za-z][A-Za-z0-9:-]*\s*>|<[A-Za-z][A-Za-z0-9:-]*(?:\s+[A-Za-z_:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))+\s*/?>|<[A-Za-z][A-Za-z0-9:-]*\s*/>"
_ENT = r"&(?:%s|[A-Za-z]{2,8}(?=;)|\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6});" % "|".join(ENTITY_WORDS)
KINDS = (
    ("tag", f"(?i:{_TAG})|{_ANY_TAG}"),
    ("entity", _ENT),
    ("fence", r"(?m:^[ \t]*(?:```|~~~).*$)"),
    ("tex_env", r"\\(?:begin|end)\s*\{[A-Za-z*]*\}?"),
    ("tex_math", r"\$\$|\\\[|\\\]|\\\(|\\\)|\$(?=[^\s$])[^$\n]{0,120}?[\\^_{}][^$\n]{0,120}?(?<=[^\s$])\$(?!\d)|\$[A-Za-z]\$"),
    ("tex_cmd", r"\\(?:%s)(?![A-Za-z])\*?|(?<![\w:\\/.])\\[A-Za-z]+(?=\s*[\[{])|\\\\(?=\s|$)|(?<!\w)\\[%%&$#_{}]" % "|".join(TEX)),
    ("wiki_link", r"\[\[|\]\]|\[https?://[^\s\]]+[^\]\n]*\]"),
    ("wiki_template", r"\{\{|\}\}"),
    ("wiki_table", r"(?m:^[ \t]*(?:\{\||\|\}|\|-+[ \t]*$|\|\+|!\s.*!!))|(?<=\S)[ \t]*\|\|[ \t]*(?=\S)"),
    ("wiki_heading", r"(?m:^={2,6}[ \t]*[^=\n]+?[ \t]*={2,6}[ \t]*$)"),
    ("wiki_quote", r"'{2,5}(?=[^\s'])|(?<=[^\s'])'{2,5}"),
    ("wiki_word", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|(?im:^\#REDIRECT\b)"),
    ("md_heading", r"(?m:^[ ]{0,3}\#{1,6}[ \t]+(?=\S))"),
    ("md_setext", r"(?m:(?<=\S\n)^(?:={3,}|-{3,})[ \t]*$)"),
    ("md_rule", r"(?m:^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$)"),
    ("md_link", r"!?\[[^\[\]\n]*\]\((?!\s)[^()\s]*(?:\s+\"[^\"\n]*\")?\)|!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?m:^\[[^\]\n]+\]:\s*\S+)|<https?://[^\s<>]+>"),
    ("md_table", r"(?m:^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)|(?m:^[ \t]*\|(?![-}+]).*\|[ \t]*$)"),
    ("md_strike", r"~~(?=\S)|(?<=\S)~~"),
    ("md_code", r"`+"),
    ("md_bold", r"(?<![\w*])\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}(?![\w*])|(?<![\w_])_{2,3}(?=[^\s_])|(?<=[^\s_])_{2,3}(?![\w_])"),
    ("md_italic", r"(?<![\w*])\*(?=[^\s*.,;:)])[^*\n]{1,200}?(?<=[^\s*(])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]{1,200}?(?<=[^\s_])_(?![\w_])"),
    ("md_list", r"(?m:^[ \t]*(?:[-*+])[ \t]+(?=\S))"),
    ("md_quote", r"(?m:^[ ]{0,3}>[ \t]+(?=\S))"),
)
_TAGS = re.compile(f"(?i:{_TAG})|{_ANY_TAG}")
# every construct starts at a line start or with one of these signs
SCAN = re.compile(r"(?:(?<=\n)|(?<![\s\S])|(?=[ \t]*\|\||[<&\\$\[\]{}|!'_#*~`=>+-]))(?:" + "|".join(f"(?P<{n}>{p})" for n, p in KINDS) + ")")
BLOCK = set("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul syntaxhighlight math title head".split())
VOID = set("br hr img input meta link col source".split())
SKIP = set("script style head template".split())
_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9]*)")
_BLOCKS = re.compile(r"\n[ \t]*\n+")
# parts of a line or a row: what they hold is judged as part of the block around them
PARTS = set("a abbr b big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup td th tt u var".split())
_HEAD = re.compile(r"(?i)^\s*(?:#|=|\\(?:sub)*section|<h[1-6]|item\s+\d)")


def constructs(text: str) -> list[tuple[str, int, int]]:
    """Every markup construct of ``text``, stray and unpaired ones included: kind, start, end."""
    out = [(m.lastgroup, m.start(), m.end()) for m in SCAN.finditer(text)]
    # a dash list is markup only beside other markup or as a list of several lines
    lists = [x for x in out if x[0] == "md_list"]
    if lists and len(lists) < 2 and len(lists) == len(out):
        return []
    return out


def subtrees(text: str) -> list[tuple[int, int, int]]:
    """(hash, start, end) of every element below the root: closed HTML elements, and blocks of other notations."""
    out, stack = [], []
    norm = lambda s: re.sub(r"\s+", " ", s).strip()
    for m in _TAGS.finditer(text) if "<" in text else ():
        if m.group().startswith(("<!", "<?", "-->", "]]")):
            continue
        name = _NAME.match(m.group())
        if not name or name[1].lower() in VOID or m.group().endswith("/>"):
            continue
        n = name[1].lower()
        if m.group().startswith("</"):
            if any(x == n for x, _ in stack):
                while stack:
                    x, s = stack.pop()
                    if x == n:
                        if n not in ("html", "body"):
                            out.append((n, s, m.end()))
                        break
        else:
            stack.append((n, m.start()))
    pos = 0
    for b in [*_BLOCKS.finditer(text), None]:
        end = b.start() if b else len(text)
        if end > pos:
            out.append(("block", pos, end))
        pos = b.end() if b else end
    res = []
    for n, s, e in out:
        body = norm(text[s:e])
        if re.search(r"\w", _TAGS.sub("", body)) and n not in PARTS and n not in ("h1", "h2", "h3", "h4", "h5", "h6") and not _HEAD.match(body) and not re.fullmatch(r"(?i)(?:<b>|\*\*)?item .{1,60}", body):
            res.append((xxhash.xxh64_intdigest(body) - (1 << 63), s, e))
    return res


def _template(m: re.Match) -> str:
    """What a wiki template says: its arguments, named ones behind their names."""
    args = [a.strip() for a in m[1].split("|")[1:]]
    return " ".join(re.sub(r"^([\w -]+?)\s*=\s*", r"\1: ", a) for a in args if a and not a.endswith("="))


# without one of these signs a stretch of text holds no inline markup
_SIGNS = re.compile(r"[<&\\\[\]{}`*_~]|''|-->")


def _inline(s: str) -> str:
    """Inline markup to text. Notes stay in brackets, templates with their arguments; citation keys and labels go."""
    if not _SIGNS.search(s):
        return re.sub(r"[ \t\xa0]+", " ", s).strip()
    if "<" in s or "-->" in s:
        s = re.sub(r"<!--.*?-->|<!--|-->", "", s, flags=re.S)
        s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
        s = re.sub(r"<ref\b[^<>]*/>", "", s, flags=re.I)
        s = re.sub(r"\s*<ref\b[^<>]*>(.*?)</ref>", r" (\1)", s, flags=re.I | re.S)
        s = SCAN.sub(lambda m: "" if m.lastgroup == "tag" else m.group(), s)
    while "{{" in s and (t := re.sub(r"\{\{([^{}]*)\}\}", _template, s)) != s:
        s = t
    if "[" in s:
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        s = re.sub(r"\[https?://[^\s\]]+\s*([^\]\n]*)\]", r"\1", s)
        s = re.sub(r"!?\[([^\[\]\n]*)\]\((?!\s)[^()\s]*(?:\s+\"[^\"\n]*\")?\)", r"\1", s)
        s = re.sub(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", s)
    if "\\" in s:
        s = re.sub(r"\\(?:cite[pt]?|label|ref)\*?\s*\{[^{}]*\}", "", s)
        s = re.sub(r"\s*\\footnote\*?\s*\{([^{}]*)\}", r" (\1)", s)
        s = re.sub(r"\\(?:emph|text[a-z]{2}|underline|url|mathrm|title|author|date)\*?\s*\{([^{}]*)\}", r"\1", s)
        s = re.sub(r"\\(?:emph|text[a-z]{2}|underline|footnote)\*?\s*\{?", "", s)
    s = re.sub(r"~~|`+|\[\[|\]\]|\{\{|\}\}|'{2,5}(?=[^\s'])|(?<=[^\s'])'{2,5}", "", s)
    s = re.sub(r"(?<![\w*])\*{1,3}(?=[^\s*.,;:)])([^*\n]+?)(?<=[^\s*(])\*{1,3}(?![\w*])", r"\1", s)
    s = re.sub(r"(?<![\w_])_{1,3}(?=[^\s_])([^_\n]+?)(?<=[^\s_])_{1,3}(?![\w_])", r"\1", s)
    s = re.sub(r"(?<![\w*])\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}(?![\w*])|(?<![\w_])_{2}(?=[^\s_])|(?<=[^\s_])_{2}(?![\w_])", "", s)
    s = re.sub(r"\\([%&$#_{}])", r"\1", s)
    s = html.unescape(s) if "&" in s else s
    return re.sub(r"[ \t\xa0]+", " ", s).strip()


def to_blocks(text: str) -> list[tuple[str, str]]:
    """The text as (kind, text) in order; kinds: heading, paragraph, list_item, table_row, code, formula."""
    keep: list[tuple[str, str]] = []

    def hold(kind: str, body: str) -> str:
        keep.append((kind, body))
        return f"\n\n\x00{len(keep) - 1}\x00\n\n"

    t = re.sub(r"<(script|style)\b.*?</\1\s*>", "", text, flags=re.I | re.S)
    t = re.sub(r"<title\b[^<>]*>(.*?)</title\s*>", lambda m: hold("heading", _inline(m[1])), t, flags=re.I | re.S)
    code = lambda m: hold("code", html.unescape(re.sub(r"</?code[^<>]*>", "", m[1], flags=re.I)).strip("\n"))
    t = re.sub(r"(?m)^[ \t]*```[^\n]*\n(.*?)^[ \t]*```[ \t]*$", code, t, flags=re.S)
    t = re.sub(r"<pre\b[^<>]*>(.*?)</pre\s*>", code, t, flags=re.I | re.S)
    t = re.sub(r"<syntaxhighlight\b[^<>]*>(.*?)</syntaxhighlight\s*>", code, t, flags=re.I | re.S)
    t = re.sub(r"\\begin\{(?:verbatim|lstlisting)\*?\}(?:\[[^\]]*\])?(.*?)\\end\{(?:verbatim|lstlisting)\*?\}", code, t, flags=re.S)
    t = re.sub(r"(?m)(?:^(?: {4}|\t)\S[^\n]*(?:\n|$))(?:^(?: {4}|\t)[^\n]*(?:\n|$))*", lambda m: hold("code", m[0].rstrip()), t)
    math = lambda m: hold("formula", m[1].strip())
    t = re.sub(r"<math\b[^<>]*>(.*?)</math\s*>", math, t, flags=re.I | re.S)
    t = re.sub(r"\$\$(.+?)\$\$", math, t, flags=re.S)
    t = re.sub(r"\\\[(.+?)\\\]", math, t, flags=re.S)
    t = re.sub(r"\\begin\{(?:equation|align|displaymath)\*?\}(.*?)\\end\{(?:equation|align|displaymath)\*?\}", math, t, flags=re.S)
    rows = lambda sep: lambda m: "".join(hold("table_row", " | ".join(c for c in (_inline(x) for x in re.split(sep, r)) if c)) for r in re.split(r"\\\\|\n\|-+[^\n]*", re.sub(r"\\hline", "", m[1])) if r.strip(" \n|&"))
    t = re.sub(r"\\begin\{tabular\}\{[^{}]*\}(.*?)\\end\{tabular\}", rows(r"(?<!\\)&"), t, flags=re.S)
    t = re.sub(r"(?m)^\{\|[^\n]*(.*?)^\|\}", rows(r"\|\||!!|(?:^|\n)[|!]"), t, flags=re.S)
    t = re.sub(r"<tr\b[^<>]*>(.*?)(?:</tr\s*>|(?=<tr\b|</table|$))", lambda m: hold("table_row", " | ".join(_inline(c) for c in re.split(r"</t[dh]\s*>|<t[dh]\b[^<>]*>", m[1], flags=re.I) if c.strip())), t, flags=re.I | re.S)
    head = lambda m: hold("heading", _inline(m[1]))
    t = re.sub(r"<h[1-6]\b[^<>]*>(.*?)</h[1-6]\s*>", head, t, flags=re.I | re.S)
    t = re.sub(r"(?m)^={2,6}[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$", head, t)
    t = re.sub(r"(?m)^ {0,3}#{1,6}[ \t]+([^\n]+?)[ \t]*#*$", head, t)
    t = re.sub(r"(?m)^([^\n]+)\n(?:={3,}|-{3,})[ \t]*$", head, t)
    t = re.sub(r"\\(?:sub)*(?:section|chapter|paragraph)\*?\{([^{}]*)\}", head, t)
    t = re.sub(r"<li\b[^<>]*>(.*?)(?=</li|<li\b|</[uo]l|\n\n|$)", lambda m: hold("list_item", _inline(m[1])), t, flags=re.I | re.S)
    t = re.sub(r"\\item\b\s*(?:\[[^\]]*\])?([^\n]*)", lambda m: hold("list_item", _inline(m[1])), t)
    t = re.sub(r"(?m)^[ \t]*(?:[-*+•‣▪#]{1,3}|\d+[.)])[ \t]+(\S[^\n]*)$", lambda m: hold("list_item", _inline(m[1])), t)
    t = re.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", "", t)
    t = re.sub(r"(?m)^[ \t]*\|(.*)\|[ \t]*$", lambda m: hold("table_row", " | ".join(_inline(c) for c in m[1].split("|"))), t)
    t = re.sub(r"\\(?:begin|end)\s*\{[A-Za-z*]*\}?(?:\[[^\]]*\])?|\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^{}]*\}|\\maketitle|\\hline|\\noindent", "\n\n", t)
    t = re.sub(r"</?(?:%s)\b[^<>]*>" % "|".join(sorted(BLOCK)), "\n\n", t, flags=re.I)
    out = []
    for b in re.split(r"\n\s*\n", t):
        if m := re.fullmatch(r"\s*\x00(\d+)\x00\s*", b):
            kind, body = keep[int(m[1])]
            out += [(kind, re.sub(r"\s*\x00\d+\x00\s*", " ", body))] if body.strip() else []
        else:
            # columns set off by blanks make a line a table row; blanks are still as they were typed
            plain, body = [], re.sub(r"\x00\d+\x00", "", b)
            for line in [*body.split("\n"), None]:
                row = line is not None and re.search(r"\S(?: {2,}|\t)\S", line.strip()) and not re.search(r"[.!?] {2,}\S", line)
                if (row or line is None) and (x := _inline("\n".join(plain))):
                    out.append(("paragraph", x))
                if row:
                    out.append(("table_row", " | ".join(c for c in (_inline(c) for c in re.split(r" {2,}|\t", line.strip())) if c)))
                plain = [] if row or line is None else [*plain, line]
    return out


def render(blocks: list[tuple[str, str]]) -> str:
    """Blocks as plain text: list items behind a bullet, code indented, formulas and the rest as they are."""
    lines, prev = [], ""
    for kind, b in blocks:
        if lines and not (kind == prev and kind in ("list_item", "table_row")):
            lines.append("")
        lines.append("• " + b if kind == "list_item" else "\n".join("    " + x for x in b.split("\n")) if kind == "code" else b)
        prev = kind
    return "\n".join(lines)


def recurring_subtrees(pages: DataFrame, host: str, page: str, min_pages: int = 5, share: float = 0.3, sizes_of: DataFrame | None = None) -> DataFrame:
    """``(host, h, n_pages, host_pages)``: subtrees on at least ``min_pages`` pages and ``share`` of the host's pages. Null
    hosts are one host. Pages and subtrees are counted by aggregates that combine before the shuffle, so a host may
    hold any share of the rows."""
    per = pages.select(host, page, F.explode(F.array_distinct(F.transform("subtrees", lambda s: s.h))).alias("h")).distinct().groupBy(host, "h").agg(F.count("*").alias("n_pages"))
    # a host's pages are counted without the subtrees
    sizes = (sizes_of if sizes_of is not None else pages).select(F.col(host).alias("_host"), page).distinct().groupBy("_host").agg(F.count("*").alias("host_pages"))
    j = per.where(F.col("n_pages") >= min_pages).join(sizes, F.col(host).eqNullSafe(F.col("_host")))
    return j.where(F.col("n_pages") >= share * F.col("host_pages")).select(host, "h", "n_pages", "host_pages")


def _pages(src: DataFrame, page: str, host: str) -> DataFrame:
    """``(page, host, _version, subtrees)`` of every text."""
    tree = StructType([StructField("h", LongType()), StructField("s", IntegerType()), StructField("e", IntegerType())])
    schema = StructType([src.schema[page], src.schema[host], StructField("_version", LongType()), StructField("subtrees", ArrayType(tree))])
    arrow = to_arrow_schema(schema)

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            trees = [[{"h": h, "s": s, "e": e} for h, s, e in subtrees(t)] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(page).cast(arrow[0].type), b.column(host).cast(arrow[1].type), b.column("_version"), pa.array(trees, arrow[3].type)], schema=arrow)

    # hashes and places are small beside the texts; they are read several times and made once
    return cut(src.mapInArrow(parse, schema))


def _source(df: DataFrame, page: str, host: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(page, host, F.col(text).alias("_text"), F.xxhash64(text).alias("_version"))


def site_templates(df: DataFrame, host: str = "cik", page: str = "accession_number", text: str = "text", min_pages: int = 5, share: float = 0.3) -> DataFrame:
    """``(page, host, h, n_pages, host_pages)``: every page and the recurring subtrees that are deleted from it."""
    src = _source(df, page, host, text)
    pages = _pages(src, page, host)
    bad = recurring_subtrees(pages, host, page, min_pages, share, src).withColumnRenamed(host, "_b")
    on = pages.select(page, host, F.explode(F.array_distinct(F.transform("subtrees", lambda s: s.h))).alias("h")).distinct()
    return on.join(bad, ["h"]).where(F.col(host).eqNullSafe(F.col("_b"))).select(page, host, "h", "n_pages", "host_pages")


def clean_markup(df: DataFrame, host: str = "cik", page: str = "accession_number", text: str = "text", min_pages: int = 5, share: float = 0.3) -> DataFrame:
    """``(page, host, n_constructs, n_removed, clean_text, blocks)`` for every row of ``df`` with a text.

    Null texts give no row, empty ones an empty clean text; copies of a page count as one page of its host and
    come out as often as they came in, and different texts under one page are cleaned each by its own subtrees; other
    columns don't matter.
    """
    src = _source(df, page, host, text)
    pages = _pages(src, page, host)
    bad = recurring_subtrees(pages, host, page, min_pages, share, src).select(F.col(host).alias("_b"), "h")
    drops = (
        pages.select(page, host, "_version", F.explode("subtrees").alias("t")).select(page, host, "_version", F.col("t.h").alias("h"), "t.s", "t.e")
        .join(bad, "h").where(F.col(host).eqNullSafe(F.col("_b"))).groupBy(F.col(page).alias("_p"), F.col("_version").alias("_v"), F.col("_b")).agg(F.collect_set(F.struct("s", "e")).alias("_drop"))
    )
    block = StructType([StructField("kind", StringType()), StructField("text", StringType())])
    out_schema = StructType([df.schema[page], df.schema[host], StructField("n_constructs", IntegerType()), StructField("n_removed", IntegerType()), StructField("clean_text", StringType()), StructField("blocks", ArrayType(block))])
    out_arrow = to_arrow_schema(out_schema)

    def convert(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list] = [[], [], [], []]
            for t, drop in zip(b.column("_text").to_pylist(), b.column("_drop").to_pylist()):
                n = len(constructs(t))
                end = len(t) + 1
                for d in sorted(drop or [], key=lambda d: (-d["e"], d["s"])):
                    if d["e"] <= end:  # an element inside one that is gone is gone
                        t, end = t[: d["s"]] + t[d["e"] :], d["s"]
                blocks = to_blocks(t) if n else [("paragraph", x) for x in re.split(r"\n\s*\n", t) if x.strip()]
                for c, v in zip(cols, (n, len(drop or []), render(blocks) if n else t, [{"kind": k, "text": x} for k, x in blocks])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(page).cast(out_arrow[0].type), b.column(host).cast(out_arrow[1].type), *(pa.array(c, out_arrow[i + 2].type) for i, c in enumerate(cols))], schema=out_arrow)

    mine = (F.col("_version") == F.col("_v")) & F.col(page).eqNullSafe(F.col("_p")) & F.col(host).eqNullSafe(F.col("_b"))
    return src.join(drops, mine, "left").select(page, host, "_text", "_drop").mapInArrow(convert, out_schema)
