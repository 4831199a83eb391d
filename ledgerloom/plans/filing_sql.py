"""DuckDB's SQL for cutting Items out of filings: the same grammar and gates as ``operators.sections``."""

from __future__ import annotations

from itertools import combinations

from ledgerloom.operators import sections as S

ITEMS = S.ITEMS
WS = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _rx(p: str) -> str:
    """A pattern for RE2, which has no lookahead: the separator class already keeps other numbers out."""
    return p.replace("(?![0-9a-z])", "").replace("(?![0-9a])", "").replace("\\xa0", "\\x{a0}").replace("'", "''")


def gates(t: str, item: str) -> dict[str, str]:
    """What each gate says of the text ``t`` that should be ``item``."""
    count = lambda p: f"len(regexp_extract_all({t}, '(?i){_rx(p)}'))"
    hint = f"regexp_matches({t}, '(?i){_rx(S.MDNA_HINT)}')"
    return {
        "n_chars": f"length({t})", "density": f"((length({t}) - length(replace({t}, '. ', ''))) / 2e0) / greatest(length({t}) / 1000e0, 1e0)", "length_ok": f"length({t}) BETWEEN 500 AND 1000000",
        "overcaptured": f"({count(S.AUDITOR)} >= 2 OR ({item} = 'item_1' AND length({t}) > 450000 AND {count(S.MDNA_TITLE)} >= 2))",
        "looks_like": f"CASE {item} WHEN 'item_1a' THEN {count(chr(92) + 'brisk')} >= 10 WHEN 'item_7' THEN {hint} ELSE true END",
        "best_label": f"CASE WHEN {count(chr(92) + 'brisk')} >= 10 THEN 'item_1a' WHEN {hint} THEN 'item_7' END",
        "incorporation_stub": f"(length({t}) < 3000 AND regexp_matches(substr({t}, 1, 700), '(?i){_rx(S.STUB_HINT)}'))", "reference_head": f"regexp_matches(substr({t}, 1, 130), '(?i){_rx(S.REFERENCE_HEAD)}')",
    }


def _pieces(p: str) -> str:
    return f"string_split(regexp_replace(chr(10) || text, '(?i)({_rx(p)})', chr(1) || '\\1', 'g'), chr(1))"


_AT = "list_sum(list_transform({0}[1:i - 1], lambda x: length(x))) - 1"
_RAN = "regexp_matches(body, '(?i)^{0}[^.,;:]{{0,79}}?(,|[.;:][”\"’''])')"


def candidates(raw: str) -> str:
    """CTEs ``parts``, ``spans``, ``cand``: bodies from headers that start their line to the next boundary."""
    parts = " UNION ALL ".join(f"SELECT accession_number, text, '{i}' AS item, {_pieces(S.HEADER[i])} AS pc, {_pieces(S.ENDS[i])} AS ec FROM {raw} WHERE text IS NOT NULL" for i in ITEMS)
    lead = _rx(S.LINE_LEAD).replace("(?iU)", "(?i)")
    g = gates("body", "item")
    ran = "CASE item " + " ".join(f"WHEN '{i}' THEN {_RAN.format(_rx(S.HEADER[i]))}" for i in ITEMS) + " END"
    return f"""parts AS ({parts}),
spans AS (SELECT accession_number, text, item, list_transform(range(2, len(ec) + 1), lambda i: {_AT.format('ec')}) AS ends, {_AT.format('pc')} AS start, string_split(pc[i - 1], chr(10))[-1] AS lead
  FROM (SELECT *, unnest(range(2, len(pc) + 1)) AS i FROM parts)),
bodies AS (SELECT DISTINCT accession_number, item, regexp_replace(CASE WHEN stop IS NULL THEN substr(text, start::BIGINT + 1) ELSE substr(text, start::BIGINT + 1, (stop - start)::BIGINT) END, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') AS body
  FROM (SELECT *, list_min(list_filter(ends, lambda e: e > start + 200)) AS stop FROM spans WHERE regexp_matches(lead, '{lead}'))),
judged AS (SELECT accession_number, item, body, {', '.join(f'{v} AS {k}' for k, v in g.items())}, {ran} AS runs_on FROM bodies),
cand AS (SELECT *, sound AND n_chars <= 450000 AND density >= 1.5 AND NOT runs_on AS strict FROM (SELECT *, length_ok AND NOT overcaptured AND looks_like AND NOT incorporation_stub AND NOT reference_head AS sound FROM judged))"""


def _held(a: str, b: str) -> str:
    s, l = (WS.format(f"CASE WHEN length({a}) <= length({b}) THEN {x} ELSE {y} END") for x, y in ((a, b), (b, a)))
    return f"coalesce(list_transform([{{'s': {s}, 'l': {l}}}], lambda p: CASE WHEN length(p.s) - 200 > 25 THEN list_sum(list_transform(range(25), lambda k: contains(p.l, substr(p.s, (k * ((length(p.s) - 200) // 25) + 1)::BIGINT, 200))::INT)) / 25e0 ELSE 0e0 END)[1], 0e0)"


def _untangled(src: str, out: str) -> str:
    """CTEs that bring ``src`` without sections that largely hold one another as ``out``."""
    ctes, gone, last = [], dict.fromkeys(ITEMS, "false"), src
    for n, (a, b) in enumerate(combinations(ITEMS, 2)):
        label = f"coalesce({gates(f'CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END', chr(39) * 2)['best_label']}, '')"
        alike = f"least(length({a}), length({b})) > 0.9 * greatest(length({a}), length({b}))"
        ctes.append(f"{out}_{n} AS (SELECT *, tangled AND CASE WHEN {alike} THEN {label} <> '{a}' ELSE length({a}) > length({b}) END AS d{n}a, tangled AND CASE WHEN {alike} THEN {label} <> '{b}' ELSE length({b}) >= length({a}) END AS d{n}b FROM (SELECT * {'' if not n else 'EXCLUDE (tangled)'}, NOT {gone[a]} AND NOT {gone[b]} AND {_held(a, b)} > 0.5 AS tangled FROM {last}))")
        gone[a], gone[b], last = f"({gone[a]} OR d{n}a)", f"({gone[b]} OR d{n}b)", f"{out}_{n}"
    ctes.append(f"{out} AS (SELECT * EXCLUDE (tangled, d0a, d0b, d1a, d1b, d2a, d2b, item_1, item_1a, item_7), {', '.join(f'CASE WHEN NOT {gone[i]} THEN {i} END AS {i}' for i in ITEMS)} FROM {last})")
    return ",\n".join(ctes)


def _filled(src: str, out: str, i: str, stub: int) -> str:
    others = [x for x in ITEMS if x != i]
    meets = lambda t, limit: "(" + " OR ".join(f"{_held(t, o)} > {limit}" for o in others) + ")"
    return f"""{out}_j AS (SELECT w.*, c.body, c.n_chars AS n, c.sound AND w.{i} IS NULL AS s1, c.strict AND c.n_chars >= {stub} AS s2, {meets('c.body', 0.3)} AS meets, {meets('c.body', 0.5)} AS meets1
  FROM {src} w JOIN cand c ON c.accession_number = w.accession_number AND c.item = '{i}' AND c.sound WHERE coalesce(length(w.{i}), 0) < {stub}),
{out}_p AS (SELECT accession_number, max_by({{'b': body, 'm': meets1, 'n': n}}, n) FILTER (WHERE s1) AS first, max_by({{'b': body, 'n': n}}, n) FILTER (WHERE s2 AND NOT meets AND n >= 3 * coalesce(length({i}), 0)) AS free, coalesce(max(n) FILTER (WHERE s2 AND meets), 0) AS over FROM {out}_j GROUP BY 1),
{out}_f AS (SELECT accession_number, CASE WHEN first.n >= {stub} AND NOT first.m THEN first.b WHEN free.n >= 0.2 * over THEN free.b END AS fill FROM {out}_p),
{out} AS (SELECT w.* REPLACE (coalesce(fill, {i}) AS {i}, CASE WHEN fill IS NOT NULL THEN 'regex' ELSE s_{i} END AS s_{i}) FROM {src} w LEFT JOIN {out}_f USING (accession_number))"""


def assembly(structured: str, raw: str, stub: int = 6500) -> str:
    """The whole of it over ``structured (accession_number, item, text)`` and ``raw (accession_number, cik, text)``."""
    steps = [f"one AS (SELECT accession_number, r.cik AS cik, r.text AS text FROM (SELECT accession_number, max_by({{'cik': cik, 'text': text}}, coalesce(length(text), -1)) AS r FROM {raw} GROUP BY 1))", candidates("one")]
    steps.append("st AS (SELECT accession_number, " + ", ".join(f"max_by(text, length(text)) FILTER (WHERE item = '{i}') AS {i}" for i in ITEMS) + f" FROM {structured} WHERE text IS NOT NULL GROUP BY 1)")
    steps.append("w0 AS (SELECT one.accession_number, cik, item_1, item_1a, item_7 FROM one LEFT JOIN st USING (accession_number))")
    steps.append(_untangled("w0", "u0"))
    steps.append("v0 AS (SELECT *, " + ", ".join(f"CASE WHEN {i} IS NOT NULL THEN 'edgartools' END AS s_{i}" for i in ITEMS) + " FROM u0)")
    for n, i in enumerate(ITEMS):
        steps.append(_filled(f"v{n}", f"v{n + 1}", i, stub))
    steps.append(_untangled("v3", "u1"))
    rows = " UNION ALL ".join(f"SELECT accession_number, cik, '{i}' AS item, s_{i} AS source, length({i}) AS n_chars FROM u1 WHERE {i} IS NOT NULL" for i in ITEMS)
    return "WITH " + ",\n".join(steps) + "\n" + rows
