import math
from itertools import product

import numpy as np
import pytest

from ledgerloom.llm import leakage, markup, mojibake, packing, sentences, survivors, truncation


# --- sentences -----------------------------------------------------------------------------------------------------
def units(t):
    i, e = sentences.unit_ends([t])
    cuts = [0, *e.tolist()]
    return [t[a:b].strip() for a, b in zip(cuts, cuts[1:])]


CASES = [
    ("Dr. Mirsk joined Rartrick Ltd. in 2016. It grew 7.2% vs. 2015. Yes!", 3), ("“Volumes fell. Prices held,” Ms. Lonsby noted. Next one.", 2), ("We sold it to Dracksath & Co. Our margin is 0.36.", 2),
    ("Line one\nwraps here. Second.", 2), ("Competition\n\nWe compete.\n\n• one item\n• two items\n\nTotal costs  12  34", 5), ("“我们会谨慎投资能源。”董事长在会上说。盈利！", 2), ("「投資は慎重に進める。」と社長は述べた。次。", 2),
    ("„Wir prüfen. Wir warten“, sagte Hr. Kalder. Es kostet 5 Mio. Euro.", 2), ("คณะกรรมการอนุมัติแผน ต้นทุนสูงกว่าที่คาด", 2), ("Выручка за 2022 г. составила 13 млн. руб. Завод № 7 работает.", 2), ("قال د. سالور شيئا. هل ستنخفض؟", 2),
    ("कंपनी बढ़ी। डॉ. कल्देर ने कहा।", 2), ("Am 5. März 2018 begann es. Im Jahr 2019. Danach mehr.", 3), ("cut off in the mid", 1), ("  \n ", 0), ("", 0), ("Really?! Yes... Done.", 3),
]


@pytest.mark.parametrize("text,n", CASES)
def test_units(text, n):
    got = units(text)
    assert len(got) == n and "".join("".join(got).split()) == "".join(text.split())


def test_long_columns_are_columns():
    long = "1,234,567,890,123,456,789,012,345.67"
    assert units(f"Total costs  12  {long}\nWe grew. Again.") == [f"Total costs  12  {long}", "We grew.", "Again."] and len(units("Total costs  12  34\nWe grew. Again.")) == 3


def test_units_do_not_depend_on_neighbours_or_chunks():
    texts = [t for t, _ in CASES] * 3
    i, e = sentences.unit_ends(texts)
    alone = [(k, x) for k, t in enumerate(texts) for x in sentences.unit_ends([t])[1].tolist()]
    assert list(zip(i.tolist(), e.tolist())) == alone


def test_scan_equals_sequential_run():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        y = rng.integers(0, len(sentences.STEP), n).astype(np.uint8)
        s, want = 0, []
        for v in y:
            want.append(s)
            s = int(sentences.STEP[v, s])
        assert sentences.states_by_scan(y).tolist() == want


def test_sentence_tables(spark):
    long = "A sentence here. " * 20000
    df = spark.createDataFrame([(1, "One. Two.", 9), (1, "One. Two.", 9), (2, None, 9), (3, "", 9), (4, long, 9)], "section_id long, text string, end_pos int")
    out = sorted(tuple(r) for r in sentences.sentence_ends(df, "section_id", "text").distinct().where("section_id < 4").collect())
    assert out == [(1, 4), (1, 9)] and sentences.sentence_ends(df, "section_id", "text").where("section_id = 4").count() == 20000
    assert [r["sentence"] for r in sentences.split_sentences(df.limit(1), "section_id", "text").orderBy("unit_no").collect()] == ["One.", "Two."]
    assert sentences.sentence_ends(df.limit(0), "section_id", "text").count() == 0


# --- truncation ------------------------------------------------------------------------------------------------------
def test_truncation(spark):
    whole = [f"The board sold plant {i} in Rindale last year. It was a good price for plant {i} then." for i in range(300)]
    lists = [f"We list:\n\n• loss of a key supplier\n• plant number {i}" for i in range(40)]
    cuts = ["The board sold plant 7 in", "The board sold plant 8 in Rindale last ye", "The board sold …", "We list:\n\n• loss of a key", "The board sold plant (continued)"]
    texts = [*whole, *lists, *cuts, None, "", "  "]
    df = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in enumerate(texts)], "section_id long, text string, source string")
    flags = {r["section_id"]: r["cut"] for r in truncation.truncated(df).collect()}
    n = len(whole) + len(lists)
    assert not any(flags[i] for i in range(n)) and all(flags[i] for i in range(n, n + len(cuts))) and len(flags) == n + len(cuts)
    rep = truncation.truncation_report(df.union(df)).collect()
    assert sum(r["n_cut"] for r in rep) == len(cuts) and sum(r["n_records"] for r in rep) == len(texts)
    assert truncation.truncated(df.limit(0)).count() == 0


# --- survivors ---------------------------------------------------------------------------------------------------------
FUND = "record_id long, gvkey string, fyear int, indfmt string, curcd string, datafmt string, consol string, emp double, at double, loaded_at timestamp"


def test_survivors(spark):
    from datetime import datetime as D

    t = lambda d: D(2024, 1, d)
    nan = float("nan")
    data = [
        (1, "11", 2020, "FS", "USD", "STD", "C", 1.0, 9.0, t(1)), (2, "00000011", 2020, "indl ", "CAD", "STD", "C", None, 1.0, t(1)), (3, "12.0", 2020, "INDL", "USD", "STD", "C", nan, None, t(1)), (4, "12", 2020, "INDL", "USD", "STD", "C", None, 5.0, t(1)),
        (5, "13", 2020, "INDL", "USD", "STD", "C", 2.0, 7.0, t(1)), (6, "13", 2020, "INDL", "USD", "STD", "C", 2.0, 7.0, t(2)), (7, "13", 2020, "INDL", "USD", "STD", "C", 2.0, 7.0, t(2)), (8, "14", None, "INDL", "USD", "STD", "C", 2.0, 7.0, t(2)), (9, "15", 2021, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data + data[:2], FUND)
    s = {r["gvkey"]: r for r in survivors.survivors(df).collect()}
    assert {k: r["record_id"] for k, r in s.items()} == {"00000011": 2, "00000012": 4, "00000013": 6, "00000015": 9}
    assert s["00000011"]["emp"] == 1.0 and s["00000012"]["at"] == 5.0 and s["00000015"]["at"] is None and s["00000013"]["n_records"] == 3
    assert survivors.survivors(df.limit(0)).count() == 0


def test_truth_discovery_trusts_the_consistent_source(spark):
    data = [(g * 10 + k, f"{g}", 2020, "INDL", c, "STD", "C", 1.0, 100.0 + g if c != "EUR" else 500.0 + 37 * g, None) for g in range(1, 9) for k, c in enumerate(("USD", "CAD", "EUR"))]
    data += [(900, "9", 2020, "INDL", "USD", "STD", "C", 1.0, 42.0, None), (901, "9", 2020, "INDL", "EUR", "STD", "C", 1.0, 77.0, None)]
    t = survivors.truth(survivors.records(spark.createDataFrame(data, FUND)))
    got = {r["gvkey"]: r["value"] for r in t.where("field = 'at'").collect()}
    assert got["00000009"] == "42.0" and got["00000003"] == "103.0"


def brute_truth(rows, settled):
    """The same votes with dictionaries: rows of (group, source, field, value, bin)."""
    from collections import defaultdict

    near = lambda f, b: (b - 1, b, b + 1) if f in survivors.FIELDS else (b,)
    w, step, before = {s: 1.0 for _, s, *_ in rows}, 1.0, math.inf
    while True:
        own, every = defaultdict(float), defaultdict(float)
        for g, s, f, _, b in rows:
            own[g, f, b] += w[s]
            every[g, f] += w[s]
        support = {k: sum(own.get((k[0], k[1], b), 0) for b in near(k[1], k[2])) / every[k[:2]] for k in own}
        new = {}
        for s in w:
            mine = [1 - support[g, f, b] for g, t, f, _, b in rows if t == s]
            new[s] = w[s] + step * (max(-math.log((sum(mine) + 0.5) / (len(mine) + 1)), 0.05) - w[s])
        moved = max(abs(new[s] - w[s]) for s in w)
        w = new
        if moved < settled:
            return w
        step, before = step / 2 if moved > 0.9 * before else step, moved


def test_truth_equals_brute_force_and_codes_are_fields(spark):
    import random

    random.seed(11)
    data = [(i, str(random.randint(1, 12)), 2020 + random.randint(0, 1), random.choice(["INDL", "FS", None]), random.choice(["USD", "CAD", " usd"]), "STD", random.choice("CD"), random.choice([1.0, 1.001, 3.0, None]), random.choice([100.0, 100.4, 250.0, 0.0, -5.0]), None) for i in range(120)]
    recs = survivors.records(spark.createDataFrame(data, FUND))
    rows = [((r["gvkey"], r["fyear"]), r["source"], r["field"], r["value"], r["bin"]) for r in survivors.claims(recs).collect()]
    w = brute_truth(rows, 1e-3)
    got = {(r["gvkey"], r["fyear"], r["field"]): (r["value"], round(r["support"], 6)) for r in survivors.truth(recs).collect()}
    near = lambda f, b: (b - 1, b, b + 1) if f in survivors.FIELDS else (b,)
    for (g, y, f), (value, support) in got.items():
        mine = [(s, v, b) for k, s, h, v, b in rows if k == (g, y) and h == f]
        back = {v: sum(w[s] for s, _, c in mine if c in near(f, b)) / sum(w[s] for s, _, _ in mine) for _, v, b in mine}
        assert abs(max(back.values()) - support) < 1e-5 and abs(back[value] - support) < 1e-5
    assert {f for _, _, f in got} == {"emp", "at", "indfmt", "curcd", "datafmt", "consol"} and all(v[0] != " usd" for v in got.values())


def test_close_numbers_back_each_other(spark):
    # 0.1 % apart on either side of any bin's edge: together they outvote the lone value
    for x in (100.0, 123.4, 777.0):
        data = [(1, "1", 2020, "INDL", "USD", "STD", "C", None, x, None), (2, "1", 2020, "INDL", "USD", "STD", "C", None, x * 1.001, None), (3, "1", 2020, "INDL", "USD", "STD", "C", None, 5 * x, None)]
        t = survivors.truth(survivors.records(spark.createDataFrame(data, FUND))).where("field = 'at'").first()
        assert float(t["value"]) < 2 * x and abs(t["support"] - 2 / 3) < 1e-9


# --- packing --------------------------------------------------------------------------------------------------------------
def test_best_fill_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = sorted({int(x) for x in rng.integers(1, 30, 5)}, reverse=True)
        counts = {x: int(rng.integers(1, 4)) for x in lengths}
        room = int(rng.integers(5, 80))
        best = max(t for t in (sum(k * x for k, x in zip(ks, lengths)) for ks in product(*(range(counts[x] + 1) for x in lengths))) if t <= room)
        got = packing.best_fill(lengths, counts, room)
        assert sum(k * x for x, k in got.items()) == best and all(k <= counts[x] for x, k in got.items())


def test_pack(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 120, 400)] + [7] * 300 + [250, 100, 0]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9999, None, "x")], "doc_id long, n_tokens int, container_id string")
    p = packing.pack(df.union(df.limit(50)), capacity=100).toPandas()
    assert p.groupby("container_id").piece_tokens.sum().max() <= 100
    assert p.groupby("doc_id").piece_tokens.sum().to_dict() == {i: s for i, s in enumerate(sizes)} | {9999: 0} and not p.duplicated(["doc_id", "piece"]).any()
    big = p[p.doc_id == 700].sort_values("piece")
    assert big.piece_tokens.tolist() == [100, 100, 50] and big.start_token.tolist() == [0, 100, 200]
    f = packing.container_fill(packing.pack(df, capacity=100), 100).first()
    assert f["n_containers"] <= math.ceil(f["least_containers"] * 1.02) and f["fullest"] <= 100
    assert packing.pack(df.limit(0)).count() == 0


# --- leakage ----------------------------------------------------------------------------------------------------------------
ITEM = "before Grondak moved its ledger cluster to Velmira, 97 nightly pricing jobs failed and auditors at Pondrel traced 31 clinic alerts to one retrieval feed near Wexham"


def test_leaks(spark):
    w = ITEM.split()
    edit = list(w)
    edit[6], edit[14] = "changed", "words"
    facts = "before Salmur moved its ledger cluster to Tarquin, 12 nightly pricing jobs failed and auditors at Yorben traced 99 clinic alerts to one retrieval feed near Zelkov"
    docs = {
        1: "Intro text. " + ITEM.upper().replace(",", " ;") + " outro", 2: "pre " + " ".join(edit) + " post", 3: facts, 4: " ".join(w[:9]) + " was the working title", 5: "x " + " ".join(w[4:21]) + " y", 6: "", 7: None, 8: "nothing at all here", 9: ("filler word " * 3000) + ITEM,
    }
    d = spark.createDataFrame([(k, t, 5) for k, t in docs.items()] + [(1, docs[1], 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(100, ITEM), (101, facts.replace("Salmur", "Quorin").replace("Tarquin", "Ostvel").replace("12", "55").replace("Yorben", "Elmar").replace("99", "8").replace("Zelkov", "Brandt")), (102, "some other evaluation question about nothing that ever leaks into any of these documents at all today"), (103, None)], "item_id long, text string")
    out = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(d, items).collect())
    assert out == [(1, 100), (2, 100), (5, 100), (9, 100)]
    assert leakage.leaks(d.limit(0), items).count() == 0


def test_alignment():
    a = list("abcdefghij")
    assert leakage.longest_stretch(a, list("xxabcdefghijyy")) == (0, 10, 10) and leakage.longest_stretch(a, list("abcdXfghij")) == (0, 10, 9) and leakage.longest_stretch(a, list("zzz")) == (0, 0, 0)


# --- encoding -----------------------------------------------------------------------------------------------------------------
def test_mojibake(spark):
    clean = ["Die Prüfung für größere Werke läuft", "Le marché de l’été a progressé", "当社の物流事業の売上高は増の百万円となりました。", "Повлияет ли ремонт на расходы"]
    bad = [
        clean[0].encode("utf-8").decode("cp1252", "replace"), clean[1].encode("utf-8").decode("latin-1"), clean[2].encode("utf-8").decode("latin-1"), clean[3].encode("cp1251").decode("cp1252"),
        clean[3].encode("koi8-r").decode("cp1251"), clean[0].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"), "US$ 5 � bn",
    ]
    bad[0] = bad[0].replace("�", "ü") if "�" in bad[0] else bad[0]
    docs = [*clean * 5, "PRODUÇÃO NÃO AFETADA", "plain text", "", None, *bad]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, token string")
    first = len(docs) - len(bad)
    found = {r[0] for r in mojibake.garbled_documents(df).select("doc_id").distinct().collect()}
    assert found == set(range(first, len(docs)))
    out = {r["doc_id"]: r for r in mojibake.restore(df).collect()}
    assert len(out) == len(docs) and [out[first + k]["restored_text"] for k in (0, 1, 3, 4, 5)] == [clean[0], clean[1], clean[3], clean[3], clean[0]]
    assert out[len(docs) - 1]["n_unrestored"] > 0 and not out[0]["is_garbled"] and out[0]["restored_text"] == docs[0]
    assert mojibake.garbled_documents(df.limit(0)).count() == 0


# --- markup ----------------------------------------------------------------------------------------------------------------------
MARKED = ["a <b>b</b>", "x</td> y", "a &nbsp; b", "# Head\n\ntext", "see [grid](#n4)", "**bold** word", "a __b__ c", "`code`", "~~gone~~", "[[a|b]] c", "{{note|x}}", "'''b''' c", "== H ==", "\\emph{x", "depend\\footnote{n} on", "|---|---|", "Head\n====", "<!-- c -->", "$$a = b$$", "\\begin{center}"]
PLAIN = [
    "A < B implies lower fees & more", "R&D and P&L", "Growth was >10% and <15%.", "marked * are in thousands; those marked ** are restated", "rank #1 (see [3])", "file_name_v2 holds 5 * 3 = 15", "Path C:\\data\\Gevkim is archived", "between $4 and $9 ~ twice", "• item\n• item",
    "    score = fit(rows, k=2)\n    if score < 0.5:\n        report(score * 100)", "It’s the firm's own", "share = n / b", "p < 0.05 and n > 30", "",
]


def test_constructs():
    assert [t for t in MARKED if not markup.constructs(t)] == [] and [t for t in PLAIN if markup.constructs(t)] == []


def test_blocks_keep_structure():
    kinds = lambda t: markup.to_blocks(t)
    assert kinds("<h2>Head</h2><p>a <b>b</b> &amp; c</p><ul><li>x<li>y</ul><table><tr><td>1</td><td>2</td></tr></table><pre>k = 1</pre>") == [("heading", "Head"), ("paragraph", "a b & c"), ("list_item", "x"), ("list_item", "y"), ("table_row", "1 | 2"), ("code", "k = 1")]
    assert kinds("# Head\n\ntext *it*\n\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```python\nz = 1\n```\n\n$$e = m$$") == [("heading", "Head"), ("paragraph", "text it"), ("list_item", "x"), ("list_item", "y"), ("table_row", "a | b"), ("table_row", "1 | 2"), ("code", "z = 1"), ("formula", "e = m")]
    assert kinds("\\section{Head}\n\ntext \\textbf{b} 5\\%\n\n\\begin{itemize}\n \\item x\n\\end{itemize}\n\n\\begin{tabular}{lr}\na & 1 \\\\\nb & 2\n\\end{tabular}") == [("heading", "Head"), ("paragraph", "text b 5%"), ("list_item", "x"), ("table_row", "a | 1"), ("table_row", "b | 2")]
    assert kinds("== Head ==\n\na [[b|c]] '''d'''\n\n{| class=\"w\"\n|-\n| a || 1\n|}") == [("heading", "Head"), ("paragraph", "a c d"), ("table_row", "a | 1")]


def test_templates_go(spark):
    nav = "<div>Home About Contact Imprint</div>"
    pages = [(f"p{i}", "h", f"<h2>Item 1. Business</h2>{nav}<p>Own text number {i} of this page.</p>") for i in range(8)] + [("q1", "g", f"{nav}<p>Other host</p>"), ("q2", "g", ""), ("q3", "g", None), ("q4", "g", "No markup.")]
    df = spark.createDataFrame([(*p, 1) for p in pages + pages[:2]], "accession_number string, cik string, text string, n_removed int")
    out = {r["accession_number"]: r for r in markup.clean_markup(df).collect()}
    assert "Imprint" not in out["p3"]["clean_text"] and "Own text number 3" in out["p3"]["clean_text"] and "Item 1. Business" in out["p3"]["clean_text"] and out["p3"]["n_removed"] >= 1
    assert "Imprint" in out["q1"]["clean_text"] and out["q2"]["clean_text"] == "" and "q3" not in out and out["q4"]["n_constructs"] == 0
    assert markup.clean_markup(df).count() == 13 and markup.clean_markup(df.limit(0)).count() == 0


def test_text_of_notes_templates_and_titles_stays():
    assert markup.to_blocks("Main text\\footnote{Loss of 5 million in 2024.} goes on. {{convert|5|km}} away.") == [("paragraph", "Main text (Loss of 5 million in 2024.) goes on. 5 km away.")]
    assert markup.to_blocks("<head><title>Annual Report</title></head><p>a<ref>Note 3</ref> &amp;lt;b&amp;gt;</p>") == [("heading", "Annual Report"), ("paragraph", "a (Note 3) &lt;b&gt;")]
    assert markup.to_blocks("Our costs by year\nRevenue   100   200\nCosts   50   60\n\nEnd **here**.") == [("paragraph", "Our costs by year"), ("table_row", "Revenue | 100 | 200"), ("table_row", "Costs | 50 | 60"), ("paragraph", "End here.")]


def test_versions_of_a_page_and_counts_by_brute_force(spark):
    nav = "<div>Home</div>"
    pages = [(f"p{i}", "h", f"{nav}<p>Own text number {i} of this page.</p>") for i in range(6)] + [("p0", "h", f"<p>The second version of p0 has entirely other text here and more of it.</p>{nav}"), ("z", None, f"{nav}<p>x</p>")]
    df = spark.createDataFrame(pages + pages[:1], "accession_number string, cik string, text string")
    out = {(r["accession_number"], r["clean_text"]) for r in markup.clean_markup(df).collect()}
    assert ("p0", "The second version of p0 has entirely other text here and more of it.") in out and ("p0", "Own text number 0 of this page.") in out and ("z", "Home\n\nx") in out
    want = {}
    for p, h, t in pages:
        for x in {x for x, _, _ in markup.subtrees(t)}:
            want.setdefault((h, x), set()).add(p)
    sizes = {h: len({p for p, g, _ in pages if g == h}) for _, h, _ in pages}
    brute = {(p, h, x, len(ps), sizes[h]) for (h, x), ps in want.items() if len(ps) >= 5 and len(ps) >= 0.3 * sizes[h] for p in ps}
    assert brute and {tuple(r) for r in markup.site_templates(df).collect()} == brute


def test_leaks_of_stretches_and_items_without_facts(spark):
    common = "staff call the clinic ledger suppose the keeper doubles its harvest quota of grain how many"
    items = [(k, f"{common} carts does {a} send to {b} in a {c} week") for k, (a, b, c) in enumerate([("Grondak", "Velmira", "dry"), ("Pondrel", "Wexham", "wet"), ("Salmur", "Tarquin", "cold")])]
    same = "two ids hold this very text about Ostvel and Brandt who counted every barrel in the northern yard before noon"
    items += [(10, same), (11, same)]
    docs = [(1, f"intro {common} outro"), (2, f"intro {same} outro"), (3, "nothing of it")]
    out = {tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()}
    assert out == {(1, 0), (1, 1), (1, 2), (2, 10), (2, 11)}


def test_copies_do_not_hide_garbled_words(spark):
    clean = "Die Prüfung für größere Werke läuft"
    bad = clean.encode("utf-8").decode("latin-1")
    docs = [(0, clean), *((i, bad) for i in range(1, 6)), *((i, f"{bad} {i}") for i in range(6, 10)), (10, bad.encode("utf-8").decode("latin-1"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r[0] for r in mojibake.garbled_documents(df).select("doc_id").distinct().collect()} == set(range(1, 11))
    out = {r["doc_id"]: r["restored_text"] for r in mojibake.restore(df).collect()}
    assert out[1] == out[10] == out[0] == clean and out[7] == f"{clean} 7"


def test_copies_of_a_cut_text_count_once(spark):
    whole = [(i, f"The firm of unit {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i % 3]}q paid the cost of the new plant in {'spring summer autumn winter'.split()[i % 4]}.") for i in range(40)]
    stump = (99, "The firm paid the cost of the")
    df = spark.createDataFrame([*whole, stump, stump, stump], "section_id long, text string")
    assert {r["section_id"] for r in truncation.truncated(df).where("cut").collect()} == {99}


def test_leaks_of_short_items_and_of_whole_benchmarks(spark):
    items = [(1, "Who founded the Velmira mill?"), (2, "who founded the velmira mill"), (3, "mill"), (4, "Count nine red barrels of Ostvel grain by noon"), (5, ""), (6, "？！")]
    many = [(100 + i, f"question {i} asks how the keeper of yard {i * 7} in Brandt number {i * 13} counted {i * 3} barrels before the long winter of {i * 17} came") for i in range(300)]
    docs = [(1, "Who founded, the Velmira mill"), (2, "intro count nine red barrels of Ostvel wheat by noon outro"), (3, " ".join(t for _, t in many)), (4, "who founded the velmira"), (5, "")]
    out = {}
    for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + many, "item_id long, text string"), per_row=40).collect():
        out.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert out[1] == {1, 2, 3} and out[2] == {4} and out[3] == {k for k, _ in many} and 4 not in out and 5 not in out
