import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.linkage import components, link, money, solve_by_component, solve_hinge_admm, ticker_key
from ledgerloom.llm.names import Lexicon, distance, distance_in_any_order, shortened
from ledgerloom.llm.variants import average_linkage, learn_lexicon, name_clusters, name_pairs, similar_nodes

LEX = Lexicon({"steel": "steel", "stl": "steel", "software": "software", "sftwr": "software", "logistics": "logistics", "insurance": "insurance", "pharma": "pharma"})


@pytest.mark.parametrize("name,want", [
    ("James Dravtond Walmick Steel Corp.", ("dravtond walmick", "steel", "james")), ("STEEL, DRAVTOND WALMICK, L.L.C.", ("dravtond walmick", "steel", "")), ("Dravtond & Walmick Stl Grp", ("dravtond walmick", "steel", "")),
    ("Bob Drávtond Walmick Sftwr. (US) Inc", ("dravtond walmick", "software", "robert")), ("Dravtond Walmick Logeistcs plc", ("dravtond walmick", "logistics", "")), ("Dravtond Walmick Lgstcs", ("dravtond walmick", "logistics", "")),
    ("N/A", None), (None, None), ("", None), ("-", None), ("TBD", None), ("Inc", ("inc", "", "")),
])
def test_parts(name, want):
    p = LEX.parts(name)
    assert (p and (" ".join(p[0]), *p[1:])) == want


def test_distance():
    assert distance("abc", "acb") == 1 and distance("abc", "abd") == 1 and distance("abc", "ab") == 1 and distance("abcdef", "ghijkl", 2) == 3
    assert LEX.near("phrama") == "pharma" and LEX.near("dravtond") == "" and shortened("stl", "steel") and not shortened("tsl", "steel")


FAMILIES = "Acme Borden Calder Dunmore Elgin Farrow Gilroy Hadley Ivor Jessop Kelso Lomond Morven Norden Orwell Perth".split()


def lines_of_business():
    """Families that do several things, under full and shortened words."""
    out = []
    for i, f in enumerate(FAMILIES):
        out += [f"{f} Insurance Inc", f"{f} Ins. Co", f"{f} Reinsurance plc", f"{f} Dairies Ltd", f"{f} Bakeries"]
        out += [f"{f} {FAMILIES[i - 1]} Insurance"] if i % 4 == 0 else []
    return out


def test_lexicon_is_learned(spark):
    lex = learn_lexicon(spark.createDataFrame([(n,) for n in lines_of_business()], "name string"))
    assert set(lex.classes) == {"insurance", "ins", "reinsurance", "dairies", "bakeries"}
    assert lex.classes["ins"] == lex.classes["insurance"] and len(set(lex.classes.values())) == 4
    assert learn_lexicon(spark.createDataFrame([("Acme Dairies",), (None,)], "name string")).classes == {}


def test_other_lines_are_other_firms(spark):
    c = {r["name"]: r["cluster"] for r in name_clusters(spark.createDataFrame([(n,) for n in lines_of_business()], "name string")).collect()}
    assert c["Acme Insurance Inc"] == c["Acme Ins. Co"] and len({c[n] for n in ("Acme Insurance Inc", "Acme Reinsurance plc", "Acme Dairies Ltd", "Acme Bakeries", "Borden Insurance Inc")}) == 5
    few = {r["name"]: r["cluster"] for r in name_clusters(spark.createDataFrame([("Acme Dairies",), ("Acme Bakeries Inc",), ("Acme Dairies Inc",)], "name string")).collect()}
    assert few["Acme Dairies"] == few["Acme Dairies Inc"] != few["Acme Bakeries Inc"]


def test_clusters(spark):
    names = ["Dravtond Walmick Steel Corp", "DRAVTOND WALMICK STEEL, INC.", "Dravtnod Walmick Steel", "Dravtond Walmick Foods", "Kexbund Lorgrim Steel", "unknown", None, "Dravtond Walmick Steel Corp"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    c = {r["name"]: r["cluster"] for r in name_clusters(df).collect()}
    assert c[names[0]] == c[names[1]] == c[names[2]] and len(set(c.values())) == 3 and "unknown" not in c
    pairs = sorted(tuple(r) for r in name_pairs(name_clusters(df)).collect())
    assert pairs == [(names[1], names[2]), (names[1], names[0]), (names[2], names[0])] or pairs == sorted(pairs) and len(pairs) == 3
    assert name_clusters(df.limit(0)).count() == 0


def brute_average_linkage(nodes, sim, t):
    groups = [{n} for n in nodes]
    while True:
        best = max((((sum(sim.get(frozenset((x, y)), 0) for x in a for y in b) / len(a) / len(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=(0, 0, 0))
        if best[0] < t:
            return {frozenset(g) for g in groups}
        groups[best[1]] |= groups[best[2]]
        del groups[best[2]]


def test_average_linkage_equals_one_merge_at_a_time(spark):
    import random

    random.seed(5)
    nodes = [f"n{i}" for i in range(14)]
    sim = {frozenset((a, b)): round(random.random(), 6) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if random.random() < 0.5}
    df = spark.createDataFrame([(*sorted(k), v) for k, v in sim.items()], "a string, b string, s double")
    got = {}
    for r in average_linkage(df, 0.38).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == brute_average_linkage(nodes, sim, 0.38)


def test_admm_finds_the_minimum(spark):
    # two rivals for one place: 1.0 * (0.9 - a)+ and 0.5 * (0.8 - b)+ with a + b <= 1
    rules = [("p", "a", -1.0, 0.9, 1.0), ("q", "b", -1.0, 0.8, 0.5), ("x", "a", 1.0, -1.0, None), ("x", "b", 1.0, -1.0, None)]
    df = spark.createDataFrame(rules, "rule string, var string, coef double, offset double, weight double")
    v = {r["var"]: r["value"] for r in solve_hinge_admm(df).collect()}
    assert abs(v["a"] - 0.9) < 0.03 and abs(v["b"] - 0.1) < 0.05


def test_keys(spark):
    df = spark.createDataFrame([("NEX: ABCDE",), ("ABCDE-B",), ("abcde.A",), (" abcde",), ("~",), (None,)], "t string")
    assert [r[0] for r in df.select(ticker_key(F.col("t"))).collect()] == ["ABCDE"] * 4 + [None, None]
    assert spark.createDataFrame([("$1,549.9",)], "m string").select(money("m")).first()[0] == 1549.9


def test_link(spark):
    f = spark.createDataFrame([(1, "Dravtond Walmick Steel", "AAAAA", "$900", "1,000", "x"), (2, "Dravtond Walmick Foods", None, None, None, "y"), (3, "Kexbund Lorgrim Energy", "BBBBB", "$5", "10", "z"), (4, None, None, None, None, None)], "rank int, company string, ticker string, assets string, employees string, eto_id string")
    e = spark.createDataFrame([(10, "DRAVTOND WALMICK STEEL CORP."), (11, "Dravtodn Walmick Foods"), (12, "Zzzz Other Steel")], "eto_id long, eto_name string")
    t = spark.createDataFrame([(10, "NEX: AAAAA"), (12, "BBBBB")], "eto_id long, ticker string")
    a = spark.createDataFrame([(11, "unknown")], "eto_id long, alias string")
    g = spark.createDataFrame([("11", "Dravtond Walmick Steel Inc", "AAAAA", 901.0, 1.0), ("00000011", "Dravtond Walmick Steel Inc", None, float("nan"), None), ("12.0", "Kexbund Lorgrim Enregy", "CCCCC", 5.0, 0.01), (None, "x", None, None, None)], "gvkey string, conm string, tic string, at double, emp double")
    out = {(r["rank"], r["source"], r["entity_id"]): r["confidence"] for r in link(f, e, t, a, g).collect()}
    assert {k for k, v in out.items() if v >= 0.5} == {(1, "eto", "10"), (2, "eto", "11"), (1, "fundamentals", "00000011"), (3, "fundamentals", "00000012")}
    assert all(0 <= v <= 1 for v in out.values())


def test_distance_in_any_order():
    assert distance_in_any_order("dirkfel landtrick", "landtrick dirkfel", 4) == 0 and distance_in_any_order("dirk fel landtrick", "landtrick dirkfel", 4) == 0
    assert distance_in_any_order("ydirkfel landtrick", "dirkfel ladntrick", 4) == 2 and distance_in_any_order("dirkfel landtrick", "dirkfel kexbund", 4) == 5


def test_swapped_family_words_are_one_organisation(spark):
    names = ["Dirkfel & Landtrick Foods", "LANDTRICK DIRKFEL FOODS INC", "Ladntrick Dirkfel Foods", "Zlandtrick Dirkfel Foods", "Landtrick Kexbund Foods", "Dirkfel Landtrick Steel"]
    c = {r["name"]: r["cluster"] for r in name_clusters(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len({c[n] for n in names[:4]}) == 1 and len(set(c.values())) == 3


def test_tied_group_of_more_than_31_nodes_is_one_cluster(spark):
    nodes = [f"n{i:02}" for i in range(36)]
    df = spark.createDataFrame([(a, b, 0.85) for i, a in enumerate(nodes) for b in nodes[i + 1 :]], "a string, b string, s double")
    assert {r["cluster"] for r in average_linkage(df).collect()} == {average_linkage(df).first()["cluster"]}


def test_link_with_swapped_family_words(spark):
    f = spark.createDataFrame([(1, "Dirkfel Landtrick Foods", "AAAAA", "$900", "1,000")], "rank int, company string, ticker string, assets string, employees string")
    e = spark.createDataFrame([(10, "LANDTRICK DIRKFEL FOODS CORP."), (11, "Landtrick Dirkfel Steel")], "eto_id long, eto_name string")
    t = spark.createDataFrame([], "eto_id long, ticker string")
    a = spark.createDataFrame([], "eto_id long, alias string")
    g = spark.createDataFrame([("11", "Landtrick Dirkfel Foods Inc", None, 901.0, 1.0)], "gvkey string, conm string, tic string, at double, emp double")
    assert {(r["source"], r["entity_id"]) for r in link(f, e, t, a, g).where("confidence >= 0.5").collect()} == {("eto", "10"), ("fundamentals", "00000011")}


def test_components_equal_union_find(spark):
    import random

    random.seed(2)
    edges = [(random.randint(1, 60), random.randint(1, 60)) for _ in range(45)]
    parent = {n: n for e in edges for n in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        parent[find(a)] = find(b)
    want, got = {}, {}
    for n in parent:
        want.setdefault(find(n), set()).add(n)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_are_solved_as_the_whole(spark):
    rules, ends = [], []
    for k in range(3):
        a, b = f"a{k}", f"b{k}"
        rules += [(f"p{k}", a, -1.0, 0.9 - k / 10, 1.0), (f"q{k}", b, -1.0, 0.8, 0.5), (f"x{k}", a, 1.0, -1.0, None), (f"x{k}", b, 1.0, -1.0, None)]
        ends += [(a, f"r{k}", f"s{k}"), (b, f"r{k}", f"t{k}")]
    df = spark.createDataFrame(rules, "rule string, var string, coef double, offset double, weight double")
    e = spark.createDataFrame(ends, "var string, a string, b string")
    whole = {r["var"]: r["value"] for r in solve_hinge_admm(df).collect()}
    for most in (1000, 1):  # in partitions, and as components too large for that
        got = {r["var"]: (r["value"], r["residual"]) for r in solve_by_component(df, e, most=most).collect()}
        assert set(got) == set(whole) and all(abs(v - whole[k]) < 0.01 and m < 1e-3 for k, (v, m) in got.items())


def test_ticker_and_figures_link_without_a_name(spark):
    f = spark.createDataFrame([(1, "Meta Platforms", "META", "$900", "1,000"), (2, "Umbrel Foods", "UMBF", "$50", "70")], "rank int, company string, ticker string, assets string, employees string")
    e = spark.createDataFrame([], "eto_id long, eto_name string")
    t = spark.createDataFrame([], "eto_id long, ticker string")
    a = spark.createDataFrame([], "eto_id long, alias string")
    g = spark.createDataFrame([("11", "Facebook Incorporated", "META", 901.0, 1.0), ("12", "Quorin Steel", "UMBF", 900.0, 12.0)], "gvkey string, conm string, tic string, at double, emp double")
    out = {(r["rank"], r["entity_id"]): r["confidence"] for r in link(f, e, t, a, g).collect()}
    assert out[1, "00000011"] >= 0.5 and out[2, "00000012"] < 0.5


def shuffled_rows(spark):
    """Rows written to shuffles so far in this session."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_what_is_moved_grows_with_the_nodes(spark):
    # all meet under the trigrams of a syllable, hardly any are alike
    import random

    random.seed(4)
    families = {"strand" + "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(1500)} | {"strandqwertzui", "strandqwertzuo"}
    nodes = spark.createDataFrame([(f"steel|{f}|", "steel", f) for f in families], "node string, line string, family string")
    before = shuffled_rows(spark)
    pairs = similar_nodes(nodes).collect()
    assert ("steel|strandqwertzui|", "steel|strandqwertzuo|") in {(r["a"], r["b"]) for r in pairs}
    assert shuffled_rows(spark) - before < 40 * len(families)


def test_similar_nodes_equal_all_pairs_compared(spark):
    import random
    from collections import Counter
    from math import log, sqrt

    random.seed(9)
    words = ["dirkfel", "landtrick", "kexbund", "lorgrim", "walmick", "dravtond", "a1", "b", "umbrel", "qq"]

    def typed(w):
        i = random.randrange(len(w))
        return random.choice([w, w, w[:i] + random.choice("aez19") + w[i + 1 :], w[:i] + w[i + 1 :] or w, w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w + w[-1]])

    keys = sorted({(random.choice(["steel", ""]), " ".join(sorted(typed(w) for w in random.sample(words, random.choice([1, 2, 2, 3])))), random.choice(["", "", "j", "k"])) for _ in range(260)})
    grams = lambda f: Counter(p[i : i + 3] for w in f.split() for p in (f"#{w}#",) for i in range(max(len(p) - 2, 1)))
    df = Counter(g for _, f, _ in keys for g in grams(f))
    vec = {f: {g: t * log(1 + len(keys) / (df[g] + 5)) for g, t in grams(f).items()} for _, f, _ in keys}
    norm = {f: sqrt(sum(x * x for x in v.values())) for f, v in vec.items()}
    want = {}
    for line, p, i in keys:
        for other, q, j in keys:
            a, b, most = f"{line}|{p}|{i}", f"{other}|{q}|{j}", min(4, int(0.25 * min(len(p.replace(" ", "")), len(q.replace(" ", "")))))
            if line == other and a < b and (i == j or not i or not j):
                c, e = sum(x * vec[q].get(g, 0) for g, x in vec[p].items()) / norm[p] / norm[q], distance_in_any_order(p, q, most)
                if c >= 0.25 and e <= most:
                    want[a, b] = (round(c, 9), e)
    got = similar_nodes(spark.createDataFrame([(f"{x}|{f}|{i}", x, f) for x, f, i in keys], "node string, line string, family string")).collect()
    assert len(want) > 100 and len(got) == len(want) and {(r["a"], r["b"]): (round(r["cosine"], 9), r["edits"]) for r in got} == want


def test_link_moves_no_more_than_the_firms_need(spark):
    import random

    random.seed(6)
    names = sorted({"strand" + "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8)) + " steel" for _ in range(800)})
    f = spark.createDataFrame([(i, n, None, None, None) for i, n in enumerate(names)], "rank int, company string, ticker string, assets string, employees string")
    e = spark.createDataFrame([(i, n.upper()) for i, n in enumerate(names)], "eto_id long, eto_name string")
    t, a = spark.createDataFrame([], "eto_id long, ticker string"), spark.createDataFrame([], "eto_id long, alias string")
    g = spark.createDataFrame([], "gvkey string, conm string, tic string, at double, emp double")
    before = shuffled_rows(spark)
    found = {(r["rank"], int(r["entity_id"])) for r in link(f, e, t, a, g).where("confidence >= 0.5").collect()}
    assert found == {(i, i) for i in range(len(names))}
    assert shuffled_rows(spark) - before < 120 * len(names)
