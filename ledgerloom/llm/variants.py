"""Variant spellings of names typed by people (problem 5).

What words tell the line of business, and which of them stand for each other, is learned from the names. Names are
brought to a normal form of family, line of business and initial of a given name. Its distinct values are the nodes;
the words of a family count in whatever order they were typed. The families become character n-gram vectors weighted
by rarity; a sparse cosine join finds all similar pairs within a line of business. Average-linkage clustering then groups the nodes: in every round all pairs of clusters
that are each other's nearest neighbours merge, which for average linkage gives the same tree as one merge at a
time; sums of similarities are all a round needs, so it runs as joins and aggregates and no group meets in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import fsum, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.names import GIVEN, Lexicon, core_words, distance_in_any_order, shortened, within
from ledgerloom.session import cut, release


def learn_lexicon(names: DataFrame, name: str = "name", relative: float = 0.25, floor: int = 7, share: float = 0.0002, together: float = 0.25) -> Lexicon:
    """The words of ``names`` that say what an organisation does, with their classes.

    Such a word stands beside very many different words, a family name beside few: counted are the different first two
    letters of the words beside it (typing errors hardly add to them). A word is an entry if it has at least ``floor``
    of them, ``relative`` of what the word with most has, and stands in ``share`` of the names, so there are at most
    words per name / ``share`` entries, a bound that does not grow with the table: this is what reaches the driver and
    the workers. Two entries are of one class if they begin alike, one shortens the other or lies two edits off, and they stand for each
    other: in at least ``together`` of the families where the rarer one changes place with some entry, it is with the other.
    """
    split = F.udf(lambda n: sorted({w for w in core_words(n) if w not in GIVEN and len(w) > 1}), "array<string>", useArrow=True)
    keys = cut(names.select(F.array_join(split(name), " ").alias("w")).where("w LIKE '% %'").distinct()).select(F.split("w", " ").alias("w"))
    beside = keys.select(F.explode("w").alias("x"), "w").select("x", F.explode(F.array_distinct(F.transform(F.filter("w", lambda y: y != F.col("x")), lambda y: F.substring(y, 1, 2)))).alias("y"))
    per = beside.groupBy("x", "y").agg(F.count("*").alias("n")).groupBy("x").agg(F.count("*").alias("beside"))
    df = keys.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    top = F.broadcast(per.agg(F.max("beside").alias("top")).crossJoin(keys.agg(F.count("*").alias("all"))))  # one row
    entries = cut(per.join(df, "x").crossJoin(top).where((F.col("beside") >= floor) & (F.col("beside") >= relative * F.col("top")) & (F.col("df") >= share * F.col("all"))).select("x"))
    words = [r["x"] for r in entries.collect()]  # bounded by 1 / share
    # who changes place with whom: entries of names that are equal but for them
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    family = keys.select(F.array_join(F.array_except("w", known), " ").alias("rest"), F.explode(F.array_intersect("w", known)).alias("x")).where("rest <> ''").distinct()
    several = cut(family.join(family.groupBy("rest").agg(F.count("*").alias("k")).where("k > 1"), "rest"))
    pairs = several.select("rest", F.col("x").alias("a")).join(several.select("rest", F.col("x").alias("b")), "rest").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    each = {r["x"]: r["n"] for r in several.groupBy("x").agg(F.count("*").alias("n")).collect()}
    parent = {w: w for w in words}

    def root(w: str) -> str:
        while parent[w] != w:
            w = parent[w]
        return w

    # pairs of entries; a short form stands for one word only, the one it is met with most
    met = [(r["n"] / min(each[r["a"]], each[r["b"]]), r["n"], *sorted((r["a"], r["b"]), key=lambda w: (len(w), w))) for r in pairs.collect()]
    bound = set()
    for rate, _, short, long in sorted(met, reverse=True):
        if short not in bound and rate >= together and short[0] == long[0] and (shortened(short, long) or within(short, long, 2)):
            bound.add(short)
            x, y = sorted((root(short), root(long)))
            parent[y] = x
    return Lexicon({w: root(w) for w in words})


def name_nodes(names: DataFrame, name: str = "name", lexicon: Lexicon | None = None) -> DataFrame:
    """``(name, node, line, family)`` for every distinct name that is no placeholder; ``family`` has its words in
    alphabetical order. The lexicon is learned from ``names`` if none is given."""
    lex = lexicon or learn_lexicon(names, name)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(n, " ".join(sorted(p[0])), *p[1:]) for n in b.column(0).to_pylist() if (p := lex.parts(n)) is not None and any(p[0])]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            node = [f"{line}|{family}|{given[:1]}" for family, line, given in zip(*cols[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in (cols[0], node, cols[2], cols[1])], ["name", "node", "line", "family"])

    return names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().mapInArrow(run, "name string, node string, line string, family string")


def _letters(family: str) -> int:
    """64 bits of a family's letters and digits: which there are, and which letters there are twice. An edit sets one bit at
    most and clears one at most; the order of the words and the blanks say nothing."""
    bits = 0
    for c in set(family) - {" "}:
        bits |= 1 << (ord(c) - 97 if c > "9" else ord(c) - 22)
        if c > "9" and family.count(c) > 1:
            bits |= 1 << (ord(c) - 61)
    return bits


def _grams(family: str, n: int) -> Counter:
    """The n-grams of a family with their counts. They lie within words, so the order of the words says nothing."""
    return Counter(p[i : i + n] for w in family.split(" ") for p in (f"#{w}#",) for i in range(max(len(p) - n + 1, 1)))


def similar_nodes(nodes: DataFrame, threshold: float = 0.25, n: int = 3, typos: float = 0.25) -> DataFrame:
    """``(a, b, cosine, edits, s)`` with a < b for all nodes of one line whose families have a cosine of ``threshold``
    or more. ``s``, the square root of the cosine, is the similarity that clustering and linkage use. An exact check
    goes with it: pairs more than ``typos`` edits per letter (4 at most) apart, in the order of words that suits best, are no
    variants of one another. No pair is capped. Nodes meet under the n-grams they share, the commonest of a node left out as
    far as these can't reach ``threshold`` by themselves; a meeting ends at once if the letters of the two differ by more
    than the edits allowed. The rest is decided where it meets, so only similar pairs are ever moved: what is written
    grows with the nodes, not with their meetings."""
    d = cut(nodes.select("node").distinct())
    release(d)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for x in it:
            for node in x.column(0).to_pylist():
                c.update(_grams(node.split("|")[1], n).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["g", "df"])

    # names are folded to 36 signs, so there are some 37 ** n n-grams at most, however many names
    df = {r["g"]: r["df"] for r in d.mapInArrow(count, "g string, df long").groupBy("g").agg(F.sum("df").alias("df")).collect()}
    total = d.count()

    def vector(family: str) -> dict[str, float]:
        """Weights of length 1, the rarest n-gram first."""
        # an n-gram that one node has alone is often a typo: rarity is smoothed so that it doesn't outweigh the rest
        w = {g: tf * log(1 + total / (df[g] + 5)) for g, tf in _grams(family, n).items()}
        norm = sqrt(fsum(x * x for x in w.values()))
        return {g: w[g] / norm for g in sorted(w, key=lambda g: (df[g], g))}

    def spell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            rows = []
            for node in x.column(0).to_pylist():
                line, f, _ = node.split("|")
                name, bits, most, rest = node[len(line) + 1 :], _letters(f), min(4, int(typos * len(f.replace(" ", "")))), 1.0
                for g, w in vector(f).items():
                    if rest < threshold * threshold - 1e-9:
                        break
                    rest -= w * w
                    if df[g] > 1:  # what one node has alone meets no other
                        rows.append((f"{g}|{line}", name, bits, most))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int8()))], ["key", "name", "bits", "most"])

    v = d.mapInArrow(spell, "key string, name string, bits long, most byte")
    a, b = (v.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("name", "bits", "most"))) for x in "ab")
    most = F.least("most_a", "most_b")
    lacks = lambda x, y: F.bit_count(F.col(f"bits_{x}").bitwiseAND(F.bitwise_not(f"bits_{y}")))
    meet = a.join(b, "key").where((F.col("name_a") < F.col("name_b")) & (lacks("a", "b") <= most) & (lacks("b", "a") <= most))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(20_000)(vector)
        for x in it:
            rows = []
            for key, na, nb, most in zip(*(x.column(k).to_pylist() for k in ("key", "name_a", "name_b", "most"))):
                (p, i), (q, j), (g, line) = na.split("|"), nb.split("|"), key.split("|")
                if i and j and i != j:
                    continue
                u, v = known(p), known(q)
                both = (h for h in u if h in v)
                if next(both) != g:  # a pair counts where it meets first
                    continue
                c = fsum((u[g] * v[g], *(u[h] * v[h] for h in both)))
                if c >= threshold and (e := distance_in_any_order(p, q, most)) <= most:
                    rows.append((f"{line}|{na}", f"{line}|{nb}", c, e, min(c, 1.0) ** 0.5))
            cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64()))], ["a", "b", "cosine", "edits", "s"])

    return meet.select("key", "name_a", "name_b", most.cast("int").alias("most")).mapInArrow(check, "a string, b string, cosine double, edits int, s double")


def average_linkage(edges: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(node, cluster)`` for every node of ``edges (a, b, s)``, a < b. Pairs without an edge count as similarity 0.
    Rounds go on until no pair is left to merge."""
    e = cut(edges.select("a", "b", "s"))
    member = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")))
    while True:
        release(e)
        size = member.groupBy("cluster").agg(F.count("*").alias("n"))
        avg = (
            e.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
            .withColumn("avg", F.col("s") / (F.col("na") * F.col("nb"))).where(F.col("avg") >= threshold)
        )
        # one order of all pairs, so the best pair is always mutual; ties go by a hash, so that many pairs of a group
        # of ties are mutual in a round. A pair's average is computed once, so both its ends see the same
        pair = F.struct("avg", F.xxhash64("a", "b").alias("tie"), F.col("b").alias("hi"), F.col("a").alias("lo"))
        best = avg.select(pair.alias("p"), F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.max("p").alias("p")).select("p.hi", "p.lo")
        mutual = cut(best.groupBy("hi", "lo").agg(F.count("*").alias("k")).where("k = 2").select(F.col("hi").alias("old"), F.col("lo").alias("new")))
        if mutual.isEmpty():
            return member
        member = cut(member.join(mutual, F.col("cluster") == F.col("old"), "left").select("node", F.coalesce("new", "cluster").alias("cluster")))
        ma, mb = mutual.select(F.col("old").alias("oa"), F.col("new").alias("na")), mutual.select(F.col("old").alias("ob"), F.col("new").alias("nb"))
        e = cut(
            e.join(ma, F.col("a") == F.col("oa"), "left").join(mb, F.col("b") == F.col("ob"), "left")
            .select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "s").where("a <> b")
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"))
        )


def name_clusters(names: DataFrame, name: str = "name", cosine: float = 0.25, linkage: float = 0.3) -> DataFrame:
    """``(name, cluster)`` for every distinct name; placeholders and null names have no row, an unmatched name is a
    cluster of its own."""
    nodes = cut(name_nodes(names, name).select("name", "node"))
    member = average_linkage(similar_nodes(nodes, cosine).select("a", "b", "s"), linkage)
    return nodes.join(member, "node", "left").select("name", F.coalesce("cluster", "node").alias("cluster"))


def name_pairs(clusters: DataFrame) -> DataFrame:
    """Every pair of different names of one cluster, name_a < name_b."""
    a, b = clusters.select("cluster", F.col("name").alias("name_a")), clusters.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b").distinct()
