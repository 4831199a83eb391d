"""Merging two company lists: pairs confirmed by hand, equal names, then the most similar names one to one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import merge_name
from ledgerloom.operators.index import counted_before
from ledgerloom.session import cut

# --- fixed values: pairs that a person confirmed, and pairs that a person ruled out -----------------------------------
MANUAL = {
    "Salesforce": "Salesforce",
    "Walmart": "Walmart",
    "Novo Nordisk": "Novo Nordisk",
    "Stellantis": "Stellantis",
    "UnitedHealth": "UnitedHealth",
    "Santander": "Santander",
    "Standard Chartered": "Standard Chartered",
    "McDonald's": "McDonald's",
    "Lowe's": "Lowe's",
    "L'Oréal": "L'Oréal",
    "L'Oreal": "L'Oréal",
    "ExxonMobil": "ExxonMobil",
    "US Bancorp": "US Bancorp",
    "Anheuser-Busch InBev": "Anheuser-Busch InBev",
}
RULED_OUT = [
    ("3D Technologies", "Dell"),
    ("GM Financial", "Mizuho"),
    ("Cox", "Bank of Communications"),
    ("OCBC", "ICBC"),
    ("HP", "BHP"),
    ("aiTouch", "Itochu"),
    ("DBS", "TD Bank"),
    ("SVB", "KB Financial"),
    ("Change Healthcare", "HCA"),
    ("Tesla", "Tata"),
    ("latentbridge", "Enbridge"),
]
PART = 1 << 16  # names of one side that meet those of the other in a task
BITS = 64  # letters of a name that fit a machine word
# -----------------------------------------------------------------------------------------------------------------------


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|) of the names with their words sorted. The LCS's row of steps is one number, a bit for
    each letter of ``b`` (Hyyro)."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not x and not y:
        return 100.0
    places: dict[str, int] = {}
    for i, p in enumerate(y):
        places[p] = places.get(p, 0) | 1 << i
    full = row = (1 << len(y)) - 1
    for p in x:
        u = row & places.get(p, 0)
        row = (row + u | row - u) & full
    return 200.0 * (len(y) - row.bit_count()) / (len(x) + len(y))


class _Side:
    """The names of one side of a cell, shortest first, as numbers of their letters."""

    def __init__(self, keys: list[str], names: list[str]):
        at = sorted(range(len(names)), key=lambda i: len(names[i]))
        self.keys, self.names = [keys[i] for i in at], [names[i] for i in at]
        self.size = np.array([len(s) for s in self.names], np.int64)
        self.text = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32)
        self.row = np.repeat(np.arange(len(at)), self.size)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(self.size) - self.size, self.size)

    def encode(self, letters: np.ndarray) -> None:
        code, self.short = np.searchsorted(letters, self.text), self.nth < BITS  # names of over BITS letters are compared one by one
        self.count = np.bincount(self.row * len(letters) + code, minlength=len(self.size) * len(letters)).reshape(-1, len(letters))
        at = self.row[self.short], self.nth[self.short], code[self.short]
        self.code = np.full((len(self.size), BITS), len(letters), np.int64)
        self.code[at[0], at[1]] = at[2]
        self.places = np.zeros((len(self.size), len(letters) + 1), np.uint64)
        np.bitwise_or.at(self.places, (at[0], at[2]), np.uint64(1) << at[1].astype(np.uint64))


def _bags(x: _Side, y: _Side) -> None:
    """``bag``: a bit for each letter that a name has once more, for the most frequent of these; ``more``: how many it has besides."""
    most = np.minimum(x.count.max(0), y.count.max(0))
    feats = [(c, k) for c in range(len(most)) for k in range(most[c])]
    often = np.array([(x.count[:, c] > k).mean() * (y.count[:, c] > k).mean() for c, k in feats])
    used = np.argsort(-often, kind="stable")[: 64 * min(3, max(1, -(-int((often > 1e-4).sum()) // 64)))]
    for d in (x, y):
        bits = np.zeros((len(d.size), -(-max(1, len(used)) // 64) * 64), np.uint8)
        for i, f in enumerate(used):
            bits[:, i] = d.count[:, feats[f][0]] > feats[f][1]
        d.more = np.minimum(d.count, most).sum(1) - bits.sum(1, dtype=np.int64)
        d.bag = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


def _ratios(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``token_sort_ratio`` of the pairs of rows ``i`` and ``j``, the steps of all pairs at a time."""
    out = np.empty(len(i))
    for p in range(0, len(i), 4096):
        a, b = i[p : p + 4096], j[p : p + 4096]
        code, start, masks = np.ascontiguousarray(x.code[a, : min(BITS, x.size[a].max())].T), b * y.places.shape[1], y.places.ravel()
        row, at, u, w = np.full(len(a), ~np.uint64(0)), np.empty(len(a), np.int64), np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        for c in code:
            np.add(start, c, out=at)
            np.take(masks, at, out=u, mode="clip")
            np.bitwise_and(row, u, out=u)
            np.add(row, u, out=w)
            np.subtract(row, u, out=row)
            np.bitwise_or(row, w, out=row)
        out[p : p + 4096] = 200.0 * np.bitwise_count(~row) / (x.size[a] + y.size[b])
    for k in np.flatnonzero((x.size[i] > BITS) | (y.size[j] > BITS)):
        out[k] = token_sort_ratio(x.names[i[k]], y.names[j[k]])
    return out


def _similar(x: _Side, y: _Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, score)`` of all pairs of rows with a ratio of ``threshold`` or more."""
    letters = np.unique(np.concatenate([x.text, y.text]))
    for d in (x, y):
        d.encode(letters)
    _bags(x, y)
    ratio, n = threshold / (200 - threshold), len(y.size)
    both, ones, shared, passed = np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, np.uint8), np.empty(n, bool)
    last, held, pairs = None, 0, []

    def scored() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.repeat([a for a, _ in pairs], [len(b) for _, b in pairs]), np.concatenate([b for _, b in pairs])
        s = _ratios(x, y, i, j)
        return i[s >= threshold], j[s >= threshold], s[s >= threshold]

    for i in np.lexsort((x.more, x.size)):
        if last != (now := (x.size[i], x.more[i])):
            last = now
            lo, hi = np.searchsorted(y.size, np.ceil(ratio * now[0] - 1e-6)), np.searchsorted(y.size, np.floor(now[0] / ratio + 1e-6), "right")
            least = np.clip(np.ceil(threshold * (now[0] + y.size[lo:hi]) / 200 - 1e-6) - np.minimum(now[1], y.more[lo:hi]), 0, 255).astype(np.uint8)
        if lo == hi:
            continue
        v, o, s, h = both[lo:hi], ones[lo:hi], shared[lo:hi], passed[lo:hi]
        for k, bag in enumerate(y.bag):
            np.bitwise_and(bag[lo:hi], x.bag[k, i], out=v)
            np.bitwise_count(v, out=o if k else s)
            if k:
                np.add(s, o, out=s)
        np.greater_equal(s, least, out=h)
        if len(j := np.flatnonzero(h)):
            pairs.append((i, j + lo))
            held += len(j)
        if held >= 1 << 16:
            yield scored()
            held, pairs = 0, []
    if pairs:
        yield scored()


def _numbered(names: DataFrame) -> DataFrame:
    """``(row, name, key, nth)``: which of the rows of its key a row is. Ranks come from range partitions, so that a
    key of very many rows meets in no task."""
    at = counted_before(names.select(F.struct("key", "row").alias("at"), F.lit(1).alias("one")), "at", "one")
    ranked = cut(at.select("at.key", "at.row", "before"))
    return names.join(ranked.select("row", "before"), "row").join(ranked.groupBy("key").agg(F.min("before").alias("first")), "key").select("row", "name", "key", (F.col("before") - F.col("first")).alias("nth"))


def _cells(nx: int, ny: int, cores: int) -> tuple[int, int]:
    """Into how many parts the two sides go: some pairs of parts for each core unless there is little to compare, and
    no part above ``PART`` names."""
    cells = min(8 * cores, math.ceil(nx * ny / 4e6))
    p = max(1, math.ceil(nx / PART), math.ceil(math.sqrt(cells * nx / max(1, ny))))
    return p, max(1, math.ceil(ny / PART), math.ceil(cells / p))


def similar_keys(b: DataFrame, o: DataFrame, threshold: float) -> DataFrame:
    """``(x, y, score)`` for all keys of the two frames (column ``key``) with a ratio of ``threshold`` or more.

    At 75 a quarter of the letters of both may differ, so nothing that an index could look up need be shared: every
    part of one side meets every part of the other, each pair of parts in a task of its own. There a pair of names
    costs a few operations on bits, as it must share LCS = t (m + n) / 200 letters in any order; those that do
    (some 2 in 100) are aligned."""
    if not 0 < threshold <= 100:
        raise ValueError("a ratio lies above 0 and up to 100")
    x, y = (cut(d.where("key <> ''").select("key", F.array_join(F.array_sort(F.array_remove(F.split("key", " "), "")), " ").alias("s")).distinct()) for d in (b, o))
    p, q = _cells(x.count(), y.count(), b.sparkSession.sparkContext.defaultParallelism)
    part = lambda n: F.pmod(F.hash("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = x.select(F.lit(True).alias("base"), "key", "s", part(p).alias("p"), every(q).alias("q")).unionByName(y.select(F.lit(False).alias("base"), "key", "s", every(p).alias("p"), part(q).alias("q")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[bool, list[str]] = {True: [], False: []}
        names: dict[bool, list[str]] = {True: [], False: []}
        for r in batches:
            for base, key, name in zip(*(c.to_pylist() for c in r.columns)):
                keys[base].append(key)
                names[base].append(name)
        if keys[True] and keys[False]:
            own, other = (_Side(keys[base], names[base]) for base in (True, False))
            for i, j, s in _similar(own, other, threshold):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([own.keys[k] for k in i], pa.string()), pa.array([other.keys[k] for k in j], pa.string()), pa.array(s, pa.float64())], names=["x", "y", "score"])

    cell = (F.col("p") * q + F.col("q")).cast("int")
    return sides.select("base", "key", "s", cell.alias("cell")).repartitionById(p * q, F.col("cell")).drop("cell").mapInArrow(compared, "x string, y string, score double")


def _vetoed(base: Column, other: Column, ruled_out) -> Column:
    v = F.lit(False)
    for x, y in ruled_out:
        v = v | (F.contains(F.lower(base), F.lit(x.lower())) & F.contains(F.lower(other), F.lit(y.lower())))
    return v


def in_turn(pairs: DataFrame) -> DataFrame:
    """``(base_row, other_row, score)``: the rows of ``other`` choose in their order, each the best row of ``base`` that is
    left. Found by offers: every row offers itself to its best choice, which keeps the first in order and is lost for good
    to all that come later; these try their next. With one order of precedence for all this has one outcome, that of
    choosing in turn."""
    left = cut(pairs.select("base_row", "other_row", "score"))
    n = left.count()
    while True:
        offer = left.groupBy("other_row").agg(F.max_by(F.struct("base_row", "score"), F.struct("score", -F.col("base_row"))).alias("o")).select("other_row", "o.*")
        kept = offer.groupBy("base_row").agg(F.min("other_row").alias("holder"))
        left = cut(left.join(kept, "base_row", "left").where("holder IS NULL OR other_row <= holder").select("base_row", "other_row", "score"))
        before, n = n, left.count()
        if n == before:
            return offer.select("base_row", "other_row", "score")


def merge_lists(base: DataFrame, other: DataFrame, threshold: float = 75.0, manual: dict[str, str] = MANUAL, ruled_out=RULED_OUT) -> DataFrame:
    """``(base_row, other_row, how, score)``: at most one partner each, rows of ``other`` in their order first.

    Both tables have ``row`` (a unique number) and ``name``. Null and blank names match nothing but by hand."""
    b, o = (cut(d.select("row", "name", merge_name(F.col("name")).alias("key"))) for d in (base, other))
    found = lambda d, parts: d.agg(*(F.min(F.when(F.contains(F.lower("name"), F.lit(x.lower())), F.col("row"))).alias(f"_{i}") for i, x in enumerate(parts))).first() if parts else ()
    hand = list(zip(found(b, list(manual)), found(o, list(manual.values()))))  # a short fixed list
    taken: dict[int, int] = {}
    for i, j in hand:
        if i is not None and j is not None and j not in taken.values():
            taken.setdefault(i, j)
    done = b.sparkSession.createDataFrame([(i, j, "manual", 100.0) for i, j in taken.items()], "base_row long, other_row long, how string, score double")
    free = lambda d, c: d.join(F.broadcast(done.select(F.col(c).alias("row"))), "row", "left_anti")
    nb, no = _numbered(free(b, "base_row").where("key <> ''")), _numbered(free(o, "other_row").where("key <> ''"))
    exact = cut(nb.select("key", "nth", F.col("row").alias("base_row")).join(no.select("key", "nth", F.col("row").alias("other_row")), ["key", "nth"]).select("base_row", "other_row", F.lit("exact").alias("how"), F.lit(100.0).alias("score")))
    rest_b = nb.join(exact, nb["row"] == exact["base_row"], "left_anti")
    rest_o = no.join(exact, no["row"] == exact["other_row"], "left_anti")
    near = similar_keys(rest_b, rest_o, threshold)
    pairs = (
        near.join(rest_b.select(F.col("key").alias("x"), F.col("row").alias("base_row"), F.col("name").alias("bn")), "x").join(rest_o.select(F.col("key").alias("y"), F.col("row").alias("other_row"), F.col("name").alias("on")), "y")
        .where(~_vetoed(F.col("bn"), F.col("on"), ruled_out))
    )
    fuzzy = in_turn(pairs).select("base_row", "other_row", F.lit("fuzzy").alias("how"), "score")
    return done.unionByName(exact).unionByName(fuzzy)
