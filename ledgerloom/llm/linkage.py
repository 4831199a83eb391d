"""Matching entities across sources without keys (problem 3).

Soft-logic linkage. Every candidate pair of records is a truth value in [0, 1]. Weighted rules are hinge losses on
these values: similar names, equal tickers and near figures speak for a pair, distant names and different figures
against it, a record has at most one partner per source (exclusivity), and pairs that meet in one record agree
(transitivity). The sum of the losses is convex. Consensus ADMM minimises it: each rule solves for its own copies of
the values in closed form, then the copies of a value are averaged. Rules never join values of different connected
components of the candidate graph, so components are sent to partitions and solved there to the end; one too large for
that is solved by joins and aggregates over tables of rules and values. The final values are the confidences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.survivors import gvkey8
from ledgerloom.llm.variants import name_nodes, similar_nodes
from ledgerloom.session import cut, release


def solve_hinge_admm(rules: DataFrame, rounds: int = 400, rho: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """Minimise Σ weight · max(0, Σ coef · value + offset) over values in [0, 1].

    ``rules``: one row per (rule, var) with ``coef``, ``offset`` and ``weight`` (the same on all rows of a rule; a
    null weight makes the rule a hard constraint). Result: ``(var, value, residual)``, the residual being how far the
    value moved in the last round and how far its copies lie apart: rounds go on until both are below ``tol``
    everywhere, at most ``rounds``.
    """
    # rules and values travel as 64-bit ids; only the result has the values' names again
    rules = cut(rules.select(F.xxhash64("rule").alias("rule"), F.xxhash64("var").alias("var"), "coef", "offset", "weight", F.col("var").alias("name")))
    named = rules.select("var", "name").distinct()
    return _by_joins(rules.drop("name"), rounds, rho, tol).join(named, "var").select(F.col("name").alias("var"), "value", "residual")


def _by_joins(rules: DataFrame, rounds: int, rho: float, tol: float) -> DataFrame:
    """The solver over tables of rules and values: a problem of any size, nothing of it in one task."""
    norm = rules.groupBy("rule").agg(F.sum(F.col("coef") * F.col("coef")).alias("norm"))
    state = cut(rules.join(norm, "rule").withColumns({"u": F.lit(0.0), "z": F.lit(0.5), "moved": F.lit(1.0)}))
    for _ in range(rounds):
        v = state.withColumn("v", F.col("z") - F.col("u"))
        total = v.groupBy("rule").agg(F.sum(F.col("coef") * F.col("v")).alias("av"))
        # closed form of a hinge and a quadratic: move along the rule's coefficients, at most weight / rho far
        over = F.greatest(F.col("av") + F.col("offset"), F.lit(0.0))
        step = F.least(over / F.col("norm"), F.coalesce(F.col("weight") / rho, F.lit(1e9)))
        moved = v.join(total, "rule").withColumn("x", F.col("v") - step * F.col("coef")).drop("av", "v")
        mean = moved.groupBy("var").agg(F.least(F.greatest(F.avg(F.col("x") + F.col("u")), F.lit(0.0)), F.lit(1.0)).alias("z_new"))
        state = cut(
            moved.join(mean, "var").withColumn("u", F.col("u") + F.col("x") - F.col("z_new")).withColumn("moved", F.greatest(F.abs(F.col("z_new") - F.col("z")), F.abs(F.col("x") - F.col("z_new")))).withColumn("z", F.col("z_new")).drop("z_new", "x")
        )
        most = state.agg(F.max("moved")).first()[0]
        if most is None or most < tol:
            break
    return state.groupBy("var").agg(F.first("z").alias("value"), F.max("moved").alias("residual"))


def _solve_arrays(rule: np.ndarray, var: np.ndarray, coef: np.ndarray, offset: np.ndarray, weight: np.ndarray, rounds: int, rho: float, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same steps on arrays: (var, value, residual)."""
    _, r = np.unique(rule, return_inverse=True)
    ids, v = np.unique(var, return_inverse=True)
    norm, copies = np.bincount(r, coef * coef), np.bincount(v)
    most = np.where(np.isnan(weight), 1e9, weight / rho)
    u, z, moved = np.zeros(len(r)), np.full(len(ids), 0.5), np.ones(len(ids))
    for _ in range(rounds):
        x = z[v] - u
        over = np.maximum(np.bincount(r, coef * x)[r] + offset, 0.0)
        x -= np.minimum(over / norm[r], most) * coef
        new = np.clip(np.bincount(v, x + u) / copies, 0.0, 1.0)
        moved, z = np.abs(new - z), new
        np.maximum.at(moved, v, np.abs(x - z[v]))
        u += x - z[v]
        if moved.max(initial=0.0) < tol:
            break
    return ids, z, moved


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of the graph of ``pairs (a, b)``: every node takes the least label around it and then the
    label of that label, until none changes. Labels are 64-bit ids; each round is two joins and an aggregate."""
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        release(label)
        around = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        least = label.join(around, "node").select("node", F.least("component", "m").alias("new"), F.col("component").alias("old"))
        jump = label.select(F.col("node").alias("new"), F.col("component").alias("further"))
        label = cut(least.join(jump, "new", "left").select("node", F.least("new", "further").alias("component"), "old"))
        if label.where("component <> old").isEmpty():
            return label.select("node", "component")
        label = label.select("node", "component")


def solve_by_component(rules: DataFrame, ends: DataFrame, rounds: int = 400, rho: float = 1.0, tol: float = 1e-3, most: int = 200_000) -> DataFrame:
    """``solve_hinge_admm`` with the problem split where it falls apart: ``ends (var, a, b)`` names the two records of a
    value, and no rule joins values of different components of that graph. Components are solved to the end inside
    the partition they are sent to, many at a time; those of more than ``most`` rows of rules go through the joins."""
    # the rules are written once, as 64-bit ids with their component; the values' names stay in ``ends``
    of = ends.select(F.xxhash64("var").alias("var"), F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct()
    label = components(of).select(F.col("node").alias("a"), "component")
    ids = rules.select(F.xxhash64("rule").alias("rule"), F.xxhash64("var").alias("var"), "coef", "offset", "weight")
    tagged = cut(ids.join(of.join(label, "a").select("var", "component"), "var"))
    size = cut(tagged.groupBy("component").agg(F.count("*").alias("size")))
    release(tagged)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if len(b)]
        if got:
            t = pa.Table.from_batches(got)
            cols = [t.column(c).to_numpy() for c in ("rule", "var", "coef", "offset")]
            ids, z, moved = _solve_arrays(*cols, np.array(t.column("weight").to_pandas(), float), rounds, rho, tol)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(z), pa.array(moved)], ["var", "value", "residual"])

    cores = tagged.sparkSession.sparkContext.defaultParallelism
    # so many partitions that each holds about as much as the largest component may
    total = size.where(F.col("size") <= most).agg(F.sum("size")).first()[0] or 0
    n = max(cores, -(-total // most), 1)
    part = lambda which: tagged.join(size.where(which).select("component"), "component").select("rule", "var", "coef", "offset", "weight", "component")
    out = part(F.col("size") <= most).repartition(n, "component").drop("component").mapInArrow(run, "var long, value double, residual double")
    if not size.where(F.col("size") > most).isEmpty():
        out = out.unionByName(_by_joins(part(F.col("size") > most).drop("component"), rounds, rho, tol))
    named = ends.select(F.xxhash64("var").alias("var"), F.col("var").alias("name")).distinct()
    return out.join(named, "var").select(F.col("name").alias("var"), "value", "residual")


def ticker_key(c):
    """A ticker without exchange prefix and share class; null for placeholders."""
    t = F.upper(F.trim(F.regexp_replace(F.trim(c), r"^[A-Za-z]{2,6}:\s*", "")))
    t = F.regexp_replace(F.regexp_replace(t, r"[.\-/][A-Z]$", ""), r"[^A-Z0-9]", "")
    return F.when(~t.isin("", "NAN", "NA", "NONE", "NULL"), t)


def money(c):
    """A formatted figure as a number: $1,549.9 -> 1549.9; null if it is none."""
    return F.expr(f"try_cast(regexp_replace({c}, '[^0-9.]', '') AS double)")


def _near(a, b):
    """1 for equal figures, 0 for figures that differ by half or more; null if one is missing."""
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - 2 * F.abs(a - b) / F.greatest(a, b)))


def link(fortune: DataFrame, eto_core: DataFrame, eto_ticker: DataFrame, eto_alias: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """``(rank, source, entity_id, confidence)`` for every candidate pair of a firm and a record of ``eto`` or
    ``fundamentals``. Null names, tickers and figures say nothing; copies of a record count once; a record with
    several spellings, tickers or years is compared by the nearest. Empty tables give an empty result."""
    names = cut(
        fortune.select(F.lit("f").alias("side"), F.col("rank").cast("string").alias("id"), F.col("company").alias("name"))
        .unionByName(eto_core.select(F.lit("e").alias("side"), F.col("eto_id").cast("string").alias("id"), F.col("eto_name").alias("name")))
        .unionByName(eto_alias.select(F.lit("e").alias("side"), F.col("eto_id").cast("string").alias("id"), F.col("alias").alias("name")))
        .unionByName(fundamentals.where(F.col("gvkey").isNotNull()).select(F.lit("g").alias("side"), gvkey8(F.col("gvkey")).alias("id"), F.col("conm").alias("name")))
        .distinct()
    )
    nodes = cut(name_nodes(names).select("name", "node"))
    edges = similar_nodes(nodes).select("a", "b", "s")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct().withColumn("s", F.lit(1.0))))
    at = cut(names.join(nodes.select("name", "node"), "name").select("side", "id", "node").distinct())
    del names, nodes, edges
    release(at)
    # candidates by name, from each firm's own spelling and those of its records
    side = lambda s, n: at.where(F.col("side") == s).select(F.col("id").alias(n), F.col("node").alias(f"node_{n}"))

    def by_name(s: str, t: str) -> DataFrame:
        left, right = side(s, s), side(t, t)
        return left.join(both, F.col(f"node_{s}") == F.col("a")).join(right, F.col("b") == F.col(f"node_{t}")).groupBy(s, t).agg(F.max("s").alias("name_sim"))

    ft = fortune.select(F.col("rank").cast("string").alias("f"), ticker_key(F.col("ticker")).alias("tick"), money("assets").alias("assets"), money("employees").alias("staff")).distinct()
    et = eto_ticker.select(F.col("eto_id").cast("string").alias("e"), ticker_key(F.col("ticker")).alias("tick")).distinct()
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    gt = fundamentals.where(F.col("gvkey").isNotNull()).select(gvkey8(F.col("gvkey")).alias("g"), ticker_key(F.col("tic")).alias("tick"), num("at").alias("at"), (num("emp") * 1000).alias("emp")).distinct()
    tick_g = gt.select("g", "tick").distinct()
    size = gt.groupBy("g").agg(F.collect_set("at").alias("ats"), F.collect_set("emp").alias("emps"))

    fe = by_name("f", "e")
    tick_fe = ft.select("f", "tick").distinct().join(et, "tick").select("f", "e").distinct().withColumn("same_tick", F.lit(1))
    fe = cut(fe.join(tick_fe, ["f", "e"], "full").select("f", "e", F.coalesce("name_sim", F.lit(0.0)).alias("name_sim"), F.coalesce("same_tick", F.lit(0)).alias("same_tick")))
    release(fe)
    fg = by_name("f", "g")
    tick_fg = ft.select("f", "tick").distinct().join(tick_g, "tick").select("f", "g").distinct().withColumn("same_tick", F.lit(1))
    best = lambda xs, y: F.array_max(F.transform(xs, lambda x: _near(x, y)))
    fg = cut(
        fg.join(tick_fg, ["f", "g"], "full").join(ft.groupBy("f").agg(F.max("assets").alias("assets"), F.max("staff").alias("staff")), "f").join(size, "g")
        .select("f", "g", F.coalesce("name_sim", F.lit(0.0)).alias("name_sim"), F.coalesce("same_tick", F.lit(0)).alias("same_tick"), best("ats", F.col("assets")).alias("assets_sim"), best("emps", F.col("staff")).alias("staff_sim"))
    )
    eg = cut(by_name("e", "g"))
    del both, at
    release(eg)

    var = lambda kind, a, b: F.concat_ws(":", F.lit(kind), a, b)
    fev, fgv, egv = fe.withColumn("var", var("fe", "f", "e")), fg.withColumn("var", var("fg", "f", "g")), eg.withColumn("var", var("eg", "e", "g"))

    def rule(df: DataFrame, tag: str, coef: float, offset, weight) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(tag), "var").alias("rule"), "var", F.lit(coef).alias("coef"), F.lit(offset).cast("double").alias("offset") if not hasattr(offset, "_jc") else offset.cast("double").alias("offset"), F.lit(weight).cast("double").alias("weight"))

    def hard(df: DataFrame, tag: str, by: str) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(tag), by).alias("rule"), "var", F.lit(1.0).alias("coef"), F.lit(-1.0).alias("offset"), F.lit(None).cast("double").alias("weight"))

    rules = [
        # similar name => same: the value falls short of the similarity
        rule(fev, "name", -1.0, F.col("name_sim"), 1.0), rule(fgv, "name", -1.0, F.col("name_sim"), 1.0), rule(egv, "name", -1.0, F.col("name_sim"), 1.0),
        # distant name => not same: weaker than an equal ticker and near figures together, stronger than any of them
        rule(fev, "far", 1.0, -F.col("name_sim"), 0.5), rule(fgv, "far", 1.0, -F.col("name_sim"), 0.5),
        # equal tickers and near figures speak for, but tickers get stale and are used again
        rule(fev.where("same_tick = 1"), "tick", -1.0, 1.0, 0.4), rule(fgv.where("same_tick = 1"), "tick", -1.0, 1.0, 0.4),
        rule(fgv.where("assets_sim IS NOT NULL"), "at", -1.0, F.col("assets_sim"), 0.2), rule(fgv.where("staff_sim IS NOT NULL"), "emp", -1.0, F.col("staff_sim"), 0.2),
        rule(fgv.where("assets_sim IS NOT NULL"), "atx", 1.0, -F.col("assets_sim"), 0.1), rule(fgv.where("staff_sim IS NOT NULL"), "empx", 1.0, -F.col("staff_sim"), 0.1),
        # prior: a pair is not the same
        rule(fev, "prior", 1.0, 0.0, 0.1), rule(fgv, "prior", 1.0, 0.0, 0.1), rule(egv, "prior", 1.0, 0.0, 0.1),
        # exclusivity
        hard(fev, "one_e", "f"), hard(fev, "one_fe", "e"), hard(fgv, "one_g", "f"), hard(fgv, "one_fg", "g"), hard(egv, "one_eg", "e"), hard(egv, "one_ge", "g"),
    ]
    # transitivity: two of a triangle's pairs imply the third
    tri = cut(fev.select("f", "e", F.col("var").alias("v1")).join(fgv.select("f", "g", F.col("var").alias("v2")), "f").join(egv.select("e", "g", F.col("var").alias("v3")), ["e", "g"]))
    for i, signs in enumerate(((1.0, 1.0, -1.0), (1.0, -1.0, 1.0), (-1.0, 1.0, 1.0))):
        for v, c in zip(("v1", "v2", "v3"), signs):
            rules.append(tri.select(F.concat_ws(":", F.lit(f"tri{i}"), "v1", "v2").alias("rule"), F.col(v).alias("var"), F.lit(c).alias("coef"), F.lit(-1.0).alias("offset"), F.lit(0.3).alias("weight")))
    table = rules[0]
    for r in rules[1:]:
        table = table.unionByName(r)
    ends = fev.select("var", F.concat(F.lit("f"), "f").alias("a"), F.concat(F.lit("e"), "e").alias("b")).unionByName(fgv.select("var", F.concat(F.lit("f"), "f").alias("a"), F.concat(F.lit("g"), "g").alias("b")))
    ends = ends.unionByName(egv.select("var", F.concat(F.lit("e"), "e").alias("a"), F.concat(F.lit("g"), "g").alias("b")))
    release(tri)
    value = cut(solve_by_component(table, ends))
    release(value)
    out = fev.join(value, "var").select(F.col("f").alias("rank"), F.lit("eto").alias("source"), F.col("e").alias("entity_id"), F.col("value").alias("confidence"))
    out = out.unionByName(fgv.join(value, "var").select(F.col("f").alias("rank"), F.lit("fundamentals").alias("source"), F.col("g").alias("entity_id"), F.col("value").alias("confidence")))
    return out.withColumn("rank", F.col("rank").cast("int"))
