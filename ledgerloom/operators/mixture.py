"""Filling missing values from similar records (problem 2).

Expectation-maximisation for mixtures of Gaussian and categorical variables with missing entries. A component has a
mean vector and covariance for the numeric variables and a probability table for each category. The E-step runs
over the rows in Spark, where every partition reduces its rows to sufficient statistics (sums of responsibilities,
of expected values, of expected products, of category weights); their size depends on the number of components and
variables only, and the M-step works on their sum. Missing numbers become conditional expectations, missing
categories conditional modes; masks mark what was filled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


REST = "\x00rest"


@dataclass
class Mixture:
    """weight[k]; mean[k, p]; cov[k, p, p]; table[variable][k, level]."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    table: list[np.ndarray]


def _expect(m: Mixture, x: np.ndarray, cats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Responsibilities r[n, k], expected numbers e[n, k, p], summed conditional covariances c[k, p, p], log-likelihood.
    Rows are handled by their pattern of missing numbers, of which few occur."""
    n, k, p = len(x), len(m.weight), x.shape[1]
    logp = np.tile(np.log(m.weight + 1e-300), (n, 1))
    for j, t in enumerate(m.table):
        seen = cats[:, j] >= 0
        logp[seen] += np.log(t[:, cats[seen, j]].T + 1e-300)
    e = np.empty((n, k, p))
    cond = np.zeros((n, k, p, p)) if p else np.zeros((n, k, 0, 0))
    miss = np.isnan(x)
    code = miss @ (1 << np.arange(p)) if p else np.zeros(n, int)
    for c in np.unique(code):
        rows = np.flatnonzero(code == c)
        o = np.flatnonzero(~((c >> np.arange(p)) & 1).astype(bool))
        u = np.setdiff1d(np.arange(p), o)
        for q in range(k):
            mu, s = m.mean[q], m.cov[q]
            e[rows, q] = mu
            if len(o):
                d = x[np.ix_(rows, o)] - mu[o]
                inv = np.linalg.inv(s[np.ix_(o, o)])
                logp[rows, q] += -0.5 * np.einsum("ni,ij,nj->n", d, inv, d) - 0.5 * np.linalg.slogdet(2 * np.pi * s[np.ix_(o, o)])[1]
                e[np.ix_(rows, [q], o)] = x[np.ix_(rows, o)][:, None]
                if len(u):
                    e[np.ix_(rows, [q], u)] = (mu[u] + d @ inv @ s[np.ix_(o, u)])[:, None]
            if len(u):
                v = s[np.ix_(u, u)] - (s[np.ix_(u, o)] @ np.linalg.inv(s[np.ix_(o, o)]) @ s[np.ix_(o, u)] if len(o) else 0)
                cond[np.ix_(rows, [q], u, u)] = v
    top = logp.max(1, keepdims=True)
    r = np.exp(logp - top)
    like = float((top[:, 0] + np.log(r.sum(1))).sum())
    r /= r.sum(1, keepdims=True)
    return r, e, np.einsum("nk,nkij->kij", r, cond), like


def _columns(b: pa.RecordBatch, num: Sequence[str], cat: Sequence[str], levels: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in num], 1) if num else np.zeros((len(b), 0))
    cats = np.full((len(b), len(cat)), -1)
    for j, c in enumerate(cat):
        at = {v: i for i, v in enumerate(levels[j])}
        rest = at.get(REST, -1)  # what the rare levels share
        cats[:, j] = [-1 if v is None else at.get(v, rest) for v in b.column(c).to_pylist()]
    return x, cats


def fit_mixture(df: DataFrame, num: Sequence[str], cat: Sequence[str], components: int = 4, rounds: int = 15, tol: float = 1e-4, seed: int = 7, max_levels: int = 200) -> tuple[Mixture, list[list[str]]]:
    """Fit on all rows of ``df``. Numbers are null or NaN where missing, categories null. A category has a
    table entry for each of its ``max_levels`` most frequent levels (a documented bound on the model, not on the rows);
    all rarer ones share one more entry with its own statistics, so no row's value is taken as missing."""
    p = len(num)
    clean = [F.when(~F.isnan(c), F.col(c)) for c in num]
    stat = df.agg(F.count("*").alias("n"), *(f(x).alias(f"{a}{i}") for i, x in enumerate(clean) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not stat["n"]:
        raise ValueError("no rows to fit a mixture on")
    mean = np.array([stat[f"m{i}"] or 0.0 for i in range(p)])
    sd = np.array([stat[f"s{i}"] or 1e-3 for i in range(p)]) + 1e-6
    levels, first = [], []
    for c in cat:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(max_levels).collect()
        every = df.where(F.col(c).isNotNull()).count() if len(top) == max_levels else 0
        tail = every - sum(r["count"] for r in top)
        levels.append([r[0] for r in top] + ([REST] if tail > 0 else []))
        first.append(np.array([r["count"] for r in top] + ([tail] if tail > 0 else []), float))
    rng = np.random.default_rng(seed)
    spread = np.linspace(-1.5, 1.5, components) if components > 1 else np.zeros(1)
    m = Mixture(
        np.full(components, 1 / components), mean + spread[:, None] * sd, np.tile(np.diag(sd**2), (components, 1, 1)),
        [(f / f.sum() if len(f) else f) * rng.uniform(0.8, 1.2, (components, len(f))) for f in first],
    )
    for t in m.table:
        t /= t.sum(1, keepdims=True) if t.shape[1] else 1
    data = df.select(*(F.col(c).cast("double").alias(c) for c in num), *(F.col(c).cast("string").alias(c) for c in cat)).persist()
    sizes = [components, components * p, components * p * p, *(components * len(x) for x in levels), 1]
    last = -np.inf
    for _ in range(rounds):

        def reduce(it: Iterator[pa.RecordBatch], m: Mixture = m) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(sizes))
            for b in it:
                if not len(b):
                    continue
                x, cats = _columns(b, num, cat, levels)
                r, e, c, like = _expect(m, x, cats)
                parts = [r.sum(0), np.einsum("nk,nkp->kp", r, e), np.einsum("nk,nki,nkj->kij", r, e, e) + c]
                for j, lv in enumerate(levels):
                    seen = cats[:, j] >= 0
                    t = np.zeros((len(lv), components))
                    np.add.at(t, cats[seen, j], r[seen])
                    parts.append(t.T)
                total += np.concatenate([*(q.ravel() for q in parts), [like]])
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

        got = data.mapInArrow(reduce, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        flat = np.split(np.array([g["v"] for g in got]), np.cumsum(sizes)[:-1])
        w = flat[0] + 1e-9
        mean = flat[1].reshape(components, p) / w[:, None]
        cov = flat[2].reshape(components, p, p) / w[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + np.diag(1e-4 * sd**2 + 1e-9)
        tables = [(t := f.reshape(components, -1) + 0.5) / t.sum(1, keepdims=True) if f.size else f.reshape(components, 0) for f in flat[3:-1]]
        m = Mixture(w / w.sum(), mean, cov, tables)
        like = float(flat[-1][0])
        if np.isfinite(last) and abs(like - last) < tol * abs(last):
            break
        last = like
    data.unpersist()
    return m, levels


def fill_mixture(df: DataFrame, m: Mixture, levels: list[list[str]], num: Sequence[str], cat: Sequence[str], key: str, fill_num: Sequence[str], fill_cat: Sequence[str]) -> DataFrame:
    """``(key, <x>_filled ...)``: conditional expectation of every number of ``fill_num`` that is missing, conditional
    mode of every category of ``fill_cat`` that is missing, null where the value is there."""
    kind = df.schema[key].dataType.simpleString()
    names = [*(f"{c}_filled" for c in fill_num), *(f"{c}_filled" for c in fill_cat)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not len(b):
                continue
            x, cats = _columns(b, num, cat, levels)
            r, e, _, _ = _expect(m, x, cats)
            exp = np.einsum("nk,nkp->np", r, e)
            cols = [b.column(key)]
            for c in fill_num:
                j = list(num).index(c)
                cols.append(pa.array(exp[:, j], mask=~np.isnan(x[:, j])))
            for c in fill_cat:
                j = list(cat).index(c)
                known = m.table[j] * np.array([v != REST for v in levels[j]])  # a gap is filled with a level that has a name
                best = (r @ known).argmax(1) if len(levels[j]) else np.zeros(len(b), int)
                cols.append(pa.array([levels[j][i] if miss and levels[j] else None for i, miss in zip(best, cats[:, j] < 0)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [key, *names])

    schema = ", ".join([f"{key} {kind}", *(f"{c}_filled double" for c in fill_num), *(f"{c}_filled string" for c in fill_cat)])
    return df.select(key, *(F.col(c).cast("double").alias(c) for c in num), *(F.col(c).cast("string").alias(c) for c in cat)).mapInArrow(run, schema)
