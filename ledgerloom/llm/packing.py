"""Filling fixed-capacity containers with items (problem 8).

Minimum bin slack on the multiset of lengths. There are at most ``capacity`` different lengths, so the histogram of
a corpus of any size is small, and packing is planned on it: the largest remaining length opens a container, a
bitset subset-sum DP over the remaining lengths finds the multiset that comes closest to the rest of the capacity,
backtracking gives its counts, and the pattern is used as often as the counts allow. Items then find their container
by their rank among the items of their length; ranks come from per-partition counts, so no length, however
frequent, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, at most ``counts`` of each) whose sum comes closest to ``room``
    without passing it. Bit t of ``reach`` is set if the sum t can be made."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        left, part = min(counts[x], room // x), 1
        while left:  # bounded counts by binary parts
            k = min(part, left)
            steps.append((x, k, reach))
            reach |= (reach << (x * k)) & mask
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> total & 1:
            out[x] = out.get(x, 0) + k
            total -= x * k
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (how many containers, {length: items of it in each})."""
    left = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        pattern = best_fill(sorted((x for x, n in rest.items() if n > 0), reverse=True), rest, capacity - top)
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[x] // k for x, k in pattern.items())
        out.append((times, pattern))
        for x, k in pattern.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return out


def pack(df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """``(key, piece, piece_tokens, start_token, container_id)``: every item, in pieces only if larger than ``capacity``.

    Items are the distinct (key, size) pairs; a null, zero or negative size needs no room and goes to container 0.
    The histogram that reaches the driver has at most ``capacity`` rows.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    items = df.select(F.col(key), n.alias("_n")).distinct()
    pieces = (
        items.select(key, "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"))
        .select(key, "piece", F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("piece_tokens"))
        .withColumn("_part", F.spark_partition_id())
    )
    pieces = cut(pieces)  # the partition ids below must not change
    per_part = cut(pieces.groupBy("_part", "piece_tokens").agg(F.count("*").alias("n")))
    histogram = {r["piece_tokens"]: r["n"] for r in per_part.groupBy("piece_tokens").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    first, base = {x: ([], [], []) for x in histogram}, 0  # by length: rank from, container from, items per container
    used = dict.fromkeys(histogram, 0)
    for times, pattern in plan(histogram, capacity):
        for x, k in pattern.items():
            for c, v in zip(first[x], (used[x], base, k)):
                c.append(v)
            used[x] += times * k
        base += times
    places = {x: tuple(np.array(c, np.int64) for c in v) for x, v in first.items()}

    before = F.coalesce(F.sum("n").over(W.partitionBy("piece_tokens").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_part.select("_part", "piece_tokens", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy("_part", "piece_tokens").orderBy(key, "piece")) - 1
    ranked = pieces.withColumn("_rank", rank).join(offsets, ["_part", "piece_tokens"]).select(key, "piece", "piece_tokens", (F.col("_rank") + F.col("_before")).alias("_rank"))
    kind = df.schema[key].dataType.simpleString()

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size, rank = b.column("piece_tokens").to_numpy(), b.column("_rank").to_numpy()
            out = np.zeros(len(size), np.int64)
            for x in np.unique(size):
                if x:
                    start, base, k = places[int(x)]
                    at = np.flatnonzero(size == x)
                    p = np.searchsorted(start, rank[at], "right") - 1
                    out[at] = base[p] + (rank[at] - start[p]) // k[p]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], [key, "piece", "piece_tokens", "container_id"])

    placed = ranked.mapInArrow(place, f"{key} {kind}, piece int, piece_tokens int, container_id long")
    return placed.withColumn("start_token", F.col("piece").cast("long") * capacity)


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """How full the containers are: their number, tokens, share of unused space, least number they could be."""
    per = packed.groupBy("container_id").agg(F.sum("piece_tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"), F.round(1 - F.sum("t") / (F.count("*") * capacity), 6).alias("unused_share"), F.ceil(F.sum("t") / capacity).alias("least_containers"))
