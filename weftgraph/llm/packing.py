"""Packing of tokenised documents into fixed-length sequences by the linear grouping scheme.

The plan is made from the histogram of lengths alone, which has no more entries than the
sequence has tokens, whatever the number of documents; documents are then dealt to the plan's
places by their rank among those of equal length, in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.pretokens import loaded
from weftgraph.llm.shared import mapped, partitions, shared_dir, texts_of, written
from weftgraph.llm.tokencount import vocabulary

CAPACITY = 4096
END_ID = 1
#: Lengths over this share of a sequence are large; groups of equal cardinality that they form.
LARGE_SHARE = 0.4
GROUPS = 128


@dataclass
class Plan:
    """rows: (length, first rank, how many, first sequence, offset); sequences: how many."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def grouped(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Runs (size, count) of large items, largest first, cut into groups of equal cardinality."""
    total = int(counts.sum())
    each, out, room = -(-total // groups), [[]], -(-total // groups)
    for s, n in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        while n:
            if room == 0:
                out.append([])
                room = each
            k = min(n, room)
            out[-1].append((s, k))
            n, room = n - k, room - k
    # equal rounded sizes make one size
    merged: list[list[tuple[int, int]]] = []
    for g in out:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        elif g:
            merged.append(g)
    return merged


def best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits (unbounded knapsack), as counts by size."""
    most = capacity // min(sizes)
    value = np.zeros((most + 1, capacity + 1))
    choice = np.full((most + 1, capacity + 1), -1)
    for j in range(1, most + 1):
        value[j] = value[j - 1]
        for k, s in enumerate(sizes):
            if worth[k] > 0:
                with_k = value[j - 1][: capacity + 1 - s] + worth[k]
                better = with_k > value[j][s:] + 1e-12
                value[j][s:][better] = with_k[better]
                choice[j][s:][better] = k
    counts, room = [0] * len(sizes), capacity
    for j in range(most, 0, -1):
        if (k := int(choice[j][room])) >= 0:
            counts[k] += 1
            room -= sizes[k]
    return float(value[most][capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used: the configuration program by column generation, rounded down."""
    k = len(sizes)
    basis = [[capacity // s if i == j else 0 for i in range(k)] for j, s in enumerate(sizes)]
    for _ in range(12 * k):
        a = np.array(basis, float).T
        use = np.linalg.solve(a, np.array(demand, float))
        worth = np.linalg.solve(a.T, np.ones(k))
        value, pattern = best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(a, np.array(pattern, float))
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[int(np.argmin(ratio))] = pattern
    use = np.linalg.solve(np.array(basis, float).T, np.array(demand, float))
    return [(p, int(np.floor(max(0.0, x) + 1e-6))) for p, x in zip(basis, use)]


def packed(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> Plan:
    """A plan for histogram (length to number, lengths from 1 to capacity).

    Large lengths are rounded up to their group's largest, the configurations of these few sizes
    are optimised, each group's actual lengths take its places, and what is left over and the
    small lengths go where they fit best, from the longest down.
    """
    plan = Plan()
    rank = dict.fromkeys(histogram, 0)
    rest = {s: n for s, n in histogram.items() if n > 0}
    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, how many)

    def put(size: int, count: int, first: int, offset: int) -> None:
        plan.rows.append((size, rank[size], count, first, offset))
        rank[size] += count
        rest[size] -= count

    large = np.array([s for s in rest if s > capacity * large_share], int)
    if len(large):
        parts = grouped(large, np.array([rest[s] for s in large.tolist()]), groups)
        sizes, queues = [g[0][0] for g in parts], [[list(x) for x in g] for g in parts]
        for pattern, times in configurations(sizes, [sum(n for _, n in g) for g in parts], capacity):
            if times == 0:
                continue
            runs = [(plan.sequences, times, 0)]  # (first sequence, how many, filled)
            plan.sequences += times
            for k, repeat in enumerate(pattern):
                for _ in range(repeat):
                    out = []
                    for first, many, filled in runs:
                        while many and queues[k]:
                            size, left = queues[k][0]
                            n = min(many, left)
                            put(size, n, first, filled)
                            out.append((first, n, filled + size))
                            first, many = first + n, many - n
                            queues[k][0][1] -= n
                            if queues[k][0][1] == 0:
                                queues[k].pop(0)
                        if many:
                            out.append((first, many, filled))
                    runs = out
            for first, many, filled in runs:
                bins[capacity - filled].append((first, many))
    for size in sorted(rest, reverse=True):
        room = size
        while rest[size]:
            while room <= capacity and not bins[room]:
                room += 1
            if room > capacity:
                each = capacity // size
                many = -(-rest[size] // each)
                bins[capacity].append((plan.sequences, many))
                plan.sequences += many
                room = capacity
            first, many = bins[room].pop()
            each = room // size
            full = min(many, rest[size] // each)
            if full:
                for j in range(each):
                    put(size, full, first, capacity - room + j * size)
                bins[room - each * size].append((first, full))
                first, many = first + full, many - full
            if many and (last := min(rest[size], each - 1)):
                for j in range(last):
                    put(size, 1, first, capacity - room + j * size)
                bins[room - last * size].append((first, 1))
                first, many = first + 1, many - 1
            if many:
                bins[room].append((first, many))
    return plan


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's tokens and the end id, cut at capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model, end = loaded(path, "ids"), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in enumerate(model.ids(texts_of(b))):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    some = ids[i : i + 4 * capacity]
                    rows.append((doc, i // 4 // capacity, i // 4, len(some) // 4, zlib.crc32(some)))
            doc, *rest = zip(*rows)
            yield {"doc_id": b.column("doc_id").take(pa.array(doc))} | dict(zip(("piece", "start", "length", "ids_crc32"), map(list, rest)))
        model.forget()

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> DataFrame:
    """The pieces of every document and their places: token_pieces' columns, sequence_id and offset.

    Null and empty texts are one token, the end id.  Ties and repeated rows are pieces of their
    own; rows of null doc_id keep it.  An empty table gives none.  Further columns are not read.
    Only the histogram, at most one row a length, reaches the driver.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    home, parts = shared_dir(spark), partitions(docs.sparkSession)
    pieces = written(token_pieces(docs, path, capacity), f"{home}/pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), f"{home}/counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packed(histogram, capacity, groups, large_share)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(before, ["bucket", "length"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    # the plan: runs of documents of a length, a few for each length and pattern, whatever their number
    shared = spark.sparkContext.broadcast(np.array(sorted(plan.rows) or np.empty((0, 5)), np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = shared.value
        keys = (table[:, 0] << 45) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 45) + rank, side="right") - 1
            yield {c: b.column(c) for c in columns} | {"sequence_id": table[at, 3] + rank - table[at, 1], "offset": table[at, 4]}

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return mapped(ranked.select(*columns, "rank"), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
