"""Exact top-k by inner product with norm-bucketed pruning.

Vectors are grouped by length (norm) into buckets of a fixed ratio, a bucket into blocks of bounded
size.  Each query's k-th best score in one seed block bounds what it still needs; for a bucket this
bound, divided by the query's and the bucket's largest norm, is a local cosine threshold.  Over 1,
the bucket is left out; if high, candidates are pruned by their coordinates, else by their own
length; the rest are verified by exact products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import mapped, shared_dir, small, written

RATIO = 1.05
#: Rows, of a few numbers each, that are broadcast at most; and rows that hold a block of vectors.
FACTS, SEEDS = 200_000, 32
BLOCK = 2048
QUERIES_A_BLOCK = 1024
#: The local cosine threshold from which coordinates prune better than lengths, and how many are tried.
COORDINATE_FROM, COORDINATES = 0.5, 3
#: Sums of products below this are exact in 64-bit floats.
EXACT = 2.0**53
#: The largest component: what scaling takes beyond it counts as it.
LARGEST = 1e308


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows, also where squares overflow."""
    most = np.abs(v).max(axis=1, initial=0)
    unit = v / np.where(most > 0, most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt((unit * unit).sum(axis=1)), LARGEST)


def by_length(lists: pa.ListArray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The wanted lists of numbers as matrices, one for each length but 0, with their places; nulls inside are no numbers."""
    starts = lists.offsets.to_numpy().astype(np.int64)
    lengths, values = np.diff(starts), lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[wanted]).tolist():
        some = np.flatnonzero(wanted & (lengths == n))
        if n:
            yield some, values[starts[some][:, None] + np.arange(n)]


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """row (a number of its own, once written), vec_id, label, anchor, dims, norm, bucket, vec (64-bit floats of whole numbers) of the rows that take part.

    vectors may have label (rows of null labels take no part) and anchor.
    """
    given = {"label": "long", "anchor": "boolean"}
    own = [F.col(c).cast(t).alias(c) if c in vectors.columns else F.lit(0).cast(t).alias(c) for c, t in given.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            there = np.logical_and.reduce([b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "embedding")])
            for some, w in by_length(b.column("embedding"), there):
                with np.errstate(over="ignore", invalid="ignore"):
                    fit = np.isfinite(w).all(axis=1)
                    w = np.clip(np.floor(scale * w[fit]), -LARGEST, LARGEST)
                rows, norm = pa.array(some[fit]), norms(w)
                bucket = np.where(norm < 1, -1, (np.log(np.maximum(norm, 1)) / math.log(RATIO)).astype(np.int64))
                yield {c: b.column(c).take(rows) for c in ("row", "vec_id", "label", "anchor")} | {"dims": [w.shape[1]] * len(w), "norm": pa.array(norm), "bucket": pa.array(bucket), "vec": [v.tobytes() for v in w]}

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), *own, "embedding")
    return mapped(numbered, run, "row long, vec_id long, label long, anchor boolean, dims int, norm double, bucket int, vec binary")


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of about size vectors of one dims and bucket: dims, bucket, shard, parts, most (norm), ids, rows, vecs.

    The numbers of parts have a row for each dims and bucket, norms of finite vectors fall into
    fewer than 15,000 buckets: they are broadcast where their number is as small as that.
    """
    counts = rows.groupBy("dims", "bucket").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("parts"))
    numbered = rows.join(small(counts, FACTS), ["dims", "bucket"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def gather(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["norm", "vec_id", "row"], ascending=[False, True, True])
        first = x.iloc[0]
        return pd.DataFrame([(first["dims"], first["bucket"], first["shard"], first["parts"], first["norm"], *(x[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row")), b"".join(x["vec"]))], columns=["dims", "bucket", "shard", "parts", "most", "ids", "rows", "vecs"])

    return numbered.groupBy("dims", "bucket", "shard").applyInPandas(gather, "dims int, bucket int, shard int, parts int, most double, ids binary, rows binary, vecs binary")


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows, as whole numbers cut to 64 bits."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q @ p.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in q], object).dot(np.array([[int(c) for c in r] for r in p], object).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def block_top(q_rows: np.ndarray, q: np.ndarray, need: np.ndarray, ids: np.ndarray, rows: np.ndarray, p: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query's place, vector, its row, score) of each query's k best in a block of vectors by descending norm; need: scores below are not wanted."""
    out = []
    p_norm, q_norm = norms(p), norms(q)
    most = p_norm.max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        cosine = np.where(q_norm * most > 0, need / (q_norm * most), np.where(need > 0, 2.0, -1.0))
    slack = 1e-9
    wanted = np.flatnonzero(cosine <= 1 + slack)  # length pruning of the whole block
    by_coordinate = wanted[cosine[wanted] >= COORDINATE_FROM]
    by_length = wanted[cosine[wanted] < COORDINATE_FROM]
    unit = p / np.where(p_norm > 0, p_norm, 1)[:, None]
    for i in by_coordinate.tolist():
        t, u = min(1.0, cosine[i]), q[i] / q_norm[i]
        keep = np.ones(len(p), bool)
        for c in np.argsort(-np.abs(u))[:COORDINATES]:
            room = math.sqrt(max(0.0, 1 - u[c] ** 2) * (1 - t * t))
            # a unit vector whose cosine to u is t or more has its coordinate in this range
            low = u[c] * t - room if u[c] > -t else -1.0
            high = u[c] * t + room if u[c] < t else 1.0
            keep &= (unit[:, c] >= low - slack) & (unit[:, c] <= high + slack)
        some = np.flatnonzero(keep & (rows != q_rows[i]))
        if len(some):
            scores = products(q[i : i + 1], p[some])[0]
            out += [(i, int(ids[some[j]]), int(rows[some[j]]), int(scores[j])) for j in best(scores, ids[some], k)]
    for start in range(0, len(by_length), 128):
        part = by_length[start : start + 128]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(need[part] > 0, need[part] / np.maximum(q_norm[part], 1e-300), 0).min(initial=np.inf)
        n = int(np.searchsorted(-p_norm, -least * (1 - slack), side="right"))  # vectors too short for every query of the part
        scores = products(q[part], p[:n])
        for r, i in enumerate(part.tolist()):
            some = np.flatnonzero(rows[:n] != q_rows[i])
            out += [(i, int(ids[some[j]]), int(rows[some[j]]), int(scores[r, some[j]])) for j in best(scores[r, some], ids[some], k)]
    return out


def unpacked(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vecs, np.float64).reshape(len(i), -1)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), exactly.

    Queries are the rows of vectors (vec_id, embedding) for which is_query holds; candidates are all
    other rows of as many components.  Rows count one by one: a repeated row, or another vector of the
    same vec_id, is a candidate of its own, and a repeated query is asked again.  Ties go to the smaller vec_id.  Null vectors,
    empty ones, null ids, and vectors with null or non-finite components take no part; what scaling
    takes beyond 1e308 counts as that, and scores are cut to 64 bits.  Fewer than k candidates: all.  An empty table gives none.  Other columns are not read.
    """
    spark, home = vectors.sparkSession, shared_dir(vectors.sparkSession)
    every = whole_vectors(vectors.select("vec_id", "embedding", is_query.alias("anchor")), scale)
    rows = written(every.drop("label"), f"{home}/vectors")
    candidates = written(blocked(rows, BLOCK), f"{home}/blocks")
    queries = blocked(rows.where("anchor"), QUERIES_A_BLOCK).select("dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vecs").alias("q_vecs"))
    seeds = candidates.groupBy("dims").agg(F.max_by(F.struct("rows", "vecs"), F.struct(F.least(F.octet_length("ids"), F.lit(8 * BLOCK // 4)), F.col("most"))).alias("seed"))

    def bounds(x: pd.DataFrame) -> pd.DataFrame:
        need, least = [], []
        for q_rows, q_vecs, seed in zip(x["q_rows"], x["q_vecs"], x["seed"]):
            (i, q), (rows, p) = unpacked(q_rows, q_vecs), unpacked(seed["rows"], seed["vecs"])
            scores = np.where(rows[None, :] == i[:, None], -(2**63), products(q, p))
            n = scores.shape[1]
            own = (np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(i), -(2**62))).astype(np.float64)
            norm = norms(q)
            # a vector shorter than this has no product that any query of the block needs
            least.append(float(np.where(norm > 0, own / np.maximum(norm, 1e-300), -np.inf).min()))
            need.append(own.tobytes())
        return x.drop(columns="seed").assign(need=need, least=least)

    bounded = queries.join(small(seeds, SEEDS), "dims").mapInPandas(lambda it: map(bounds, it), "dims int, q_ids binary, q_rows binary, q_vecs binary, need binary, least double")
    bounded = written(bounded, f"{home}/queries")
    buckets = candidates.groupBy("dims", "bucket").agg(F.first("parts").alias("parts"), F.max("most").alias("most"))
    # buckets too short for a block of queries are left out before anything is copied
    pairs = bounded.join(small(buckets, FACTS), "dims").where(F.col("most") * (1 + 1e-9) >= F.col("least"))
    pairs = pairs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "most", "least")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                (i, q), (ids, p) = unpacked(r.q_rows, r.q_vecs), unpacked(r.ids, r.vecs)
                found = pd.DataFrame(block_top(i, q, np.frombuffer(r.need, np.float64), ids, np.frombuffer(r.rows, np.int64), p, k), columns=["q", "vec_id", "row", "score"])
                at = found.pop("q").to_numpy(np.int64)
                yield found.assign(q_row=i[at], query_id=np.frombuffer(r.q_ids, np.int64)[at])

    found = pairs.join(candidates.drop("parts", "most"), ["dims", "bucket", "shard"]).select("q_ids", "q_rows", "q_vecs", "need", "ids", "rows", "vecs").mapInPandas(search, "vec_id long, row long, score long, q_row long, query_id long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.n AS q_row, p.n AS n, q.vec_id AS query_id, p.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * p.w[i])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.n <> p.n AND len(q.w) = len(p.w) AND q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id, n) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
