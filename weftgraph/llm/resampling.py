"""Quality filtering by importance resampling with hashed n-gram models and Gumbel top-k.

A document's log weight is the log ratio of two generative models of hashed n-grams: of the target
(documents labelled good) and of the raw corpus (all documents).  N-grams are words, word pairs,
marks, word starts that stand in a document more than once (so that what is spread over many rare
words adds up), and how much of it is capitals, marks or repeated words; the models count documents.

The raw corpus holds the target, so that no weight can be over 1 / (the target's share): what speaks
for a document is one bounded piece of evidence, however long the document, and enters as the mean
of its n-grams' log ratios over one.  What speaks against it adds up.  Ratios count by the least that
chance leaves of them.  Log weights and Gumbel noise are the keys whose largest k are the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import CHARACTERS, MULTIPLIER, Words, longs_of, mapped, mixed, pieces, shared_dir, table, texts_of, written

BITS = 20
BUCKETS = 1 << BITS
#: The bound of the labelled sample that reaches the driver and the tasks.
LABELS = 200_000
#: Standard deviations from the expected count within which a ratio is one, for any number of documents.
CHANCE = 3.0
#: Chance leaves ratios nearer to one than they are: weights are understated, and are squared to make up for it.
TEMPERATURE = 0.5
SEED = 11
#: Balanced accuracy that the cut gives up, at most, for documents labelled good.
SLACK = 0.002
#: Letters of the word starts that are n-grams, and how often one stands in a text to be one.
STARTS, TIMES = (4, 5, 6, 7), (2, 3)
SHARES = ("marks", "capitals", "repeats", "distinct")
#: Bits that number the documents of a slice.
SLICE = 9
LOW = np.uint64((1 << SLICE) - 1)


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true places begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def numbered(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes with their document in the lowest bits, sorted: equal ones of a document are neighbours."""
    return np.sort((hashes & ~LOW) | doc.astype(np.uint64))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each n-gram of up to 512 whole texts, some more than once; null and empty: none."""
    n, group, size = len(texts), [], 0
    docs, hashes, starts, marks, mark_docs, capitals = [], [], {k: [] for k in STARTS}, [], [], np.zeros(n, np.int64)

    def add() -> None:
        nonlocal size
        if not group:
            return
        w = Words([t.lower() for _, t in group])
        own = np.array([i for i, _ in group], np.int64)
        docs.append(own[w.text])
        hashes.append(w.hash)
        for k in STARTS:
            long = np.flatnonzero(w.end - w.start >= k)
            starts[k].append((w.hash_of(w.start[long], w.start[long] + k) & ~LOW) | docs[-1][long].astype(np.uint64))
        first, last = runs_of(~table("word")[w.codes] & ~table("space")[w.codes])
        marks.append(w.hash_of(np.maximum(first, last - 3), last))
        mark_docs.append(own[np.searchsorted(w.first, first, side="right") - 1])
        raw = [t for _, t in group]
        first, last = runs_of(table("upper")[np.frombuffer("\n".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)])
        at = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in raw]), first[last - first > 1], side="right") - 1
        capitals[:] += np.bincount(own[at], minlength=n)
        group.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in pieces(text) if text else ():
            if size + len(part) > CHARACTERS:
                add()
            group.append((i, part))
            size += len(part)
    add()
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    mark, mark_doc = np.concatenate(marks), np.concatenate(mark_docs)
    out_doc, out = [doc, mark_doc], [h, mixed(mark)]
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        out_doc.append(doc[1:][same])
        out.append(mixed(h[1:] * MULTIPLIER + h[:-1])[same])
        for k in STARTS:
            key = np.sort(np.concatenate(starts[k]))
            for t in TIMES:
                found = key[t - 1 :][key[t - 1 :] == key[: max(0, len(key) - t + 1)]]
                out_doc.append((found & LOW).astype(np.int64))
                out.append(mixed((found >> np.uint64(SLICE)) * MULTIPLIER + np.uint64(10 * k + t)))
    key = numbered(h, doc)
    each = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    counts = {
        "marks": np.bincount(mark_doc, minlength=n), "capitals": capitals,
        "repeats": np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n), "distinct": np.bincount((each & LOW).astype(np.int64), minlength=n),
    }
    total = np.bincount(doc, minlength=n) + counts["marks"]
    some = np.flatnonzero(total)
    for j, name in enumerate(SHARES):
        out_doc.append(some)
        out.append(mixed(np.round(6 * np.sqrt(counts[name][some] / (total[some] + 20))).astype(np.uint64) + np.uint64(1000 * (j + 1))))
    return np.concatenate(out_doc), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def labelled(labels: DataFrame, bound: int = LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and whether good (quality 1 and toxic 0 in all labels of the id) of at most bound labelled documents.

    The sample is by the ids' hashes; rows with nulls are left out.
    """
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).toPandas().sort_values("doc_id")
    return rows["doc_id"].to_numpy(np.int64), rows["good"].to_numpy(bool)


def counted(docs: DataFrame, ids: np.ndarray, good: np.ndarray) -> DataFrame:
    """bucket, raw, target: documents with an n-gram of the bucket, of all and of the good ones; bucket -1 counts documents.

    Each task adds up its documents before anything is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids[good])  # at most LABELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        raw, aim, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64), shared.value
        for b in batches:
            id_, there = longs_of(b.column("doc_id"))
            is_good = np.isin(id_, target) & there
            doc, bucket = ngrams(texts_of(b))
            order = np.argsort(doc.astype(np.uint16), kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(1, b.num_rows))
            for at, g in zip(np.split(bucket[order], cuts), is_good.tolist()):
                raw[at] += 1  # repeated places count once
                if g:
                    aim[at] += 1
            raw[BUCKETS] += b.num_rows
            aim[BUCKETS] += int(is_good.sum())
        some = np.flatnonzero(raw)
        yield {"bucket": np.where(some == BUCKETS, -1, some), "raw": raw[some], "target": aim[some]}

    rows = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, chance: float = CHANCE) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their log p_target / p_raw, where it differs from 0 by more than chance.

    A ratio is the nearest to one from which the target's count is within chance, whatever the
    corpus's size.  At most BUCKETS rows reach the driver.
    """
    total = counts.where("bucket < 0").first()
    if total is None or not total["target"]:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    expected = F.col("raw") * F.lit(total["target"] / total["raw"])
    middle, spread = F.col("target") + chance**2 / 2, chance * F.sqrt(F.col("target") + chance**2 / 4)
    ratio = F.when(expected > middle + spread, F.log((middle + spread) / expected)).when(expected < middle - spread, F.log((middle - spread) / expected))
    rows = counts.where("bucket >= 0").select("bucket", ratio.alias("ratio")).where("ratio != 0").toPandas()
    return rows["bucket"].to_numpy(np.int64), rows["ratio"].to_numpy(np.float32)


def log_weights(texts: list[str | None], ratios: np.ndarray) -> np.ndarray:
    """The log weight of each of up to 512 texts, from the ratio of each bucket: the mean of those over 0 and the sum, each bucket once, of those below."""
    doc, bucket = ngrams(texts)
    value = ratios[bucket]
    up = np.bincount(doc, np.maximum(value, 0), minlength=len(texts)) / np.maximum(1, np.bincount(doc, minlength=len(texts)))
    each = np.unique(doc[value < 0] << BITS | bucket[value < 0])
    return up + np.bincount(each >> BITS, ratios[each & (BUCKETS - 1)].astype(np.float64), minlength=len(texts))


def scored(docs: DataFrame, ratios: tuple[np.ndarray, np.ndarray], columns: list[str]) -> DataFrame:
    """columns of docs, log_weight and key of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # at most BUCKETS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        every = np.zeros(BUCKETS, np.float32)
        at, v = shared.value
        every[at] = v
        for b in batches:
            yield {c: b.column(c) for c in columns} | {"log_weight": log_weights(texts_of(b), every)}

    read = list(dict.fromkeys([*columns, "text"]))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return mapped(docs.select(*read), run, f"{fields}, log_weight double").withColumn("key", key_of(F.col("log_weight")))


def key_of(log_weight, temperature: float = TEMPERATURE, seed: int = SEED):
    """The Gumbel key of a document: its log weight and noise that only its doc_id and the seed decide."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return log_weight / temperature - F.log(-F.log(uniform))


def cut_of(weights: np.ndarray, good: np.ndarray, slack: float = SLACK) -> float:
    """The log weight from which labelled documents count as good: the lowest cut whose balanced accuracy is within slack of the best."""
    if not len(good) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    below_good, below_bad = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    gain = np.where(np.r_[w[1:] != w[:-1], False], (below_bad - below_good) / 2, -np.inf)
    if gain.max(initial=-np.inf) <= 0:
        return -np.inf
    i = int(np.flatnonzero(gain >= max(gain.max() - slack, 1e-12))[0])
    return float((w[i] + w[i + 1]) / 2)


def kth_key(keys: DataFrame, k: int, bins: int = 4096, few: int = 5000) -> float:
    """The k-th largest of keys' column key, exactly, by narrowing histograms: at most bins or few rows reach the driver at once."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return -np.inf
    above = 0  # keys over high
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            return float(low)
        rows = inside.groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]
        if n <= few:
            some = sorted((r["key"] for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
            return some[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, bound: int = LABELS, k: int | None = None) -> DataFrame:
    """The sampled rows of docs (doc_id, text and others): columns (default: all), log_weight and key.

    k is the sample's size; by default, as many as have at least the log weight that parts good from
    other labelled documents (cut_of).  Keys equal to the k-th are all kept.  Null and empty texts
    have log weight 0; rows of null doc_id share one noise value; repeated rows get equal keys; rows
    of one doc_id with different texts are weighted each by its text, and a label parts by the least.
    Texts of any length are read whole.  Without labels, or of one kind only, every row is kept.  An
    empty table gives none.  docs' own columns log_weight and key are left out.
    """
    home = shared_dir(docs.sparkSession)
    columns = [c for c in (columns or docs.columns) if c not in ("log_weight", "key")]
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    ids, good = labelled(labels, bound)
    ratios = log_ratios(written(counted(docs, ids, good), f"{home}/counts"))
    rows = written(scored(docs, ratios, list(dict.fromkeys([*columns, "doc_id"]))), f"{home}/scored")
    keys = rows.select("doc_id", "log_weight", "key")
    if k is None:
        marks = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": ids, "good": good}), "doc_id long, good boolean")
        weights = keys.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("log_weight")).toPandas()  # at most LABELS rows
        cut = cut_of(weights["log_weight"].to_numpy(float), weights["good"].to_numpy(bool))
        k = keys.where(F.col("log_weight") >= float(cut)).count()
    least = kth_key(keys, k) if k else np.inf
    return rows.where(F.col("key") >= float(least)).select(*columns, "log_weight", "key")


def op9_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps, with their log weights and keys."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
