"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Items are compared with windows of their own number of words.  A window with too few shingles of
the items of its length cannot be similar to one, so only the other windows are fingerprinted.  Fingerprints are
of the shingles that similarity counts: at a similarity, the share of differing bits does not depend
on where or how often a word was changed.  The fingerprints within RADIUS of an item's are found
through BLOCKS blocks of their bits: one block at least differs in no more than RADIUS // BLOCKS
bits, some of which are turned in the index and the others in the search.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import SHINGLE_WORDS, SIMILARITY, mapped, mixed, shingle_hashes, texts_of, word_hashes

BITS, BLOCKS = 64, 4
#: At similarity 0.8 two weighted shingle sets have cosine 0.89, 9.7 of 64 bits differ and more than 23 in 6 of a million pairs.
RADIUS = 23
#: Items, and bytes of their texts, that one pass over the documents compares: the bound of what a task holds of the benchmark.
ITEMS_A_PASS, BYTES_A_PASS = 10_000, 16 << 20
#: Numbers in the arrays that windows are verified in.
CELLS = 1 << 20


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(np.ascontiguousarray(mixed(hashes)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """A 64-bit number of each row of signed totals: bits of positive ones are set."""
    return np.packbits(totals > 0, axis=1).view(np.uint64).reshape(-1)


def simhash(hashes: np.ndarray) -> int:
    """The SimHash of a bag of hashes: each counts as often as it stands."""
    return int(fingerprints(signs(hashes).sum(axis=0, keepdims=True))[0])


def turned(width: int, most: int) -> np.ndarray:
    """Every number of at most `most` set bits among width."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.uint64)


class Items:
    """Benchmark items with an index of their fingerprints' blocks, for the lengths that occur."""

    def __init__(self, texts: list[str | None], words: int) -> None:
        hashes = word_hashes(texts)
        self.words = words
        self.places = np.array([i for i, h in enumerate(hashes) if len(h)], np.int64)  # in texts
        kept = [hashes[i] for i in self.places]
        self.length = np.array([len(h) for h in kept], np.int64)
        own = [shingle_hashes(h, words) for h in kept]
        self.shingles = [np.unique(s, return_counts=True) for s in own]
        self.print = np.array([simhash(s) for s in own], np.uint64)
        self.any = np.unique(np.concatenate(own)) if kept else np.empty(0, np.uint64)
        self.small = np.zeros(1 << 20, bool)
        self.small[(self.any >> np.uint64(44)).astype(np.int64)] = True
        self.lengths, of = np.unique(self.length, return_inverse=True)
        self.items = [np.flatnonzero(of == i) for i in range(len(self.lengths))]
        # the lengths of the items that hold each shingle
        pair = np.unique(np.concatenate([np.searchsorted(self.any, s) * len(self.lengths) + i for s, i in zip(own, of.tolist())])) if kept else np.empty(0, np.int64)
        self.held = pair % max(1, len(self.lengths))
        self.held_at = np.searchsorted(pair, np.arange(len(self.any) + 1) * len(self.lengths))
        width, most = BITS // BLOCKS, RADIUS // BLOCKS
        self.search, index = turned(width, most - most // 2), turned(width, most // 2)
        keys = [self.keys(self.print, of, b)[:, None] ^ index.astype(np.int64)[None, :] for b in range(BLOCKS)]
        keys = np.concatenate([k.reshape(-1) for k in keys])
        order = np.argsort(keys, kind="stable")
        self.index = keys[order]
        self.indexed = (order // len(index) % max(1, len(self.print))).astype(np.int32)

    def keys(self, prints: np.ndarray, of: np.ndarray | int, block: int) -> np.ndarray:
        """A block of fingerprints, with its number and the place of the length."""
        width = BITS // BLOCKS
        return ((prints >> np.uint64(block * width)) & np.uint64((1 << width) - 1)).astype(np.int64) | (np.int64(block) * len(self.lengths) + of) << width

    def within_radius(self, prints: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
        """All (place in prints, item of a length, given by its place) whose fingerprints differ in RADIUS bits or fewer."""
        found, n, turns = [np.empty(0, np.int64)], len(self.search), self.search.astype(np.int64)
        for b in range(BLOCKS):
            key = (self.keys(prints, of, b)[:, None] ^ turns[None, :]).reshape(-1)
            low, high = np.searchsorted(self.index, key, "left"), np.searchsorted(self.index, key, "right")
            some = np.flatnonzero(high > low)
            many = (high - low)[some]
            item = self.indexed[np.repeat(low[some] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())].astype(np.int64)
            place = np.repeat(some // n, many)
            good = np.bitwise_count(prints[place] ^ self.print[item]) <= RADIUS
            found.append(place[good] * len(self.print) + item[good])
        both = np.unique(np.concatenate(found))
        return both // len(self.print), both % len(self.print)

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the shingles that any item holds, and which of any they are."""
        at = np.flatnonzero(self.small[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.any):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.any, shingles[at]), len(self.any) - 1)
        good = self.any[which] == shingles[at]
        return at[good], which[good]

    def matches(self, hashes: np.ndarray, shingles: np.ndarray, hits: np.ndarray, which: np.ndarray, similarity: float) -> list[tuple[int, float, int, int]]:
        """(place of item, similarity, first word, number of words) of each item's best window in a text, the first of equal ones.

        hits, which: the places of the text's shingles that any item holds, and which they are.
        """
        best: dict[int, tuple] = {}
        many = self.held_at[which + 1] - self.held_at[which]
        at = np.repeat(hits, many)
        of = self.held[np.repeat(self.held_at[which] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        for i in np.unique(of).tolist():
            length, own = int(self.lengths[i]), at[of == i]
            n = min(length, len(hashes))  # a text shorter than an item is one window
            # a window of k shingles and an item of m, l of them shared, have similarity l / (k + m - l)
            m, k = length - self.words + 1, n - self.words + 1
            need = max(1, math.ceil((m + k) * similarity / (1 + similarity) - 1e-9))
            if length < self.words or k < need or len(own) < need:
                continue
            before = np.zeros(len(shingles) + 1, np.int32)
            before[1:] = np.cumsum(np.bincount(own, minlength=len(shingles)))
            first = max(0, int(own[0]) - k)
            count = before[first + k :] - before[first : len(before) - k]
            self.search_in(best, shingles, first + np.flatnonzero(count >= need), k, n, i, similarity)
        return list(best.values())

    def tiny(self, hashes: np.ndarray, similarity: float) -> list[tuple[int, float, int, int]]:
        """matches of the items of fewer words than a shingle: their equals."""
        best: dict[int, tuple] = {}
        for i in np.flatnonzero(self.lengths < self.words).tolist():
            length = int(self.lengths[i])
            if len(hashes) >= length:
                own = shingle_hashes(hashes, length)
                self.score(best, own, self.hits(own)[0], 1, length, self.items[i].tolist(), similarity)
        return list(best.values())

    def search_in(self, best: dict, shingles: np.ndarray, starts: np.ndarray, k: int, n: int, of: int, similarity: float) -> None:
        """The windows of n words and k shingles at starts that resemble items of a length."""
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > k) + 1) if len(starts) else []:
            for part in np.array_split(run, -(-len(run) // 512)):
                base = int(part[0])
                some = shingles[base : int(part[-1]) + k]
                totals = np.zeros((len(some) + 1, BITS), np.int32)
                np.cumsum(signs(some), axis=0, out=totals[1:])
                place, item = self.within_radius(fingerprints(totals[part - base + k] - totals[part - base]), of)
                for i in np.unique(item).tolist():
                    self.score(best, shingles, part[place[item == i]], k, n, [i], similarity)

    def score(self, best: dict, shingles: np.ndarray, starts: np.ndarray, k: int, n: int, items: list[int], similarity: float) -> None:
        """Weighted Jaccard similarity, a shingle's weight being how often it stands, of the windows of k shingles at starts and the items."""
        for i in items:
            own, times = self.shingles[i]
            for part in np.array_split(starts, max(1, -(-len(starts) * max(k, len(own)) // CELLS))):
                if not len(part):
                    continue
                rows = shingles[part[:, None] + np.arange(k)]
                at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                cell = (np.arange(len(part))[:, None] * len(own) + at)[own[at] == rows]
                least = np.minimum(np.bincount(cell, minlength=len(part) * len(own)).reshape(len(part), -1), times).sum(axis=1)
                score = least / (k + int(times.sum()) - least)
                j = int(np.argmax(score))
                start, top = int(part[j]), float(score[j])
                if top >= similarity and (i not in best or (-top, start) < (-best[i][1], best[i][2])):
                    best[i] = (int(self.places[i]), top, start, n)


_ITEMS: dict[str, Items] = {}


def items_of(key: str, texts: list, words: int) -> Items:
    """One index for a pass in each Python worker."""
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(texts, words)
    return _ITEMS[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of each item's best window in each row of docs.

    Windows have the item's number of words and any first word; a text shorter than an item is one
    window.  Benchmark items reach the tasks in parts of items_a_pass and BYTES_A_PASS, one pass over
    docs each, so what a task holds does not grow with them.  Null and empty texts and items without
    words match nothing; items of fewer words than a shingle are one shingle and match their equals.
    Equal benchmark rows are one item, so that they count once and no part is larger than the others.
    Null ids pass through; repeated rows match each by itself; of equally similar windows the first
    counts; texts of any length are read whole; empty tables give none; further columns are not read.
    """
    numbered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    count, size = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // items_a_pass), -(-size // BYTES_A_PASS))
    found = None
    for k in range(parts):
        part = numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else numbered
        one = _one_pass(docs, part, words, similarity)
        found = one if found is None else found.unionByName(one)
    return found


def _one_pass(docs: DataFrame, benchmark: DataFrame, words: int, similarity: float) -> DataFrame:
    rows = benchmark.orderBy("item_id", "text").collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))  # bounded by items_a_pass and BYTES_A_PASS
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, texts = shared.value
        items = items_of(key, texts, words)
        tiny = bool(len(items.lengths)) and int(items.lengths[0]) < words
        for b in batches:
            hashes = word_hashes(texts_of(b))
            lists = [shingle_hashes(h, words) if len(h) >= words else h[:0] for h in hashes]
            at, which = items.hits(np.concatenate(lists)) if lists else (np.empty(0, np.int64),) * 2
            out, low, begin = [], 0, 0
            for i, (h, s) in enumerate(zip(hashes, lists)):
                high = int(np.searchsorted(at, begin + len(s)))
                if high > low:
                    out += [(i, *m) for m in items.matches(h, s, at[low:high] - begin, which[low:high], similarity)]
                if tiny:
                    out += [(i, *m) for m in items.tiny(h, similarity)]
                low, begin = high, begin + len(s)
            place, item, score, first, n = zip(*out) if out else ((), (), (), (), ())
            yield {"doc_id": b.column("doc_id").take(pa.array(place, pa.int64())), "item_id": [ids[i] for i in item], "similarity": list(score), "first_word": list(first), "n_words": list(n)}

    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def op6_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
bs AS (SELECT item_id, g, count(*) AS m FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM b WHERE len(w) >= 5) GROUP BY ALL),
ds AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
h AS (SELECT DISTINCT doc_id, item_id, pos FROM ds JOIN bs USING (g)),
starts AS (SELECT DISTINCT h.doc_id, h.item_id, len(b.w) AS n, unnest(range(greatest(h.pos - len(b.w) + 5, 0), least(h.pos, len(d.w) - len(b.w)) + 1)) AS first FROM h JOIN b USING (item_id) JOIN d USING (doc_id)),
ws AS (SELECT s.doc_id, s.item_id, s.first, s.n, ds.g, count(*) AS k FROM starts s JOIN ds ON ds.doc_id = s.doc_id AND ds.pos BETWEEN s.first AND s.first + s.n - 5 GROUP BY ALL),
score AS (SELECT ws.doc_id, ws.item_id, ws.first, ws.n, sum(least(ws.k, coalesce(bs.m, 0))) AS low FROM ws LEFT JOIN bs ON bs.item_id = ws.item_id AND bs.g = ws.g GROUP BY ALL),
best AS (SELECT *, low / (2 * (n - 4) - low) AS similarity FROM score)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(first AS BIGINT) AS first_word, CAST(n AS BIGINT) AS n_words FROM best WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first) = 1
"""
