"""Removal of byte strings that an earlier document holds, by suffix arrays and longest-previous-factor arrays.

A corpus-wide suffix array would ship every suffix.  Instead every string of LEAST bytes belongs to
its minimizer, the least hashed k-gram inside it, so that equal strings meet in one bucket:

1. Documents are gathered into blocks of some megabytes (no shuffle).  A block cuts its documents
   into segments, each the union of neighbouring LEAST-byte strings with one minimizer, and sends
   for each distinct segment its hashes and least doc_id to the minimizer's bucket.
2. A bucket says of each segment: alone, held whole by an earlier document, or to be compared,
   where one minimizer stands in different segments.  Few segments are; of equal ones, the
   earliest only is sent.
3. A bucket sorts the suffixes of the segments sent, and finds previous and next suffixes of
   smaller documents; the longer common prefix is the longest previous factor, and a factor of
   LEAST bytes marks a string for removal.

A shortcut: a whole segment is taken to be held by an earlier document if 96 bits of hashes (of the
minimizer and of all its bytes) are equal; its bytes are not sent.  Among 10**13 different segments
two are mistaken for each other with a chance of less than 1 in 1,000.

A minimizer with many different segments in a block is hot: its strings are sent one by one to
buckets by their own hash, so no bucket receives a group that grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import batches_of, freed, freeing, longs_of, mixed, powers, shared_dir, written

LEAST = 50
GRAM = 20
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
#: Segments of one minimizer in a block, and in a bucket, beyond which it is hot.
HOT_BLOCK, HOT_BUCKET = 8, 4096
#: Windows that one suffix array holds.
ARRAY_WINDOWS = 100_000
ALONE, COVERED, COMPARE, SPREAD = 0, 1, 2, 3
TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shrunk(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, their bytes in planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays))


def grown(data: bytes, columns: int, kind: type = np.uint64) -> list[np.ndarray]:
    """What shrunk was given."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // (8 * columns)
    return [np.ascontiguousarray(x.reshape(8, n).T).reshape(-1).view(kind) for x in raw.reshape(columns, 8 * n)] if n else [np.empty(0, kind)] * columns


class Segments:
    """The segments of a block's text: first and last window, minimizer hash h, segment hash, document, distinct segment."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        n = len(text)
        self.text, self.first = text, np.empty(0, np.int64)
        starts = np.r_[0, ends[:-1]]
        up, down = powers(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(TABLE[text] * down[:n], out=sums[1:])
            self.sums = sums
            if n < LEAST:
                grams = np.empty(0, np.uint64)
            else:
                grams = mixed((sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1])
        self.up = up
        width = LEAST - GRAM + 1
        if n >= LEAST:
            mask = np.uint64((1 << max(8, int(n).bit_length())) - 1)
            key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < width:
                key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
            place = (key & mask).astype(np.int64)  # of the minimizer of the window at each place
            edge = np.zeros(n + 1, np.int32)
            whole = (ends - starts >= LEAST) & there
            edge[starts[whole]] += 1
            edge[ends[whole] - LEAST + 1] -= 1
            valid = np.cumsum(edge)[: len(place)] > 0
            new = valid.copy()
            new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
            self.first = np.flatnonzero(new)
            gone = valid.copy()
            gone[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
            self.last = np.flatnonzero(gone)
            del key, edge, valid, new, gone
            with np.errstate(over="ignore"):
                self.h = mixed(grams[place[self.first]]) >> np.uint64(16)
            del grams, place
        else:
            self.last, self.h = np.empty(0, np.int64), np.empty(0, np.uint64)
        self.hash = self.hash_of(self.first, self.last + LEAST)
        self.doc = ids[np.searchsorted(ends, self.first, side="right")] if len(self.first) else np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            pair = mixed(self.h * np.uint64(0x9E3779B97F4A7C15) ^ self.hash)
        _, self.entry_at, self.entry = np.unique(pair, return_index=True, return_inverse=True)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is told of the distinct segments: h, hash (0: the one line of a hot minimizer) and least document; the line of each distinct segment."""
        h, s, d = self.h[self.entry_at], self.hash[self.entry_at], self.doc[self.entry_at]
        if not len(h):
            return h, s, d, np.empty(0, np.int64)
        _, of, n = np.unique(h, return_inverse=True, return_counts=True)
        s = np.where(n[of] > HOT_BLOCK, np.uint64(0), np.maximum(s >> np.uint64(16), np.uint64(1)))
        order = np.lexsort((d, s, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])]
        line = np.empty(len(h), np.int64)
        line[order] = np.cumsum(new) - 1
        return h[order][new], s[order][new], d[order][new], line


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches as dicts, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def block_text(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """The bytes, document ends, document ids, whether there is an id, and other columns of a block."""
    import zstandard

    extra = pa.ipc.open_stream(row["extra"]).read_all()
    ends, ids, there = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["there"], bool)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8), ends, ids, there, extra


BLOCK_SCHEMA = "block long, ids binary, there binary, ends binary, text binary, extra binary"


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs in blocks, a row each: the texts one after another, by doc_id, and the other columns."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 24

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids, there = longs_of(table.column("doc_id").combine_chunks())
            order = np.lexsort((ids, there))
            table = table.take(pa.array(order))
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in table.column("text").to_pylist()]
            extra = table.drop_columns(["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, extra.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(extra)
            row = {"block": [number], "ids": [ids[order].tobytes()], "there": [there[order].tobytes()], "ends": [np.cumsum([len(x) for x in raw], dtype=np.int64).tobytes()], "text": [zstandard.ZstdCompressor(6).compress(b"".join(raw))], "extra": [sink.getvalue().to_pybytes()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("ids", "there", "ends", "text", "extra")]))

        for b in batches:
            for i in range(0, b.num_rows, 50):
                held.append(b.slice(i, 50))
                size += held[-1].nbytes
                if size >= block_bytes:
                    yield block()
                    held.clear()
                    size, number = 0, number + 1
        if held:
            yield block()

    return docs.mapInArrow(freeing(build), BLOCK_SCHEMA)


def messages(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (kind, block, bucket, payload)."""
    kind, block, bucket, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "block", "bucket", "payload"])


MESSAGE_SCHEMA = "kind int, block long, bucket long, payload binary"


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places that go to it, in a fixed order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(bucket) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[order[a]]), order[a:b]


def told_of(h: np.ndarray, s: np.ndarray, d: np.ndarray) -> bytes:
    """A message's lines, h ascending: as steps of h, s, and documents less the least."""
    least = d.min()
    return int(least).to_bytes(8, "little", signed=True) + shrunk(np.diff(h, prepend=np.uint64(0)), s, d.view(np.uint64) - least.view(np.uint64))


def lines_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What told_of was given."""
    step, s, d = grown(data[8:], 3)
    return np.cumsum(step, dtype=np.uint64), s, (d + np.frombuffer(data[:8], np.uint64)).view(np.int64)


def tell_segments(buckets: int):
    """Blocks to messages about their distinct segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            text, ends, ids, there, _ = block_text(row)
            h, s, d, _ = Segments(text, ends, ids, there).sent()
            yield messages([(0, row["block"], k, told_of(h[at], s[at], d[at])) for k, at in by_bucket((h % np.uint64(buckets)).astype(np.int64))])

    return run


def judge_segments(table: pa.Table) -> pa.Table:
    """A bucket's messages to replies: a state for each segment told of, in the order told."""
    told = [lines_of(x) for x in table.column("payload").to_pylist()]
    h, s, d = (np.concatenate(x) for x in zip(*told))
    order = np.lexsort((s, h))
    hs, ss, ds = h[order], s[order], d[order]
    new_h = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    new_pair = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])])
    many_h, many_pair = np.diff(np.r_[new_h, len(hs)]), np.diff(np.r_[new_pair, len(hs)])
    least_pair = np.repeat(np.minimum.reduceat(ds, new_pair), many_pair)
    pairs = np.add.reduceat(np.isin(np.arange(len(hs)), new_pair, assume_unique=True).astype(np.int64), new_h)
    one_doc = np.minimum.reduceat(ds, new_h) == np.maximum.reduceat(ds, new_h)
    hot = (np.minimum.reduceat(ss, new_h) == 0) | (pairs > HOT_BUCKET)
    of_h = np.where(hot, SPREAD, np.where(pairs == 1, ALONE, COMPARE))
    # a hot minimizer's segments may differ though one entry stands for them
    of_h = np.where(one_doc & ~hot, ALONE, of_h)
    state = np.repeat(of_h, many_h)
    state = np.where((least_pair < ds) & (ss != 0), COVERED, state).astype(np.uint8)
    out = np.empty(len(h), np.uint8)
    out[order] = state
    cuts = np.cumsum([len(x[0]) for x in told])[:-1]
    return pa.table({"block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array([x.tobytes() for x in np.split(out, cuts)], pa.binary())})


def send_segments(buckets: int):
    """Blocks with replies to their state so far (kind 1) and to segments to be compared (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for row in rows_of(batches):
            text, ends, ids, there, _ = block_text(row)
            x = Segments(text, ends, ids, there)
            h, _, _, line = x.sent()
            replies = {r["bucket"]: np.frombuffer(r["payload"], np.uint8) for r in row["replies"] or ()}
            state = np.zeros(len(h), np.uint8)
            for k, at in by_bucket((h % np.uint64(buckets)).astype(np.int64)):
                state[at] = replies[k]
            state, d = state[line], x.doc[x.entry_at]
            own = x.doc == d[x.entry]
            gone = (state[x.entry] == COVERED) | ~own
            spread = np.zeros(len(text) + 1, np.int32)
            spread[: len(text)] += np.bincount(x.first[gone], minlength=len(text)).astype(np.int32)
            spread -= np.bincount(x.last[gone] + LEAST, minlength=len(text) + 1).astype(np.int32)
            covered = np.cumsum(spread[:-1]) > 0
            # segments whose windows are judged one by one: an occurrence of each, and all its occurrences in the same document
            open_ = np.flatnonzero(own & ((state[x.entry] == COMPARE) | (state[x.entry] == SPREAD)))
            entry = x.entry[open_]
            sent = x.entry_at[np.unique(entry)]
            hot = state[x.entry[sent]] == SPREAD
            whole, pieces = sent[~hot], sent[hot]
            starts, stops = x.first[whole], x.last[whole]
            many = x.last[pieces] - x.first[pieces] + 1
            each = np.repeat(x.first[pieces] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            start, stop = np.r_[starts, each], np.r_[stops, each] + LEAST
            key = np.r_[x.h[whole], x.hash_of(each, each + LEAST)]
            doc = np.r_[x.doc[whole], np.repeat(x.doc[pieces], many)]
            # equal hot strings of one document are sent once for each place; they are few beside the text
            rows, sent_at, sent_to = [], [], []
            for k, at in by_bucket((key % np.uint64(buckets)).astype(np.int64)):
                content = b"".join(text[a:z].tobytes() for a, z in zip(start[at].tolist(), stop[at].tolist()))
                head = shrunk(key[at], doc[at].view(np.uint64), (stop - start)[at].astype(np.uint64))
                packed = zstandard.ZstdCompressor(1).compress(content)
                rows.append((2, row["block"], k, len(head).to_bytes(8, "little") + head + packed))
                sent_at.append(at)
                sent_to.append((k, len(at)))
            order = np.concatenate(sent_at) if sent_at else np.empty(0, np.int64)
            # every occurrence of a whole segment in its own document takes the segment's verdict
            first = np.searchsorted(x.entry[sent], entry) if len(sent) else entry
            bits = zstandard.ZstdCompressor(1).compress(np.packbits(covered).tobytes())
            occurrence = shrunk(*(np.asarray(v).astype(np.uint64) for v in (x.first[open_], x.first[sent[first]] if len(sent) else entry)))
            places = shrunk(*(np.asarray(v).astype(np.uint64) for v in (start[order], stop[order] - LEAST + 1 - start[order])))
            to = np.array(sent_to, np.int64).reshape(-1, 2)
            parts = [bits, occurrence, places, shrunk((x.last[open_] - x.first[open_] + 1).astype(np.uint64)), shrunk(to[:, 0].astype(np.uint64), to[:, 1].astype(np.uint64))]
            rows.append((1, row["block"], 0, b"".join(len(v).to_bytes(8, "little") + v for v in parts)))
            yield messages(rows)

    return run


def prefix_minima(values: np.ndarray) -> list[np.ndarray]:
    """The least value of each run of 1, 2, 4 ... places, by its first place."""
    out = [values]
    while 2 ** len(out) <= len(values):
        half = 2 ** (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def longest_previous_factors(keys: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix, the longest prefix that it shares with a suffix of a smaller document.

    keys: the suffixes as fixed-width byte strings, padded with zeros that no suffix holds; sizes:
    their lengths.  In suffix order, the nearest suffixes of smaller documents on either side are
    those that share most.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rows = keys[order].view(np.uint8).reshape(n, -1)
    same = rows[1:] == rows[:-1]
    shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    sorted_sizes = sizes[order]
    lcp = np.zeros(n + 1, np.int32)
    lcp[1:n] = np.minimum(shared, np.minimum(sorted_sizes[1:], sorted_sizes[:-1]))
    d = docs[order]
    low, common = prefix_minima(d), prefix_minima(lcp)
    best = np.zeros(n, np.int32)
    far = np.full(n, 1 << 30, np.int32)
    j, least = np.arange(n), far.copy()
    for k in range(len(low) - 1, -1, -1):
        to = j - 2**k
        go = np.flatnonzero(to >= 0)
        go = go[low[k][to[go]] >= d[go]]
        least[go] = np.minimum(least[go], common[k][to[go] + 1])
        j[go] = to[go]
    some = np.flatnonzero(j > 0)
    best[some] = np.minimum(least[some], lcp[j[some]])
    j, least = np.arange(n) + 1, far
    for k in range(len(low) - 1, -1, -1):
        go = np.flatnonzero(j + 2**k <= n)
        go = go[low[k][j[go]] >= d[go]]
        least[go] = np.minimum(least[go], common[k][j[go]])
        j[go] += 2**k
    some = np.flatnonzero(j < n)
    best[some] = np.maximum(best[some], np.minimum(least[some], lcp[j[some]]))
    out = np.empty(n, np.int32)
    out[order] = best
    return out


def compare_segments(table: pa.Table) -> pa.Table:
    """A bucket's segments to replies: for each window of each segment sent, in order, whether an earlier document holds it."""
    import zstandard

    keys, docs, sizes, texts, told = [], [], [], [], []
    for x in table.column("payload").to_pylist():
        n = int.from_bytes(x[:8], "little")
        k, d, s = grown(x[8 : 8 + n], 3)
        keys.append(k)
        docs.append(d.view(np.int64))
        sizes.append(s.astype(np.int64))
        texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(x[8 + n :]), np.uint8))
        told.append(int((s.astype(np.int64) - LEAST + 1).sum()))
    key, doc, size, text = (np.concatenate(x) for x in (keys, docs, sizes, texts))
    start = np.r_[0, np.cumsum(size)[:-1]]
    windows = size - LEAST + 1
    out_at = np.r_[0, np.cumsum(windows)[:-1]]
    verdict = np.zeros(int(windows.sum()), bool)
    # equal strings have equal keys, so parts by key can be judged one after another
    order = np.argsort(key, kind="stable")
    filled = np.cumsum(windows[order])
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    part = np.repeat(((filled - windows[order]) // ARRAY_WINDOWS)[new], np.diff(np.r_[np.flatnonzero(new), len(order)]))
    widest = int(size.max())
    padded = np.r_[text + np.uint8(1), np.zeros(widest, np.uint8)]
    for a in np.unique(part):
        some = order[part == a]
        many = windows[some]
        inside = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
        at, left = np.repeat(start[some], many) + inside, np.repeat(size[some], many) - inside
        rows = np.lib.stride_tricks.sliding_window_view(padded, widest)[at]
        rows[np.arange(widest) >= left[:, None]] = 0
        found = longest_previous_factors(np.ascontiguousarray(rows).view(f"S{widest}").reshape(-1), left, np.repeat(doc[some], many))
        verdict[np.repeat(out_at[some], many) + inside] = found >= LEAST
    cuts = np.cumsum(told)[:-1]
    return pa.table({"block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array([np.packbits(x).tobytes() for x in np.split(verdict, cuts)], pa.binary())})


def whole_characters(raw: bytes) -> str:
    """The whole UTF-8 characters of bytes."""
    return raw.decode("utf-8", "ignore")


def finish(columns: list[str], characters: bool = False):
    """Blocks with state and verdicts to the documents' rows: their columns, spans, n_bytes and kept; characters: kept as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for row in rows_of(batches):
            text, ends, _, _, extra = block_text(row)
            parts, at = [], 0
            while at < len(row["state"]):
                n = int.from_bytes(row["state"][at : at + 8], "little")
                parts.append(row["state"][at + 8 : at + 8 + n])
                at += 8 + n
            covered = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[0]), np.uint8), count=len(text)).astype(bool)
            (where, like), (start, many), (windows,), (to, segments) = (grown(p, k, np.int64) for p, k in zip(parts[1:], (2, 2, 1, 2)))
            if len(start):
                replies = {r["bucket"]: r["payload"] for r in row["replies"]}
                counts = np.add.reduceat(many, np.r_[0, np.cumsum(segments)[:-1]])
                bits = np.concatenate([np.unpackbits(np.frombuffer(replies[k], np.uint8), count=n) for k, n in zip(to.tolist(), counts.tolist())]).astype(bool)
                seen = np.zeros(len(text), bool)  # windows that an earlier document holds
                seen[np.repeat(start - np.r_[0, np.cumsum(many)[:-1]], many)[bits] + np.flatnonzero(bits)] = True
                shift = np.arange(windows.sum()) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
                marks = np.zeros(len(text), bool)
                marks[(np.repeat(where, windows) + shift)[seen[np.repeat(like, windows) + shift]]] = True
                covered |= dilated(marks)
            kept, spans, sizes = [], [], []
            for a, z in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                own = covered[a:z]
                edge = np.diff(np.r_[0, own.astype(np.int8), 0])
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))])
                left = text[a:z][~own].tobytes()
                kept.append(whole_characters(left) if characters else left)
                sizes.append(z - a)
            table = extra.select(columns).append_column("n_bytes", pa.array(sizes, pa.int64()))
            table = table.append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))).append_column("kept", pa.array(kept, pa.string() if characters else pa.binary()))
            yield from table.combine_chunks().to_batches(max_chunksize=500)

    return run


def dilated(starts: np.ndarray) -> np.ndarray:
    """The bytes of the LEAST-byte strings that begin where starts is set."""
    edge = np.zeros(len(starts) + LEAST + 1, np.int32)
    edge[: len(starts)] += starts
    edge[LEAST : LEAST + len(starts)] -= starts
    return np.cumsum(edge)[: len(starts)] > 0


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, characters: bool = False) -> DataFrame:
    """docs (doc_id, text and others) without the bytes of LEAST-byte strings that start in a document of smaller doc_id.

    Returns docs' columns but text, and n_bytes, spans (the maximal removed runs, in bytes) and kept
    (the remaining bytes; characters: the whole characters among them, as text).  Null text is empty.  Rows of null doc_id are kept whole and are no
    earlier document.  Rows of one doc_id (repeated ones too) do not remove from each other.  Texts
    under LEAST bytes stay.  An empty table gives none.  docs' own columns named n_bytes, spans or
    kept are left out.
    """
    spark, home = docs.sparkSession, shared_dir(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_bytes", "spans", "kept")]
    source = docs.select(*others, docs["text"].cast("string").alias("text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = written(blocks(source, block_bytes), f"{home}/blocks")
    total = table.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, math.ceil(3 * total / bucket_bytes))  # text is stored compressed to about a third
    told = table.mapInArrow(freeing(tell_segments(buckets)), MESSAGE_SCHEMA)
    judged = told.groupBy("bucket").applyInArrow(freed(judge_segments), "block long, bucket long, payload binary")
    answer = judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("replies"))
    with batches_of(spark, 1):  # a row is a block or a message
        second = written(table.join(answer, "block", "left").mapInArrow(freeing(send_segments(buckets)), MESSAGE_SCHEMA), f"{home}/second")
    state = second.where("kind = 1").select("block", F.col("payload").alias("state"))
    compared = second.where("kind = 2").groupBy("bucket").applyInArrow(freed(compare_segments), "block long, bucket long, payload binary")
    verdicts = compared.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("replies"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*others).schema)
    both = table.join(state, "block").join(verdicts, "block", "left")
    return both.mapInArrow(freeing(finish(others, characters)), f"{fields}, n_bytes long, spans array<struct<start: long, end: long>>, kept {'string' if characters else 'binary'}")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the hash of what stays."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
