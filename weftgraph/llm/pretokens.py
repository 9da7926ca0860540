"""Byte-pair token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np

from weftgraph.llm.shared import FORGET, MULTIPLIER


#: Fixed values of the vocabulary's own splitting rule, for texts of the characters in PLAIN.
LETTERS = "a-zªµºß-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
PLAIN = re.compile(r"[^\t\n\r -~¡-įı-ňŊ-ǃǍ-ǯǴ-ɏ]")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ArrayBpe:
    """The merges of a tokenizers .json file, applied to many pre-tokens at once.

    Splitting follows the file's own rules: plain Latin texts by one pattern, all others by the
    library's normaliser and pre-tokeniser; special strings inside a text are one token each, as
    the library has it.  Merging is done here, on flat arrays with one segment for each pre-token.
    """

    #: Pre-tokens, and characters of them, whose symbols a worker remembers.
    KEPT, KEPT_CHARACTERS = 250_000, 4 << 20

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        data = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.of_char = {c: b for b, c in symbols.items()}
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.tables = self.hashed(keys)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict = {}
        self.remembered = 0

    BITS = 18

    def hashed(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs by hash: in each table at most one (key, rank) a slot; pairs of one slot lie in different tables."""
        slot = self.slots(keys)
        order = np.argsort(slot, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(slot[order]) != 0])
        nth = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
        out = []
        for i in range(int(nth.max()) + 1):
            some = order[nth == i]
            table, ranks = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)
            table[slot[some]], ranks[slot[some]] = keys[some], some
            out.append((table, ranks))
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * MULTIPLIER >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; one past the last for pairs that never merge."""
        slot, out = self.slots(keys), np.full(len(keys), len(self.merged), np.int64)
        for table, ranks in self.tables:
            hit = np.flatnonzero(table[slot] == keys)
            out[hit] = ranks[slot[hit]]
        return out

    def pieces(self, text: str) -> list:
        """The pre-tokens of a text in order; a special string is its token id."""
        if self.split and self.split.search(text):
            return [y for x in self.split.split(text) if x for y in ([self.special[x]] if x in self.special else self.pieces_of(x))]
        return self.pieces_of(text)

    def pieces_of(self, text: str) -> list[str]:
        if not PLAIN.search(text):
            return PIECE.findall(text.lower())
        pre = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.of_char[c] for c in x).decode("utf-8") for x, _ in pre]

    #: Pre-tokens of more bytes merge rank by rank over all of them, so that a round's work is that of its merges.
    LONG = 128

    def symbols(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of each pre-token, flat, and the number of each."""
        raw = [x.encode("utf-8", "surrogatepass") for x in found]
        size = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(size) - 1
        ids[ends[size > 0]] = self.last[flat[ends[size > 0]]]
        owner = np.repeat(np.arange(len(found)), size)
        long = np.repeat(size > self.LONG, size)
        place = np.arange(len(ids))
        done = [merge(ids[some], owner[some], place[some]) for merge, some in ((self.by_sequence, ~long), (self.by_rank, long)) if some.any()]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(found), np.int64)
        ids, owner, place = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(place)], np.bincount(owner, minlength=len(found))

    def by_sequence(self, ids: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of many short sequences.

        Every round finds each sequence's lowest-rank pair and merges all its occurrences; a
        sequence without a mergeable pair has ended.
        """
        done, none = [], len(self.merged)
        while len(ids):
            pair = np.full(len(ids), none, np.int64)
            if len(ids) > 1:
                key = ids[:-1] << 20 | ids[1:]
                pair[:-1] = np.where(owner[:-1] == owner[1:], self.rank_of(key), none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(pair, first)
            count = np.diff(np.r_[first, len(ids)])
            best = np.repeat(best, count)
            alive = best < none
            if not alive.all():
                done.append((ids[~alive], owner[~alive], place[~alive]))
                ids, owner, place, pair, best = ids[alive], owner[alive], place[alive], pair[alive], best[alive]
                if not len(ids):
                    break
            where = np.flatnonzero(pair == best)
            where = self.every_second(where, np.diff(where) == 1)
            ids[where] = self.merged[best[where]]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            ids, owner, place = ids[keep], owner[keep], place[keep]
        return tuple(np.concatenate(x) for x in zip(*done))

    def by_rank(self, ids: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of long sequences, which do not wait for each other's rounds.

        Each round takes the lowest rank that any sequence has left and merges its occurrences in
        all of them; symbols are linked to their neighbours, and only the pairs beside a merge are
        looked up anew.
        """
        n, none = len(ids), len(self.merged)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive, rank = np.ones(n, bool), np.full(n, none, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look_up(at: np.ndarray) -> None:
            to = after[at]
            paired = to < n
            paired[paired] = owner[at[paired]] == owner[to[paired]]
            rank[at[~paired]] = none
            at, to = at[paired], to[paired]
            found = rank[at] = self.rank_of(ids[at] << 20 | ids[to])
            at, found = at[found < none], found[found < none]
            order = np.argsort(found, kind="stable")
            found, at = found[order], at[order]
            cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(at)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    r = int(found[low])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(at[low:high])

        look_up(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            where = np.unique(np.concatenate(waiting.pop(r)))
            where = where[rank[where] == r]
            where = self.every_second(where, after[where[:-1]] == where[1:])
            right = after[where]
            alive[right], rank[right] = False, none
            ids[where] = self.merged[r]
            after[where] = to = after[right]
            before[to[to < n]] = where[to < n]
            left = before[where]
            look_up(np.unique(np.concatenate([left[left >= 0], where])))
        return ids[alive], owner[alive], place[alive]

    @staticmethod
    def every_second(where: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences (a run of one symbol) every second, from the left; overlaps tells of each but the first whether it shares a symbol with the one before."""
        run = np.flatnonzero(np.r_[True, ~overlaps])[: len(where)]
        since = np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))
        return where[since % 2 == 0]

    def forget(self) -> None:
        """Drops what a task has learnt: a worker lives on, also for tasks that need its memory."""
        self.known.clear()
        self.remembered = 0

    def learn(self, lists: list[list], packed: bool) -> dict:
        """What each pre-token of the lists becomes: its ids as bytes (packed) or their number."""
        if len(self.known) > self.KEPT or self.remembered > self.KEPT_CHARACTERS:
            self.known.clear()
            self.remembered = 0
        new = list(set(chain.from_iterable(lists)).difference(self.known))
        plain = [x for x in new if isinstance(x, str)]
        self.remembered += sum(map(len, plain))
        for x in new:
            if not isinstance(x, str):
                self.known[x] = np.array([x], "<u4").tobytes() if packed else 1
        for i in range(0, len(plain), 20_000):
            ids, count = self.symbols(some := plain[i : i + 20_000])
            if packed:
                raw, to = ids.astype("<u4").tobytes(), np.cumsum(count) * 4
                self.known.update((x, raw[b - 4 * c : b]) for x, b, c in zip(some, to.tolist(), count.tolist()))
            else:
                self.known.update(zip(some, count.tolist()))
        return self.known

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each whole text; null: none."""
        lists = [self.pieces(t) if t else [] for t in texts]
        get = self.learn(lists, packed=False).__getitem__
        return [sum(map(get, x)) for x in lists]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The token ids of each whole text as little-endian unsigned 32-bit numbers; null: none."""
        lists = [self.pieces(t) if t else [] for t in texts]
        get = self.learn(lists, packed=True).__getitem__
        return [b"".join(map(get, x)) for x in lists]


_LOADED: dict[str, ArrayBpe] = {}


def forget() -> None:
    """Drops the pre-tokens that models remember, not the models."""
    for model in _LOADED.values():
        model.forget()


FORGET.append(forget)


def loaded(path: str, use: str) -> ArrayBpe:
    """One ArrayBpe for each file and use in a Python worker."""
    if (path, use) not in _LOADED:
        _LOADED[path, use] = ArrayBpe(path)
    return _LOADED[path, use]
