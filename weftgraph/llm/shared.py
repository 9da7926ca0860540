"""What the operators share: word and shingle hashing, exact Arrow batches, facts of salted groups."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators.joins import connected as components
from weftgraph.operators.joins import salt_of, salted_join

__all__ = ["components", "salt_of", "salted_join"]  # of the graph library, for the operators here

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see."""
    return storage.scratch(spark, "weft")


def written(df: DataFrame, path: str, rows: int = 1000) -> DataFrame:
    """df as a Parquet table at path: cuts lineage and survives lost executors.

    While it is written, Arrow batches hold so many rows at most: what lies between Spark and its workers.
    """
    spark = df.sparkSession
    own = int(spark.conf.get(BATCH))  # 0 or less: no bound
    with batches_of(spark, min(rows, own) if own > 0 else rows):
        return storage.written(df, path, "zstd")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows while tables are written inside; the session's setting returns."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes (a row at least), so that long texts do not add up in a worker."""
    for b in batches:
        rest = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while rest:
            s = rest.pop()
            if s.num_rows > 1 and s.nbytes > size:
                half = s.num_rows // 2
                rest += [s.slice(half), s.slice(0, half)]
            else:
                yield s


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, rows: int = 500) -> DataFrame:
    """df through a function of small Arrow slices, of so many rows at most, to dicts of columns, Arrow or lists in schema's order.

    Values never pass through pandas: nullable 64-bit ids stay exact.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(sliced(batches, rows)):
            yield pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(freeing(run), schema)


def freeing(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back to the system when it ends: workers stay for later tasks, beside other workers."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            released()

    return run


def freed(function: Callable, least: Callable = lambda group: 1) -> Callable:
    """A group's function that gives memory back to the system when it ends, if least(group) is not 0."""

    def run(group):
        try:
            return function(group)
        finally:
            if least(group):
                released()

    return run


#: What tasks remember for their own time alone: called when one ends.
FORGET: list[Callable[[], None]] = []


def released() -> None:
    """Drops what is quickly made anew and gives freed memory back to the system."""
    _POWERS.clear()
    _TABLES.pop("hash", None)
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def _as(column, kind: pa.DataType) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.Array):
        return column if column.type == kind else column.cast(kind)
    return pa.array(column, kind)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    """A string column as Python texts, nulls as None."""
    return batch.column(name).to_pylist()


def longs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of nullable 64-bit numbers, exactly: values (0 where null) and whether each is there."""
    column = column.cast(pa.int64())
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_facts(df: DataFrame, key: str, aggregates: dict[str, tuple]) -> DataFrame:
    """Facts of each key's whole group, one row for each (key, salt) that occurs in df.

    df has columns key and salt; aggregates maps a result name to (function, column), the
    function being one that can be applied to its own results (min, max, sum).  Joining the
    result to df on (key, salt) gives every row its group's facts while no task gets more than
    1/SALTS of a group.  Null keys form no group.
    """
    own = df.where(F.col(key).isNotNull()).groupBy(key, "salt").agg(*[f(c).alias(n) for n, (f, c) in aggregates.items()])
    whole = own.groupBy(key).agg(*[f(n).alias(n) for n, (f, _) in aggregates.items()], F.collect_list("salt").alias("salts"))
    return whole.select(key, F.explode("salts").alias("salt"), *aggregates)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has at most so many rows, by a count; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
#: Characters that are hashed at once: the bound of the arrays that a text needs beside its words.
CHARACTERS = 1 << 19
NOT_A_WORD = re.compile(r"\W")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


_POWERS: list[np.ndarray] = []
_TABLES: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 to n and of 0 to -n, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS.clear()
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20) + 1, x, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def table(name: str) -> np.ndarray:
    """A fact of every code point: hash (64 bits), word (letter, digit or underscore), space or upper (case)."""
    if name not in _TABLES:
        every = map(chr, range(0x110000))
        if name == "hash":
            _TABLES[name] = mixed(np.arange(1, 0x110001, dtype=np.uint64) * MULTIPLIER)
        else:
            test = {"word": lambda c: c == "_" or c.isalnum(), "space": str.isspace, "upper": str.isupper}[name]
            _TABLES[name] = np.fromiter(map(test, every), bool, 0x110000)
    return _TABLES[name]


class Words:
    """The words of some lower-case texts: where each starts and ends among their characters, its text and its hash."""

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = table("word")[self.codes]
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[::2], edges[1::2]
        self.up, down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(table("hash")[self.codes] * down[:n], out=self.sums[1:])
        self.first = np.cumsum([0] + [len(t) + 1 for t in texts])  # of each text's characters
        self.text = np.searchsorted(self.first, self.start, side="right") - 1
        self.cuts = np.searchsorted(self.start, self.first[1:-1])
        self.hash = self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each run of characters."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def pieces(text: str, size: int = CHARACTERS) -> Iterator[str]:
    """A text in parts of about size characters, cut where no word is."""
    at = 0
    while len(text) - at > size:
        found = NOT_A_WORD.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hash of each word (run of letters, digits and underscores, in lower case) of whole texts, in order; null: none."""
    out, some, size = [np.empty(0, np.uint64)] * len(texts), [], 0

    def flush() -> None:
        if some:
            for (i, _), h in zip(some, np.split((w := Words([t for _, t in some])).hash, w.cuts)):
                out[i] = h
            some.clear()

    for i, text in enumerate(texts):
        if text:
            text = text.lower()
            if len(text) > CHARACTERS:
                out[i] = np.concatenate([Words([p]).hash for p in pieces(text)])
                continue
            if size + len(text) > CHARACTERS:
                flush()
                size = 0
            some.append((i, text))
            size += len(text)
    flush()
    return out


def shingle_hashes(hashes: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of each run of n words; a text of fewer words, but one at least, is one shingle."""
    n = min(n, len(hashes))
    if n == 0:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out *= MULTIPLIER
            out += hashes[i : len(hashes) - n + 1 + i]
    return mixed(out)
