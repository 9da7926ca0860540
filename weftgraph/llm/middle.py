"""Fill-in-the-middle transformation by in-place block rotation.

A text's bytes lie in one bytearray.  Cuts are found by one scan for tokens; sentinels are inserted
before the prefix, the middle and the suffix, and the blocks are brought into their order by a
rotation, which is three reversals in place.  To restore, the rotation is inverted and the sentinels are taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import mapped

#: Fixed values of the transformation: the sentinels and the shares of its forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes that one reversal moves at once.
STEP = 1 << 16


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Reverses bytes in place, by pieces from both ends."""
    view = np.frombuffer(buffer, np.uint8)
    while end - start > 1:
        n = min(STEP, (end - start) // 2)
        head = view[start : start + n][::-1].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = head
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges the neighbouring blocks start to cut and cut to end in place: both are reversed, then the whole."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def token_starts(raw: bytes) -> np.ndarray:
    """Where each token of UTF-8 bytes begins: a run of ASCII letters, or one other character."""
    b = np.frombuffer(raw, np.uint8)
    letter = ((b | 32) >= ord("a")) & ((b | 32) <= ord("z"))
    begins = (b & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(raw: bytes | bytearray | memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int(((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).sum())


def cuts(raw: bytes, starts: np.ndarray, h1: int, h2: int) -> tuple[int, int]:
    """Where, in bytes, prefix and middle end."""
    n = len(starts)
    ends = [int(starts[k]) if k < n else len(raw) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return ends[0], ends[1]


def transformed(raw: bytes, first: int, second: int, form: str) -> bytearray:
    """raw as `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm), prefix ending at first and middle at second."""
    buffer = bytearray(raw)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restored(output: bytes | bytearray, form: str) -> bytearray:
    """The text that transformed had, from its output and form alone."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    # a text that holds a sentinel is plain, and none can arise where a piece meets a sentinel
    if form == "psm":
        start, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
        rotate(buffer, start, middle, len(buffer))
    else:
        start, prefix = 0, buffer.index(PREFIX)
        rotate(buffer, start, prefix, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.rindex(sentinel) if sentinel == SUFFIX else buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return buffer


def middles(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output, restored of the documents (doc_id, text).

    Cuts and form come from the SHA-256 of the seed, a colon and doc_id in decimal (nothing for a null id), so reruns agree.
    output and restored are UTF-8 bytes.  Null texts are empty; empty texts, texts with a sentinel and
    a tenth of all others stay plain, their prefix_chars and middle_chars being null.  Repeated rows
    are transformed alike, each for itself; an empty table gives none.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
        for b in batches:
            out = []
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist()):
                raw = raw or b""
                digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()
                h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
                starts = token_starts(raw)
                if not raw or h3 % 100 >= CHANGED or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((i, len(starts), "plain", None, None, raw, raw))
                    continue
                form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                first, second = cuts(raw, starts, h1, h2)
                output = transformed(raw, first, second, form)
                view = memoryview(raw)
                out.append((i, len(starts), form, characters(view[:first]), characters(view[first:second]), bytes(output), bytes(restored(output, form))))
            yield dict(zip(names, map(list, zip(*out)) if out else ([],) * 7))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return mapped(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary", 100)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's transformation, by its digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return middles(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(u[greatest(c1, c2) + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(x) AS restored_sha256 FROM p
"""
