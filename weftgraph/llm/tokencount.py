"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.pretokens import loaded
from weftgraph.llm.shared import mapped, texts_of

LIMIT = 2048


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text), without a shuffle.

    Null and empty texts have no bytes and no tokens.  Every row is counted by itself: ties,
    repeated rows and null ids pass through; an empty table gives an empty one; further columns
    of docs are not read.  A long text is held whole, shorter ones 500 at a time.
    """
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = loaded(path, "counts")
        for b in batches:
            texts = [t or "" for t in texts_of(b)]
            n = model.counts(texts)
            yield {"doc_id": b.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}
        model.forget()

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
