"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as
Parquet in the cluster's shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.decontaminate import contaminated
from weftgraph.llm.jaccard import join_near
from weftgraph.llm.packing import pack
from weftgraph.llm.repeats import remove_repeats
from weftgraph.llm.resampling import resample
from weftgraph.llm.shared import shared_dir, small, written
from weftgraph.storage import cleared, made

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that are broadcast at most; more of them meet the documents by a shuffle.
IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the models count every document given."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each near-duplicate class.

    Texts without words and rows of null doc_id stay; of equal rows one stays; a doc_id of several
    texts stays if one of them is its class's.
    """
    rows = join_near(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("stays"), (F.count("*") > 1).alias("again"))
    marked = written(rows.where("not stays or again"), shared_dir(spark))
    once = docs.join(small(marked.select("doc_id"), IDS), "doc_id", "left_anti").select(COLUMNS)
    again = docs.join(small(marked.where("stays").select("doc_id"), IDS), "doc_id", "left_semi").select(COLUMNS)
    return once.unionByName(again.dropDuplicates())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; all documents stay.

    Where a cut falls inside a character, what is left of the character goes too.
    """
    out = remove_repeats(docs.select(COLUMNS), characters=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(small(written(found, shared_dir(spark)), IDS), "doc_id", "left_anti").select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed_sequences", packed_sequences),
]

#: Hash models, suffix arrays and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage wrote on its way is deleted when it has ended."""
    home = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = made(spark)
        docs = written(stage(spark, docs, sf_dir), f"{home}/{i}-{name}")
        cleared(spark, before)
    return docs


def queries() -> dict:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the pipeline, if there is any."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
