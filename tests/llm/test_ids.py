"""Ids at the ends of 64 bits, beside nulls, through every operator on rows."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, htmltext, jaccard, maxproduct, middle, mixing, packing, repeats, resampling, sharding, tokencount, warc

IDS = [2**60 + 1, 2**60 + 3, 2**62 + 5, 2**62 + 6, -(2**62) - 5, 2**63 - 1, -(2**63), None]


def text_of(i):
    return f"number {i} " + " ".join(f"w{(i or 7) * k % 1_000_003}" for k in range(1, 60))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, text_of(i)) for i in IDS], "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("run", [
    lambda s, d: jaccard.join_near(d),
    lambda s, d: sharding.sharded(d),
    lambda s, d: tokencount.token_counts(d),
    lambda s, d: repeats.remove_repeats(d),
    lambda s, d: resampling.resample(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda s, d: packing.pack(d),
    lambda s, d: mixing.mixed(d.withColumn("source", F.lit("s"))),
    lambda s, d: middle.middles(d),
    lambda s, d: htmltext.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
    lambda s, d: warc.archived(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
    lambda s, d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
], ids=["near", "shards", "tokens", "repeats", "resample", "pack", "mix", "middle", "html", "warc", "leaks"])
def test_ids_are_exact(spark, docs, run):
    assert sorted((r["doc_id"] for r in run(spark, docs).select("doc_id").collect()), key=str) == sorted(IDS, key=str)


def test_leaks_name_exact_items(spark, docs):
    got = decontaminate.contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).collect()
    assert all(r["doc_id"] == r["item_id"] for r in got)


def test_repeats_at_the_ends_of_long(spark):
    """The earlier of two documents keeps a passage, whatever the size of the ids."""
    same = "a passage that is longer than fifty bytes and that stands in two documents"
    for low, high in ((2**62 + 5, 2**62 + 6), (-(2**62) - 6, -(2**62) - 5), (-(2**63), 2**63 - 1), (-1, 0)):
        df = spark.createDataFrame([(high, same), (low, same), (None, same)], "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: len(r["spans"]) for r in repeats.remove_repeats(df).collect()}
        assert got == {low: 0, high: 1, None: 0}


def test_top_products_keep_near_ids_apart(spark):
    rows = [(2**60 + k, [1.0 + k, 2.0]) for k in range(1, 8)] + [(2**60 + 8, [5.0, 5.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = maxproduct.top_products(df, F.col("vec_id") == 2**60 + 8).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2**60 + k for k in (7, 6, 5, 4, 3)]


def test_a_vec_ids_rows_count_one_by_one(spark):
    rows = [(0, [1.0, 1.0])] * 2 + [(1, [9.0, 9.0])] * 2 + [(1, [8.0, 9.0])] + [(k, [float(k), 0.0]) for k in range(2, 7)]
    got = maxproduct.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 1, 1, 1, 1, 1, 6, 6, 5, 5]


def test_settings_of_the_session_stay(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    repeats.remove_repeats(docs).count()
    warc.archived(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).count()
    jaccard.join_near(docs).count()
    assert spark.conf.get(name) == before

