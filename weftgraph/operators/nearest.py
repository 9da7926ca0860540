"""Approximate nearest vectors by random hyperplanes, probed until a measured recall."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.measures import dot, even, most_similar, nearest_in_blocks, spread, unit
from weftgraph.storage import scratch, written

#: Hyperplanes: vectors fall into 2 to this power buckets; terms on which recall is measured.
PLANES, SAMPLE = 8, 64
#: Vectors of a bucket, and terms, that meet in one product at most, about.
BLOCK = 5000


def hashed(embeddings: DataFrame, dims: int, planes: int, seed: int) -> DataFrame:
    """embeddings with margins (the products with each hyperplane's normal) and bucket (their signs as bits)."""
    r = random.Random(seed)
    normals = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(planes)]
    margins = F.array(*[dot(F.col("vec"), F.array(*[F.lit(x) for x in n])) for n in normals])
    bits = [F.when(F.col("margins")[i] > 0, 1 << i).otherwise(0) for i in range(planes)]
    return embeddings.withColumn("margins", margins).withColumn("bucket", sum(bits[1:], bits[0]))


def probes(planes: int) -> Column:
    """All buckets in the order in which a vector's neighbours are likely to lie in them: by the sum of its distances from the planes between."""
    def cost(mask: Column) -> Column:
        crossed = [F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1, F.abs(F.col("margins")[i])).otherwise(0.0) for i in range(planes)]
        return sum(crossed[1:], crossed[0])

    every = F.transform(F.sequence(F.lit(0), F.lit((1 << planes) - 1)), lambda m: F.struct(cost(m).alias("cost"), F.col("bucket").bitwiseXOR(m).alias("bucket")))
    return F.transform(F.array_sort(every), lambda x: x["bucket"])


def most_similar_probed(embeddings: DataFrame, terms: DataFrame, k: int = 10, recall: float = 0.95, planes: int = PLANES, sample: int = SAMPLE, seed: int = 1) -> tuple[DataFrame, float, float]:
    """most_similar's rows for the terms, about `recall` of them; the recall measured, and the share of the buckets that are probed.

    Every vector has one bucket.  On `sample` of the terms, at most, the exact neighbours are looked up; as many
    buckets, nearest first, are probed as hold `recall` of those.  Candidates are verified by exact cosines.  Vectors without a length,
    and those of other lengths than most, are left out.  Hot buckets are split.
    """
    home = scratch(embeddings.sparkSession)
    sizes = embeddings.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return most_similar(embeddings, terms, k), 1.0, 1.0
    full = embeddings.where((F.size("vec") == sizes["n"]) & (dot(F.col("vec"), F.col("vec")) > 0))
    stored = written(hashed(full, sizes["n"], planes, seed), f"{home}/hashed")
    asked = written(stored.join(terms.select("term").distinct(), "term").withColumn("order", probes(planes)).select("term", "vec", unit(F.col("vec")).alias("_q"), "order"), f"{home}/asked")
    some = written(asked.select("term").orderBy(F.xxhash64("term"), "term").limit(sample), f"{home}/sample")
    true = most_similar(stored.select("term", "vec"), some, k).select("term", "partner")
    places = true.join(stored.select(F.col("term").alias("partner"), "bucket"), "partner").join(asked.select("term", "order"), "term")
    found = places.select(F.array_position("order", F.col("bucket")).alias("place")).groupBy("place").count().orderBy("place").collect()  # one row a bucket at most
    need, reached, use, total = recall * sum(r["count"] for r in found), 0, 1 << planes, max(1, sum(r["count"] for r in found))
    for r in found:
        reached += r["count"]
        if reached >= need:
            use = int(r["place"])
            break
    sizes = stored.groupBy("bucket").agg(F.count("*").alias("_n")).select("bucket", F.ceil(F.col("_n") / BLOCK).alias("_parts"))  # one row a bucket
    tried = asked.select("term", "_q", F.explode(F.slice("order", 1, use)).alias("bucket")).join(sizes.hint("broadcast"), "bucket")
    tried = tried.select("term", "bucket", "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    known = stored.join(sizes.hint("broadcast"), "bucket").select(F.col("term").alias("partner"), "bucket", unit(F.col("vec")).alias("_v"), F.pmod(F.xxhash64("term"), F.col("_parts")).alias("_part"))
    if even(full):
        groups, all_groups = spread(asked.count(), "_group", BLOCK)
        tried = tried.withColumn("_group", F.pmod(F.xxhash64("term"), F.lit(groups)))
        near = nearest_in_blocks(tried, known.select("*", all_groups), ["bucket", "_part", "_group"], k)
        return near.select("term", "partner", "similarity", "rank"), reached / total, use / (1 << planes)
    near = tried.join(known, ["bucket", "_part"]).where("term != partner")
    rows = near.select("term", "partner", F.round(dot(F.col("_q"), F.col("_v")), 6).alias("similarity"))
    w = Window.partitionBy("term").orderBy(F.desc("similarity"), "partner")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), reached / total, use / (1 << planes)
