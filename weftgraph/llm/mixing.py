"""Mixing sources to target weights, by DataFrame functions alone.

Every document gets a hash-random key; documents are sorted by it in ranges within each source, and
distributed prefix sums of their words tell where each one stands in its source's shuffled order.
A source's budget is a point of that order: what stands before it is taken, and where the budget
exceeds the source, whole epochs are taken first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import partitions, salted_join, shared_dir, small, written

#: Sources in the order of their names weigh so, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and of a source at most as a multiple of its words.
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range, sources that are broadcast at most, and equal rows that one task writes at most.
RANGE, SOURCES, COPIES = 20_000, 100_000, 10_000


def words(text: Column) -> Column:
    """How many runs of other characters than white space a text has; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], path: str) -> DataFrame:
    """df with the sums of values over the rows that stand before each one in its group (by), rows being in an order.

    Rows are range-sorted by group and order into written ranges, so that a group of any size has
    many tasks; a range's sum is carried to the later ranges of its group, of which there are as many as ranges.
    Rows that the order leaves equal must be interchangeable.
    """
    spark = df.sparkSession
    n = max(partitions(spark), -(-df.count() // RANGE))
    keys = [F.col(c).asc_nulls_last() for c in by]
    valued = df.withColumns({f"_{name}": value for name, value in sums.items()})
    ranged = written(valued.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), path)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    starts = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_s_{name}") for name in sums])
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_l_{name}": F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in sums})
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return local.join(starts, same).select(*df.columns, *[(F.col(f"_s_{name}") + F.col(f"_l_{name}")).alias(name) for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, path: str | None = None) -> DataFrame:
    """source, source_size, target of sources (source, source_size): `share` of all words by weight, none over `most` times its words.

    Weights go round over the sources in the order of their code points, null last.  The level is
    the greatest, over the sources in the order of cap / weight, of what the caps before a source
    leave for the weights from it on: sources whose cap lies below their weight's share of the level get their cap.
    """
    path = path or shared_dir(sizes.sparkSession)
    ranked = prefix_sums(sizes, [], [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, f"{path}/places")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(ranked.withColumns({"weight": weight, "cap": F.col("source_size") * most}), f"{path}/ranked")
    whole = rows.agg(F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).first()
    summed = prefix_sums(rows, [], [F.col("cap") / F.col("weight"), F.col("place")], {"caps": F.col("cap"), "weights": F.col("weight")}, f"{path}/levels")
    left = (F.lit(share * float(whole["size"] or 0)) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("weights"))
    level = summed.agg(F.max(left)).first()[0]  # one number
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size, copies, key of the documents; equal rows, which are interchangeable, are one with their number of copies."""
    rows = docs.select("source", "doc_id", words(F.col("text")).alias("size"))
    counted = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    return counted.withColumn("key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))


def with_targets(rows: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """rows with facts of their source, null ones too: broadcast where sources are few, else a salted join."""
    named = lambda df: df.withColumn("_source", F.struct("source"))  # noqa: E731  a struct is never null
    facts = named(facts).select("_source", *columns)
    if facts.limit(SOURCES + 1).count() <= SOURCES:
        return named(rows).join(F.broadcast(facts), "_source").drop("_source")
    return salted_join(named(rows), facts, "_source").drop("_source")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the documents (doc_id, text, source): how many of each one's words the mix takes, repeats counted.

    A source's words are taken in the order of the documents' keys to the whole word nearest to its target, so that a
    document at the budget's end is cut; whole epochs come first where the target exceeds the source,
    and no document is taken more than `most` times.  share must be at most `most`.  Keys depend on doc_id and size alone, so reruns agree;
    equal rows (source, doc_id, size) are interchangeable and all returned.  Null texts are empty,
    null sources are a source, null ids a document each.  A source without words has target 0; an empty table gives none.  Other columns are not read.
    """
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    home = shared_dir(docs.sparkSession)
    rows = written(sized(docs), f"{home}/sized")
    facts = written(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most, home), f"{home}/targets")
    placed = prefix_sums(rows, ["source"], [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")], {"before": F.col("size") * F.col("copies")}, f"{home}/placed")
    few = placed.where(F.col("copies") <= COPIES).withColumns({"first": F.lit(0).cast("long"), "last": F.col("copies") - 1})
    steps = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    many = placed.where(F.col("copies") > COPIES).withColumn("first", F.explode(steps))
    many = many.withColumn("last", F.least(F.col("first") + COPIES, F.col("copies")) - 1).repartition("doc_id", "size", "first")
    each = few.unionByName(many).withColumn("copy", F.explode(F.sequence("first", "last"))).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.least(F.greatest(budget - F.col("epochs") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    out = with_targets(each, facts, ["source_size", "target"]).withColumn("epochs", epochs)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: source, doc_id, text, epoch (from 0) of everything that mixed takes, settings being mixed's.

    A document that the budget cuts ends after its last word taken.  Rows of one source, doc_id and size are
    interchangeable to mixed and are taken in the order of their texts.
    """
    key = ["source", "doc_id", "size"]
    plan = mixed(docs, **settings).groupBy(*key, "taken").agg(F.count("*").alias("n"))
    # whole and cut ones: a few values of taken for a key
    plan = plan.groupBy(F.struct(*key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("_takes"))
    rows = docs.select("source", "doc_id", "text", words(F.col("text")).alias("size"))
    rows = prefix_sums(rows, key, [F.xxhash64("text"), F.col("text")], {"_i": F.lit(1)}, f"{shared_dir(docs.sparkSession)}/numbered").withColumn("_key", F.struct(*key))
    counted = F.aggregate("_takes", F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("taken")), lambda s, t: F.struct((s["to"] + t["n"]).alias("to"), F.when((F.col("_i") >= s["to"]) & (F.col("_i") < s["to"] + t["n"]), t["taken"]).otherwise(s["taken"]).alias("taken")))
    taken = salted_join(rows, plan, "_key").withColumn("taken", counted["taken"]).where("taken > 0")
    each = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    left = F.col("taken") - F.col("epoch") * F.col("size")
    return each.select("source", "doc_id", F.when(left >= F.col("size"), F.col("text")).otherwise(first_words("text", left)).alias("text"), "epoch")


def first_words(text: str, n: Column) -> Column:
    """A text's first n words, joined by one space."""
    return F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(n, F.lit(0)).cast("int")), " ")


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their sources weighing 3, 1, 2, to 150 % of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT source, doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), l AS (
  SELECT *, sum(weight) OVER () AS all_weight, sum(source_size) OVER () AS all_size,
         coalesce(sum(2 * source_size) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights FROM s
  WINDOW w AS (ORDER BY 2 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
         max((CAST(1.5 AS DOUBLE) * CAST(all_size AS DOUBLE) - CAST(caps AS DOUBLE)) / CAST(all_weight - weights AS DOUBLE)) OVER () * weight) AS target FROM l
), k AS (
  SELECT source, doc_id, size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size), 1, 15) AS BIGINT) AS key FROM d
), p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM e
"""
