"""Joins and groups whose hot keys are split by a salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from weftgraph.functions.codes import codings
from weftgraph.storage import scratch, written

SALTS = 64
#: Ways over a hub that one task makes distinct, those of one value at which lists are given up, facts of a list, and facts a key below which lists gain nothing.
WAYS, HOT_WAYS, LISTED, FEW = 1_000_000, 20_000_000, 1_000, 4
#: Rows that a task makes distinct.
TASK_ROWS = 500_000
#: Lists of a key from which they are dealt out.
HOT_LISTS = 100
#: Values of a column to a key, on an average, up to which it has one each.
SAME = 1.3
#: Between the facts of a list, between a fact's fields, and before what stands for these and for null.
ROW, FIELD, ESCAPE = "\x1e", "\x1f", "\x1b"


def salt_of(*cols: str) -> Column:
    """A salt from 0 to SALTS - 1 that depends only on the columns' values."""
    return F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(SALTS)).cast("int")


def salted_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to facts, which has one row for each key, although one key may hold a third of rows.

    Each fact goes to the salts at which its key occurs, SALTS at most; rows meet it there.
    """
    salted = rows.withColumn("_salt", salt_of(*rows.columns))
    spread = salted.select(key, "_salt").distinct().join(facts, key)
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def tasks_of(spark: SparkSession, n: int, rows: int = TASK_ROWS) -> int:
    """The tasks for n rows at so many a task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows + 1)


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt out by a column, about so many rows a task: what is made distinct or grouped by it and others there needs no more memory as a table grows."""
    return df.repartition(tasks_of(df.sparkSession, df.count(), rows), key)


def of_ids(edges: DataFrame, ids: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The rows of edges, n at most, whose column `by` is among ids' key; many are dealt out by it, TASK_ROWS a task, and meet a task's ids without being sorted."""
    wanted = ids.select(F.col(key).alias(by)).distinct()
    if n <= TASK_ROWS:
        return edges.join(wanted, by)
    n = tasks_of(edges.sparkSession, max(n, ids.count()), TASK_ROWS)
    return edges.repartition(n, by).join(wanted.repartition(n, by).hint("shuffle_hash"), by)


def split_join(rows: DataFrame, facts: DataFrame, key: str, heavy: int = 100_000, size: int = 50_000) -> DataFrame:
    """rows joined to facts where a key may have many of both: heavy keys, by the measured number of their facts, are split.

    A key of more than `heavy` facts has its facts dealt out over as many salts as give each about
    `size`, and its rows go to all of those; other keys meet as they are.
    """
    counts = facts.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy)
    parts = written(counts.select(key, F.ceil(F.col("_n") / size).cast("int").alias("_parts")), scratch(facts.sparkSession))
    if parts.isEmpty():
        return rows.join(facts, key)
    # joined the other way round: the few heavy keys are the small side; a key is heavy or light for all of its rows
    n = lambda df: df.join(parts, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = n(facts).withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.col("_parts")).cast("int")).drop("_parts")
    copied = n(rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return copied.join(dealt, [key, "_salt"]).drop("_salt")


def packed(columns: list[str]) -> Column:
    """Strings, which may be null or hold any character, as one string: see unpacked."""
    def safe(c: Column) -> Column:
        text = c
        for i, mark in enumerate((ESCAPE, ROW, FIELD)):
            text = F.replace(text, F.lit(mark), F.lit(f"{ESCAPE}{i}"))
        return F.when(c.isNull(), F.lit(f"{ESCAPE}n")).otherwise(text)

    return F.concat_ws(FIELD, *[safe(F.col(c)) for c in columns])


def unpacked(c: Column, columns: list[str]) -> list[Column]:
    """The columns that packed has put together."""
    def plain(x: Column) -> Column:
        text = x
        for i, mark in ((2, FIELD), (1, ROW), (0, ESCAPE)):
            text = F.replace(text, F.lit(f"{ESCAPE}{i}"), F.lit(mark))
        return F.when(~F.contains(x, F.lit(ESCAPE)), x).when(x != f"{ESCAPE}n", text)

    fields = [c] if len(columns) == 1 else [F.split(c, FIELD)[i] for i in range(len(columns))]
    return [plain(x).alias(name) for x, name in zip(fields, columns)]


def numbered(df: DataFrame, columns: list[str]) -> tuple[Column, list[Column]] | None:
    """Whole-number columns, which may be null, as one number of 31 or 63 bits, and the columns that the number (_fact) is taken apart into; None where they need more bits."""
    ends = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))], *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    whole, parts, shift = F.lit(0).cast("long"), [], 0
    for i, c in enumerate(columns):
        least = ends[f"a{i}"] or 0
        span = (ends[f"b{i}"] or 0) - least + bool(ends[f"n{i}"])  # null is beyond the greatest
        bits = span.bit_length()
        if shift + bits > 63:
            return None
        at = F.coalesce(F.col(c).cast("long") - F.lit(least).cast("long"), F.lit(span).cast("long"))
        whole = whole.bitwiseOR(F.shiftleft(at, shift))
        part = F.shiftright(F.col("_fact").cast("long"), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        value = (part + F.lit(least).cast("long")).cast(df.schema[c].dataType)
        parts.append((F.when(part != span, value) if ends[f"n{i}"] else value).alias(c))
        shift += bits
    return whole.cast("int" if shift < 32 else "long"), parts


def listed_join(rows: DataFrame, facts: DataFrame, keys: list[str], keep: list[str], path: str, distinct: bool = True, stored: bool = False, met: DataFrame | None = None, split=None) -> DataFrame:
    """The kept columns of rows joined to facts over hubs (keys, of which some are not kept); made distinct, or not.

    A hub of m rows and n facts has m * n ways, few of which differ without the hub.  One side's facts go
    through the hub as a list, so that lists and not ways are shuffled; they are taken apart and made
    distinct where all ways of one value of the other side are, in as many tasks as the ways, estimated, ask for.
    Texts of few forms are numbers on the way, and a fact's columns one number, or one text; a column of which a key has one value stands beside its list.
    The result is partitioned by that value's column, the one of the most values.  Where keys have few facts each, or one value has too
    many ways for a task, ways are joined and made distinct as rows, hot keys split (by split, if given).  stored: both are written tables.
    met: rows of the kept columns that come along, told from ways by _met.
    """
    sides = [rows if stored else None, facts if stored else written(facts, f"{path}/facts")]
    size = sides[1].agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*keys)).alias("keys")).first()

    def once(df: DataFrame) -> DataFrame:
        return df.distinct() if distinct else df

    def plain(rows: DataFrame, facts: DataFrame) -> DataFrame:
        ways = (split or split_join)(rows, facts, keys[0]) if len(keys) == 1 else rows.join(facts, keys)
        ways = ways.select(*keep)
        return once(ways if met is None else ways.withColumn("_met", F.lit(False)).unionByName(met.select(*keep, F.lit(True).alias("_met"))))

    if size["n"] < FEW * size["keys"]:
        return plain(rows, sides[1])
    sides[0] = sides[0] or written(rows, f"{path}/rows")
    owned = [[c for c in keep if c in d.columns and c not in keys] for d in sides]
    kinds = {c: d.schema[c].dataType for d in sides for c in d.columns}
    whole = {c for c in keep if isinstance(kinds[c], IntegralType)}
    texts = [[c for c in keep if c in d.columns and kinds[c] == StringType()] for d in sides]
    coded = {c: coding for d, cs in zip(sides, texts) for c, coding in zip(cs, codings(d, [[c] for c in cs] if met is None else [])) if coding and c not in keys}
    stats = [d.agg(F.approx_count_distinct(F.struct(*keys)).alias("_keys"), *[x for c in own for x in (F.approx_count_distinct(c).alias(f"v_{c}"), F.approx_count_distinct(F.struct(*keys, c)).alias(f"k_{c}"))]).first() for d, own in zip(sides, owned)]
    whole |= set(coded)

    def listable(i: int) -> bool:
        return all(c in whole or kinds[c] == StringType() for c in owned[i])

    ranked = [(stats[i][f"v_{c}"], -i, c) for i in (0, 1) if listable(1 - i) for c in owned[i]]
    _, i, by = max(ranked)
    rows, facts, own = sides[-i], sides[1 + i], owned[1 + i]
    told = stats[1 + i]
    beside = [c for c in own if told[f"k_{c}"] <= SAME * told["_keys"]]
    if len(beside) == len(own):
        beside.remove(max(own, key=lambda c: told[f"v_{c}"]))
    own = [c for c in own if c not in beside]
    rows, facts = (d.select(*[coded[c].code(F.col(c)).alias(c) if c in coded else c for c in d.columns]) for d in (rows, facts))
    left = [c for c in keep if c not in own and c not in beside]
    number = numbered(facts if met is None else facts.select(*own).unionByName(met.select(*own)), own) if set(own) <= whole else None
    if number is None and not all(kinds[c] == StringType() for c in own):
        return plain(sides[-i], sides[1 + i])
    if number is None:  # as texts
        facts = sides[1 + i].select(*[coded[c].code(F.col(c)).alias(c) if c in coded and c in beside else c for c in sides[1 + i].columns])
    fact = packed(own) if number is None else number[0]
    count = F.count("*").over(Window.partitionBy(*keys))
    dealt = facts.select(*keys, *beside, fact.alias("_fact"), F.ceil(count / LISTED).alias("_lists"))
    dealt = dealt.select(*keys, *beside, "_fact", F.pmod(F.xxhash64("_fact"), F.col("_lists")).alias("_list"))
    every = F.collect_list("_fact")
    lists = dealt.groupBy(*keys, *beside, "_list").agg(F.count("*").alias("_n"), (F.array_join(F.array_sort(every), ROW) if number is None else every).alias("_facts"))
    lists = written(lists, f"{path}/lists")
    # a row's ways are taken to be as many as a fact's key has facts, on an average over facts
    of = lists.groupBy(*keys).agg(F.sum("_n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).first()["mean"] or 0
    ways = rows.groupBy(by).agg(F.count("*").alias("_rows")).agg(F.sum("_rows").alias("n"), F.max("_rows").alias("most")).first()
    if (ways["most"] or 0) * of > HOT_WAYS:
        return plain(sides[-i], sides[1 + i])
    lists = lists.select(*keys, *beside, "_facts")
    sent = split_join(rows, lists, keys[0], HOT_LISTS, HOT_LISTS // 2) if len(keys) == 1 else rows.join(lists, keys)
    sent = sent.select(*left, *beside, "_facts")
    if met is not None:
        known = met.select(*left, *beside, *own)
        one = packed(own) if number is None else F.array(number[0])
        sent = sent.withColumn("_met", F.lit(False)).unionByName(known.select(*left, *beside, one.alias("_facts"), F.lit(True).alias("_met")))
        beside = [*beside, "_met"]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((ways["n"] or 0) * of / WAYS) + 1)
    there = sent.repartition(tasks, by).select(*left, *beside, F.explode(F.split("_facts", ROW) if number is None else F.col("_facts")).alias("_fact"))
    apart = once(there).select(*left, *beside, *(unpacked(F.col("_fact"), own) if number is None else number[1]))
    plain_texts = {c for c in own if number is None}
    return apart.select(*[coded[c].text(F.col(c)).alias(c) if c in coded and c not in plain_texts else c for c in keep], *(["_met"] if met is not None else []))


def connected(edges: DataFrame, path: str | None = None, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (id, component): the least id that each reaches.

    A node's first label is its least neighbour, so that a star has ended before the first round.
    Then only links between different labels go on; in each round a label moves to the least that it
    is linked to, ways are halved, and the links are those of the labels that remain, so that they
    shrink and rounds grow with the logarithm of a component's diameter.  Rounds are written tables;
    only whether links remain reaches the driver.  A node's neighbours are never collected: a group
    contributes its minimum, and joins are salted.  Nulls and self-loops are left out.  Raises if
    rounds run out.
    """
    path = path or scratch(edges.sparkSession)
    edges = edges.where("a is not null and b is not null and a != b")
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/links")
    labels = links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select("b", "b")).groupBy("id").agg(F.min("component").alias("component"))
    labels = written(labels, f"{path}/labels-0")
    ends = salted_join(links, labels.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").select("x", "b").distinct()
    ends = salted_join(ends, labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    graph = written(between(ends), f"{path}/graph-0")
    for i in range(rounds):
        if graph.isEmpty():
            return labels
        moves = graph.groupBy("x").agg(F.min("y").alias("to"))
        jumped = salted_join(moves, moves.select(F.col("x").alias("to"), F.col("to").alias("next")), "to", "left").select("x", F.coalesce("next", "to").alias("to"))
        jumped = written(jumped, f"{path}/moves-{i}")
        labels = written(salted_join(labels, jumped.withColumnRenamed("x", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"{path}/labels-{i + 1}")
        ends = salted_join(graph, jumped, "x").select(F.col("to").alias("x"), "y").distinct()
        ends = salted_join(ends, jumped.select(F.col("x").alias("y"), "to"), "y", "left").select("x", F.coalesce("to", "y").alias("y"))
        graph = written(between(ends), f"{path}/graph-{i + 1}")
    raise RuntimeError("components did not settle")


def between(ends: DataFrame) -> DataFrame:
    """(x, y): the different labels that links connect, the greater first."""
    return ends.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
