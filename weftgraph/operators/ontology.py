"""Closures, property paths, cross-reference neighbourhoods and name search."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.codes import codings
from weftgraph.operators.joins import connected, dealt, listed_join, salted_join, split_join
from weftgraph.storage import scratch, written

#: Source prefixes, at most, whose sets are kept as the bits of a number.
BITS = 32


def closure(is_a: DataFrame, reflexive: bool = False, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth): all ancestors of every child, by least depth; reflexive: the terms themselves at 0.

    Paths double: a pair whose least way has more than m and at most 2m steps is a pair of exactly m
    steps and one of at most m, so that rounds grow with the logarithm of the depth.  Pairs met before
    are left out, so cycles end.  Rounds are written tables, until one is empty or max_depth, if given, is reached.  A term reached again from itself is not its own ancestor.
    """
    home = scratch(is_a.sparkSession)
    edges = written(is_a.where("child is not null and parent is not null and child != parent").select("child", "parent").distinct(), f"{home}/edges")
    found = last = written(edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), f"{home}/1")
    m = 1
    while max_depth is None or m < max_depth:
        step = found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), (F.col("depth") + m).alias("depth"))
        more = last.where(F.col("depth") == m).select("id", "ancestor").join(step, "ancestor").where("id != next")
        least = more.groupBy("id", F.col("next").alias("ancestor")).agg(F.min("depth").alias("depth"))
        last = written(least.join(found, ["id", "ancestor"], "left_anti"), f"{home}/{2 * m}")
        if last.isEmpty():
            break
        found, m = found.unionByName(last), 2 * m
    if max_depth is not None:
        found = found.where(F.col("depth") <= max_depth)
    if reflexive:
        terms = edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct()
        found = found.unionByName(terms.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    return found


def descendants(is_a: DataFrame, roots: DataFrame, reflexive: bool = False) -> DataFrame:
    """(root, id): everything below each of the roots (id)."""
    up = closure(is_a, reflexive)
    return up.join(roots.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("ancestor").alias("root"), "id")


def having_ancestor(df: DataFrame, up: DataFrame, roots: DataFrame, column: str = "id") -> DataFrame:
    """df's rows whose term has one of the roots (id) above it."""
    below = up.join(roots.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("id").alias(column)).distinct()
    return df.join(below, column, "left_semi")


def below(is_a: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the terms that have any of the roots (id) above them, without a closure.

    Where every child has one parent, each term keeps one pointer, whose length doubles, and whether it has passed a
    root: rounds grow with the logarithm of the depth, and rows stay those of the terms.  Else
    levels below the roots are walked, each term once.  Rounds are written tables.
    """
    home = scratch(is_a.sparkSession)
    edges = written(is_a.where("child is not null and parent is not null and child != parent").select("child", "parent").distinct(), f"{home}/edges")
    top = written(roots.select(F.col(roots.columns[0]).alias("parent")).where("parent is not null").distinct(), f"{home}/roots")
    if edges.groupBy("child").count().where("count > 1").isEmpty():
        met = top.withColumn("met", F.lit(True))
        now = written(edges.join(met, "parent", "left").select(F.col("child").alias("id"), F.col("parent").alias("to"), F.coalesce("met", F.lit(False)).alias("met")), f"{home}/0")
        terms = now.count()
        for k in count(1):
            ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("met").alias("_met"))
            jumped = salted_join(now.where("to is not null and not met"), ahead, "to", "left")
            moved = jumped.select("id", F.col("_to").alias("to"), F.coalesce("_met", F.lit(False)).alias("met"))
            now = written(now.where("to is null or met").unionByName(moved), f"{home}/{k}")
            if 1 << k > terms or now.where("to is not null and not met").isEmpty():  # a pointer of more steps than terms goes round a cycle
                return now.where("met").select("id")
    found = frontier = written(edges.join(top, "parent", "left_semi").select(F.col("child").alias("id")).distinct(), f"{home}/0")
    for k in count(1):
        more = edges.join(frontier.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        frontier = written(more.join(found, "id", "left_anti"), f"{home}/{k}")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def having_root(df: DataFrame, is_a: DataFrame, roots: DataFrame, column: str = "id") -> DataFrame:
    """df's rows whose term has one of the roots (id) above it, by below: no closure is made."""
    return df.join(below(is_a, roots).withColumnRenamed("id", column), column, "left_semi")


def property_path(up: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, target): p* followed by q, up being the reflexive closure of p and edges (source_id, target_id) q."""
    return up.join(edges.select(F.col("source_id").alias("ancestor"), F.col("target_id").alias("target")), "ancestor").select("id", "target").distinct()


def khop(mappings: DataFrame, distance: int = 2, ids: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """(query_id, curie, distance, source_prefixes): identifiers within a distance of the ids (id; default: all) over mappings taken both ways.

    distance is the least; source_prefixes are those of the last mappings of the shortest ways.
    until: a prefix; ids that have met an identifier of it go no further.
    Identifiers of few forms are numbers on the way.  The last round's pairs are not written: what reads them twice should.
    """
    home = scratch(mappings.sparkSession)
    [coding] = codings(mappings, [["from_curie", "to_curie"]])
    text = (lambda c: c) if coding is None else coding.text
    code = (lambda c: c) if coding is None else coding.code
    edges = mappings.where("from_curie != to_curie").select(code(F.col("from_curie")).alias("curie"), code(F.col("to_curie")).alias("next"), "source_prefix")
    both = edges.select(F.inline(F.array(F.struct("curie", "next"), F.struct(F.col("next").alias("curie"), F.col("curie").alias("next")))), "source_prefix")
    codes = sorted(r[0] for r in mappings.where("from_curie != to_curie").select("source_prefix").where("source_prefix is not null").distinct().limit(BITS + 1).collect())
    few = len(codes) <= BITS  # then sets of prefixes are the bits of a number
    if few:
        bit = sum([F.when(F.col("source_prefix") == c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(codes)], F.lit(0).cast("long"))
        both = both.select("curie", "next", bit.alias("source_prefix")).groupBy("curie", "next").agg(F.bit_or("source_prefix").alias("source_prefix"))
    step = written(both if few else both.distinct(), f"{home}/steps")

    def grouped(df: DataFrame, k: int, *keep) -> DataFrame:
        sets = F.bit_or("source_prefix") if few else F.array_sort(F.collect_set("source_prefix"))
        return df.groupBy("query_id", "curie").agg(sets.alias("source_prefixes"), *keep).withColumn("distance", F.lit(k))

    first = step.select(F.col("curie").alias("query_id"), F.col("next").alias("curie"), "source_prefix")
    if ids is not None:
        first = first.join(ids.select(code(F.col("id")).alias("query_id")).distinct().hint("shuffle_hash"), "query_id", "left_semi")
    found = frontier = written(grouped(first, 1), f"{home}/1") if ids is not None or not few else first.select("query_id", "curie", F.col("source_prefix").alias("source_prefixes"), F.lit(1).alias("distance"))
    for k in range(2, distance + 1):
        last = frontier.select("query_id", "curie")
        if until is not None:
            # prefixes of identifiers as they are written, not as numbers
            reached = found.where(F.startswith(text(F.col("curie")), F.lit(f"{until}:"))).select("query_id").distinct()
            last = written(last.join(reached.hint("shuffle_hash"), "query_id", "left_anti"), f"{home}/last-{k}")
        known = last if k == 2 else found.select("query_id", "curie")
        facts = step.withColumnRenamed("next", "_next")
        if until is not None or ids is not None:  # lists of identifiers that nobody goes over are not made
            facts = facts.join(last.select("curie").distinct().hint("shuffle_hash"), "curie", "left_semi")
            facts = written(facts, f"{home}/facts-{k}")
        met = known.select("query_id", F.col("curie").alias("_next"), F.lit(None).cast(step.schema["source_prefix"].dataType).alias("source_prefix"))
        ways = listed_join(last, facts, ["curie"], ["query_id", "_next", "source_prefix"], f"{home}/over-{k}", not few, True, met, split_join).where("query_id != _next")
        # grouped where all ways of an id are, and what was found before came along
        more = grouped(ways.select("query_id", F.col("_next").alias("curie"), "source_prefix", "_met"), k, F.bool_or("_met").alias("_met")).where("not _met").drop("_met")
        frontier = more if k == distance else written(more, f"{home}/{k}")
        found = found.unionByName(frontier)
    if coding is not None:
        found = found.withColumns({c: text(F.col(c)) for c in ("query_id", "curie")})
    if few:
        held = F.filter(F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(c).alias("prefix")) for i, c in enumerate(codes)]), lambda x: F.col("source_prefixes").bitwiseAND(x["bit"]) != 0) if codes else None
        return found.withColumn("source_prefixes", F.array().cast("array<string>") if held is None else held["prefix"])
    return found


def khop_expanding(mappings: DataFrame, prefix: str, most: int = 3, ids: DataFrame | None = None) -> DataFrame:
    """khop's rows of a target prefix at the least distance from 1 to most that has any: ids that have met one go no further."""
    return khop(mappings, most, ids, prefix).where(F.startswith("curie", F.lit(f"{prefix}:")))


def valid_prefixes(sources: DataFrame) -> DataFrame:
    """(prefix): each source's prefix, its alternates, and MESH."""
    every = F.explode(F.concat(F.array("prefix"), F.coalesce("alternates", F.array().cast("array<string>"))))
    return sources.select(every.alias("prefix")).union(sources.sparkSession.range(1).select(F.lit("MESH"))).distinct()


def reachable_min(links: DataFrame) -> DataFrame:
    """(id, representative): the least id connected to each id of the links (a, b)."""
    return connected(links).withColumnRenamed("component", "representative")


def name_search(names: DataFrame, terms: DataFrame, synonyms: DataFrame, substring: bool = False) -> DataFrame:
    """(name, id): terms whose name or a synonym equals each name in lower case; a name without any is tried with its comma parts turned round.

    substring: terms whose name or a synonym holds the name as one of its words.
    """
    from weftgraph.functions.curie import invert_comma_name

    index = dealt(terms.select("id", F.lower("name").alias("key")).union(synonyms.select("id", F.lower("synonym"))).where("key is not null"), "id")
    asked = names.select("name", F.lower("name").alias("key")).where("key is not null").distinct()
    if substring:
        words = index.select("id", F.explode(F.array_distinct(F.split("key", r"\s+"))).alias("key")).distinct()
        return split_join(asked, written(words, scratch(terms.sparkSession)), "key").select("name", "id")
    index = written(index.distinct(), scratch(terms.sparkSession))
    known = index.select("key").distinct().withColumn("_known", F.lit(True))
    turned = F.when(F.col("_known"), F.col("key")).otherwise(F.lower(invert_comma_name(F.col("name"))))
    # a name has one key and an id has a key once: what meets is distinct; ids of one key, though nobody may ask for it, are split
    return split_join(asked.join(known, "key", "left").select("name", turned.alias("key")), index, "key").select("name", "id")


def ids_to_vocabulary(ids: DataFrame, terms: DataFrame, xrefs: DataFrame, prefix: str) -> DataFrame:
    """(id, resolved): lookup_fallback's ids that have the prefix; only where there are none, their cross-references that do."""
    from weftgraph.operators.patterns import lookup_fallback

    having = F.startswith("resolved", F.lit(f"{prefix}:"))
    first = written(lookup_fallback(ids, terms, xrefs), scratch(ids.sparkSession))
    found = first.where(having).distinct()
    rest = first.join(found.select("id").distinct(), "id", "left_anti")
    second = rest.join(xrefs.select(F.col("id").alias("resolved"), "xref"), "resolved").select("id", F.col("xref").alias("resolved"))
    return found.unionByName(second.where(having).distinct())
