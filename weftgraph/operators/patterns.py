"""Graph patterns as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.bgp import bgp
from weftgraph.operators.grams import GRAM, runs_of, with_lengths
from weftgraph.operators.joins import connected, salted_join, split_join
from weftgraph.storage import scratch, written

__all__ = ["bgp"]


def having(df: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """df's rows whose key the probe has."""
    return df.join(probe.select(key).distinct(), key, "left_semi")


def containing(labels: DataFrame, names: DataFrame, gram: int = GRAM) -> DataFrame:
    """(name, id, label): for each of the names (name) the labels (id, label) that contain it, in any case.

    Exact, and without a cross join: a name meets the labels that hold the rarest of its runs of
    `gram` letters (a shorter name: the name itself), and is looked for in those.  Distinct texts
    meet, so that a label of many ids is compared once.  Null and empty names match nothing; names are
    texts, not patterns.
    """
    asked = names.select("name").where("length(name) > 0").distinct().withColumn("_name", F.lower("name"))
    asked = asked.withColumn("_n", F.least(F.length("_name"), F.lit(gram)))
    known = labels.where("label is not null").select(F.lower("label").alias("_label")).distinct()
    sized = with_lengths(known, "_label", asked)
    held = sized.select("_label", "_n", F.explode(runs_of(F.col("_label"), F.col("_n"))).alias("_run"))
    own = asked.select("name", "_name", "_n", F.explode(runs_of(F.col("_name"), F.col("_n"))).alias("_run"))
    # runs are many more than a plan estimates from the labels' bytes: no side of a join on them is broadcast
    held = held.join(own.select("_n", "_run").distinct().hint("merge"), ["_n", "_run"], "left_semi")  # runs that no name has go before they are counted
    counts = held.groupBy("_n", "_run").agg(F.count("*").alias("_count"))
    rarest = own.join(counts.hint("merge"), ["_n", "_run"]).groupBy("name", "_name", "_n").agg(F.min_by("_run", F.struct("_count", "_run")).alias("_run"))
    hits = held.join(rarest.hint("merge"), ["_n", "_run"]).where(F.contains("_label", F.col("_name"))).select("name", "_label").distinct()
    return labels.withColumn("_label", F.lower("label")).join(hits.hint("merge"), "_label").select("name", "id", "label")


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """df's rows with each of their key's values; keys without any are left out."""
    return df.join(dimension, key)


def lookup_fallback(ids: DataFrame, terms: DataFrame, xrefs: DataFrame) -> DataFrame:
    """(id, resolved): the id itself if terms has it, else the ids that cross-reference it in either direction."""
    own = ids.join(terms.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("resolved"))
    rest = ids.join(terms.select("id").distinct(), "id", "left_anti")
    both = xrefs.select(F.col("xref").alias("id"), F.col("id").alias("resolved")).union(xrefs.select("id", F.col("xref")))
    return own.unionByName(rest.join(both.distinct(), "id").select("id", "resolved"))


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbor, predicate) of the nodes (id), edges (source_id, target_id, predicate) followed both ways."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"), "predicate").union(edges.select("target_id", "source_id", "predicate"))
    return nodes.select("id").distinct().join(both, "id").distinct()


def cooccurring(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, partner, n): for the given terms, other terms of the same articles and in how many."""
    given = mentions.join(terms.select("term").distinct(), "term")
    others = mentions.select(F.col("term").alias("partner"), "article_id")
    return split_join(given, others, "article_id").where("term != partner").groupBy("term", "partner").agg(F.count("*").alias("n"))


def with_category(pairs: DataFrame, categories: DataFrame, wanted: str) -> DataFrame:
    """Pairs (term, partner, …) whose partner's category (name, category) is the wanted one."""
    kinds = categories.where(F.col("category") == wanted).select(F.col("name").alias("partner"), "category").distinct()
    return pairs.join(kinds, "partner")


def same_as_min(synonyms: DataFrame) -> DataFrame:
    """(id, representative) over synonym links (a, b): the least id that each reaches; see operators.ontology.reachable_min."""
    from weftgraph.operators.ontology import reachable_min

    return reachable_min(synonyms)


def extended(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, added): what new links (a, b) change in stored labels (id, representative), which stay unread but for the links' ends.

    moves: representative and to, of the representatives that links bring together; added: id and
    representative of ids that had none.  Both grow with the links alone; renamed puts them to use.
    """
    home = scratch(links.sparkSession)
    links = written(links.where("a is not null and b is not null and a != b").select("a", "b").distinct(), f"{home}/links")
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    known = written(ends.join(labels.select("id", "representative"), "id", "left").select("id", F.coalesce("representative", "id").alias("rep"), F.col("representative").isNull().alias("new")), f"{home}/ends")
    a = known.select(F.col("id").alias("a"), F.col("rep").alias("_a"))
    b = known.select(F.col("id").alias("b"), F.col("rep").alias("_b"))
    between = salted_join(salted_join(links, a, "a"), b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    least = written(connected(between, f"{home}/between"), f"{home}/least")
    moves = least.where("id != component").select(F.col("id").alias("representative"), F.col("component").alias("to"))
    added = known.where("new").select("id", F.col("rep").alias("component")).join(moves.withColumnRenamed("representative", "component"), "component", "left")
    return moves, added.select("id", F.coalesce("to", "component").alias("representative"))


def renamed(labels: DataFrame, versions: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Stored labels (id, representative) after versions of extended's moves and added ids, in order."""
    for moves, added in versions:
        moved = salted_join(labels, moves.where("representative is not null"), "representative", "left")
        labels = moved.select("id", F.coalesce("to", "representative").alias("representative")).unionByName(added)
    return labels


def merge_synonyms(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Nodes (id, label) merged over synonym links: representative, synonyms and labels, sorted."""
    named = represented(nodes, synonyms)
    return named.groupBy("representative").agg(F.array_sort(F.collect_set("id")).alias("synonyms"), F.array_sort(F.collect_set("label")).alias("labels"))


def represented(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Nodes (id and others) with the representative of their synonyms, themselves if they have none."""
    rep = same_as_min(synonyms)
    return nodes.join(rep, "id", "left").withColumn("representative", F.coalesce("representative", "id"))


def merge_properties(properties: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties (id, key, kind, values) of nodes merged over synonym links, and those that cannot be.

    kind is list, set or scalar.  Lists are joined in the order of ids, sets united, scalars become
    all their values in the order of ids.  Merged: representative, key, kind, values (a set's sorted).
    A key that has different kinds in one group is no property of it: representative, key, kinds.
    """
    rows = represented(properties, synonyms)
    kinds = rows.groupBy("representative", "key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    wrong = kinds.where(F.size("kinds") > 1)
    good = rows.join(wrong, ["representative", "key"], "left_anti")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "values"))), lambda x: x["values"]))
    merged = good.groupBy("representative", "key", "kind").agg(joined.alias("values"))
    values = F.when(F.col("kind") == "set", F.array_sort(F.array_distinct("values"))).otherwise(F.col("values"))
    return merged.withColumn("values", values), wrong
