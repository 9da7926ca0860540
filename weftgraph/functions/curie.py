"""Identifier and text expressions: every function takes and gives columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One-letter codes and the node types they stand for.
TYPE_CODES = {"S": "Substance", "G": "Gene", "P": "Pathway", "A": "Anatomy", "T": "Phenotype", "D": "Disease", "X": "GeneticCondition"}


def curie_prefix(c: Column) -> Column:
    """Upper-cased text before the first colon; null without one."""
    return F.when(F.contains(c, F.lit(":")), F.upper(F.substring_index(c, ":", 1)))


def un_curie(c: Column) -> Column:
    """The second colon-separated part; the value itself without a colon."""
    return F.when(F.contains(c, F.lit(":")), F.element_at(F.split(c, ":"), 2)).otherwise(c)


def path_last(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def obo_to_curie(c: Column) -> Column:
    """The last path segment with underscores as colons."""
    return F.replace(path_last(c), F.lit("_"), F.lit(":"))


def munge_gene(c: Column) -> Column:
    """The last path segment of http IRIs; other values as they are."""
    return F.when(F.startswith(c, F.lit("http://")), path_last(c)).otherwise(c)


def short_text(c: Column, n: int = 80) -> Column:
    """Values over n characters cut and marked by dots."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def terminate(c: Column) -> Column:
    """With one slash at the end."""
    return F.when(F.endswith(c, F.lit("/")), c).otherwise(F.concat(c, F.lit("/")))


def unterminate(c: Column) -> Column:
    """Without one slash at the end."""
    return F.regexp_replace(c, "/$", "")


def rewrite_prefix(c: Column, old: str, new: str) -> Column:
    """The prefix old: replaced by new:; other values as they are."""
    return F.when(F.startswith(c, F.lit(f"{old}:")), F.concat(F.lit(f"{new}:"), F.substring(c, len(old) + 2, 1 << 30))).otherwise(c)


def type_code(c: Column) -> Column:
    """The node type of a one-letter code; null for others."""
    pairs = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    return F.try_element_at(pairs, c)


def invert_comma_name(c: Column) -> Column:
    """'Arrhythmias, Cardiac' as 'Cardiac Arrhythmias'."""
    return F.array_join(F.transform(F.reverse(F.split(c, ",")), lambda x: F.trim(x)), " ")


def split_multi(c: Column, separator: str = "|") -> Column:
    """The trimmed non-empty parts of a separated list."""
    return F.filter(F.transform(F.split(c, f"\\Q{separator}\\E"), lambda x: F.trim(x)), lambda x: x != "")


def parse_lat_lon(c: Column) -> Column:
    """'lat,lon' as a struct of doubles."""
    parts = F.split(c, ",")
    return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("lat"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("lon"))


def parse_date(c: Column) -> Column:
    """Year-month-day with one or two digits as a date; null for other texts."""
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyy-M-d")))


def format_date(c: Column) -> Column:
    """A date as year-month-day."""
    return F.date_format(c, "yyyy-MM-dd")


def normalize_name(c: Column) -> Column:
    """Known IRI prefixes go, braces and separators become underscores, all lower-case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "^https?://[^/]*/", ""), r"[{}?=/\s]+", "_"))


def quote_keyword(c: Column) -> Column:
    """In double quotes if it holds a space."""
    return F.when(F.contains(c, F.lit(" ")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def node_shortname(label: Column, identifier: Column) -> Column:
    """'label (identifier)', or the identifier."""
    return F.when(label.isNotNull(), F.concat(label, F.lit(" ("), identifier, F.lit(")"))).otherwise(identifier)


def edge_is_synonym(predicate: Column) -> Column:
    """Whether an edge's predicate says that both ends are one thing."""
    return F.coalesce(F.lower(predicate) == "synonym", F.lit(False))


def extract_path_values(c: Column, path: str, prefix: str | None = None) -> Column:
    """The text at a JSON path; null unless it starts with prefix, if one is given."""
    value = F.get_json_object(c, path)
    return value if prefix is None else F.when(F.startswith(value, F.lit(prefix)), value)


def valid_nodes(nodes: DataFrame, node_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose node_type is listed in node_types(node_type), and the others."""
    kinds = node_types.select("node_type").distinct()
    return nodes.join(kinds, "node_type", "left_semi"), nodes.join(kinds, "node_type", "left_anti")


#: Where an IRI's base may end and its local part begin: after each of these.
CUTS = "[/#_=:]"


def to_curie(df: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """df and curie: the prefix registered (curie, iri) for the longest base of an IRI; null if unknown.

    A base ends with /, #, _, = or :, or before it; a final slash of the IRI is ignored.
    """
    return longest_base(df, prefixes, column).drop("_local")


def longest_base(df: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """df, curie and _local, what follows the longest registered base."""
    base = prefixes.select(F.regexp_replace("iri", f"{CUTS}$", "").alias("_base"), "curie").groupBy("_base").agg(F.min("curie").alias("curie"))
    iris = df.select(F.col(column).alias("_iri")).where("_iri is not null").distinct()
    whole = unterminate(F.col("_iri"))
    ends = F.filter(F.sequence(F.lit(1), F.length(whole) - 1), lambda i: F.rlike(F.substring(whole, i, 1), F.lit(CUTS)))
    tried = iris.where(F.length(whole) > 1).select("_iri", F.explode(ends).alias("_end")).select("_iri", "_end", F.substring(F.col("_iri"), F.lit(1), F.col("_end") - 1).alias("_base"))
    best = tried.join(base, "_base").groupBy("_iri").agg(F.max_by(F.struct("curie", "_end"), F.col("_end")).alias("_b"))
    best = best.select("_iri", F.col("_b.curie").alias("curie"), F.substring(whole, F.col("_b._end") + 1, F.length("_iri")).alias("_local"))
    return df.join(best, df[column] == best["_iri"], "left").drop("_iri")


def make_up_curie(df: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """As to_curie; where the IRI is unknown, its last segment in upper case."""
    return to_curie(df, prefixes, column).withColumn("curie", F.coalesce("curie", F.upper(path_last(unterminate(F.col(column))))))


def curie_to_iri(df: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """df and iri: the registered base of the identifier's prefix and its local part; null if unknown."""
    bases = prefixes.groupBy(F.upper("curie").alias("_prefix")).agg(F.min("iri").alias("_iri"))
    return df.withColumn("_prefix", curie_prefix(F.col(column))).join(bases, "_prefix", "left").withColumn("iri", F.concat(terminate(F.col("_iri")), un_curie(F.col(column)))).drop("_prefix", "_iri")


def guess_type(df: DataFrame, prefixes: DataFrame, column: str, source: str) -> DataFrame:
    """df and type_iri: the base of the identifier's prefix, else that of the source named in a column."""
    one = prefixes.groupBy(F.upper("curie").alias("_prefix")).agg(F.min("iri").alias("_iri"))
    two = one.select(F.col("_prefix").alias("_source"), F.col("_iri").alias("_other"))
    out = df.withColumn("_prefix", curie_prefix(F.col(column))).withColumn("_source", F.upper(F.col(source)))
    return out.join(one, "_prefix", "left").join(two, "_source", "left").withColumn("type_iri", F.coalesce("_iri", "_other")).drop("_prefix", "_source", "_iri", "_other")


def iri_compact(df: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """df and compact: an IRI as CURIE, or itself where its base is unknown."""
    return longest_base(df, prefixes, column).withColumn("compact", F.coalesce(F.concat("curie", F.lit(":"), "_local"), F.col(column))).drop("curie", "_local")


def abstract_type(df: DataFrame, concepts: DataFrame, column: str) -> DataFrame:
    """df and concept: the concept of the identifier's prefix (concepts: type, concept); null if unknown."""
    kinds = concepts.groupBy(F.upper("type").alias("_prefix")).agg(F.min("concept").alias("concept"))
    return df.withColumn("_prefix", curie_prefix(F.col(column))).join(kinds, "_prefix", "left").drop("_prefix")


def expand_keys(df: DataFrame, context: DataFrame, record: str) -> DataFrame:
    """df's rows by key of a map column: key as the IRI that context(term, iri) gives it, or itself, and the value as text."""
    terms = context.groupBy("term").agg(F.min("iri").alias("_iri"))
    rows = df.select(*[c for c in df.columns if c != record], F.explode(record).alias("key", "value"))
    return rows.join(terms, F.col("key") == F.col("term"), "left").withColumns({"key": F.coalesce("_iri", "key"), "value": F.col("value").cast("string")}).drop("term", "_iri")


def expand_context(df: DataFrame, context: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """df (rows told apart by keys) with its map column put together again: keys as IRIs, values as texts.

    Of several keys that expand to one IRI the greatest value counts.  Null and empty records stay as they are.
    """
    rows = expand_keys(df.select(*keys, record), context, record).groupBy(*keys, "key").agg(F.max("value").alias("value"))
    whole = rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_whole"))
    kept = F.coalesce("_whole", F.transform_values(record, lambda k, v: v.cast("string")))
    return df.join(whole, keys, "left").withColumn(record, kept).drop("_whole")
