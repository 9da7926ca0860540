"""Readers and writers, and the star-schema tables seen as a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.operators.joins import tasks_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str, schema: str | StructType, comment: str | None = "#", header: bool = False) -> DataFrame:
    """Tab-separated rows by position (or header); comment lines go, missing trailing columns are null."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "PERMISSIVE").option("quote", "")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Nested records, one a line."""
    return spark.read.schema(schema).json(path)


def read_quads(spark: SparkSession, path: str, graphs: list[str] | None = None, predicates: list[str] | None = None) -> DataFrame:
    """Quads (g, s, p, o) stored by p; filters on p prune folders."""
    df = spark.read.parquet(path)
    if graphs:
        df = df.where(F.col("g").isin(graphs))
    return df.where(F.col("p").isin(predicates)) if predicates else df


def write_quads(quads: DataFrame, path: str) -> None:
    """Quads in folders by predicate; a predicate of many rows becomes many files."""
    quads.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).write.mode("overwrite").partitionBy("p").parquet(path)


def read_obo(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """terms(id, name), synonyms(id, synonym), xrefs(id, xref), is_a(child, parent) of an OBO text file, a stanza a row."""
    # a stanza begins with a bracket at the start of a line, whatever ends lines
    stanzas = spark.read.text(path, lineSep="\n[").where(F.col("value").rlike(r"(?s)^\s*\[?Term\]"))
    lines = stanzas.select(F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1).alias("id"), F.explode(F.split("value", "\r?\n")).alias("line"))
    tagged = lines.where("id != ''").select("id", F.regexp_extract("line", r"^([a-z_]+):", 1).alias("tag"), F.trim(F.regexp_replace("line", r"^[a-z_]+:\s*", "")).alias("value"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("value", r"\s+!.*$", ""), r"\s*\{.*\}\s*$", ""))
    return {
        "terms": tagged.where("tag = 'name'").select("id", F.col("value").alias("name")),
        "synonyms": tagged.where("tag = 'synonym'").select("id", F.regexp_extract("value", '"((?:[^"\\\\]|\\\\.)*)"', 1).alias("synonym")),
        "xrefs": tagged.where("tag = 'xref'").select("id", F.substring_index(bare, " ", 1).alias("xref")),
        "is_a": tagged.where("tag = 'is_a'").select(F.col("id").alias("child"), F.substring_index(bare, " ", 1).alias("parent")),
    }


def write_report(df: DataFrame, path: str) -> None:
    """A tab-separated report with a header; arrays are joined by semicolons."""
    joined = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*joined).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def graph_json(nodes: DataFrame) -> DataFrame:
    """A JSON text for each node (id, node_type, label, properties): fixed fields with the properties laid over them."""
    return nodes.select("id", overlaid({"id": "id", "node_type": "node_type", "label": "label"}, F.col("properties")).alias("json"))


def edges_json(edges: DataFrame) -> DataFrame:
    """A JSON text for each edge (source_id, target_id, predicate, source, properties): fixed fields with the properties laid over them."""
    fixed = {"source_id": "source_id", "target_id": "target_id", "type": "predicate", "edge_source": "source"}
    return edges.select("source_id", "target_id", overlaid(fixed, F.col("properties")).alias("json"))


def for_export(df: DataFrame, marker: str = "...") -> DataFrame:
    """Nodes or edges whose property values are replaced by a marker."""
    return df.withColumn("properties", F.transform_values("properties", lambda k, v: F.lit(marker)))


def overlaid(fixed: dict[str, str], properties: Column) -> Column:
    """The JSON of fixed fields (name to column; nulls are left out), properties (a map) laid over them."""
    pairs = [x for name, column in fixed.items() for x in (F.lit(name), F.col(column).cast("string"))]
    over = F.coalesce(properties, F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & ~F.map_contains_key(over, k))
    return F.to_json(F.map_concat(kept, over))


def merge_prefixes(*sources: DataFrame) -> DataFrame:
    """Prefix tables (curie, iri) merged: of equal curies the later source's iri counts."""
    ranked = None
    for rank, df in enumerate(sources):
        part = df.select(F.upper("curie").alias("curie"), "iri", F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("curie").agg(F.max_by("iri", F.struct("rank", "iri")).alias("iri"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those incoming rows whose keys it lacks, one for each key."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing, keys, "left_anti"))


def missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming rows whose keys existing lacks."""
    return incoming.join(existing, keys, "left_anti")


def vectors(df: DataFrame, term: Column, vec: str) -> DataFrame:
    """(term, vec, n): embeddings under lower-case terms, with their lengths; null vectors are left out."""
    return df.where(F.col(vec).isNotNull()).select(F.lower(term).alias("term"), F.col(vec).alias("vec"), F.size(vec).cast("long").alias("n"))


def flatten_registry(nested: DataFrame, semantics: DataFrame) -> DataFrame:
    """api -> in_type -> out_type -> template maps as rows, with the predicate that semantics(in_type, out_type, predicate) gives."""
    rows = nested.select("api", F.explode("types").alias("in_type", "outs")).select("api", "in_type", F.explode("outs").alias("out_type", "template"))
    return rows.join(semantics, ["in_type", "out_type"], "left").withColumn("op", F.concat_ws("__", "api", F.concat_ws("_", "in_type", "predicate", "out_type")))


# the given tables as a graph


def curie(prefix: str, c: str | Column) -> Column:
    """prefix:value."""
    return F.concat(F.lit(f"{prefix}:"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def quads(spark: SparkSession, d: str) -> DataFrame:
    """(g, s, p, o): the star schema's keys as edges, names as literals; a filter on p leaves the tables of that predicate.

    Pairs of lines are dealt out, and made distinct by their keys, before they are terms.
    """
    t = {x: table(spark, d, x) for x in ("customer", "orders", "lineitem", "supplier", "nation", "region", "part")}

    def of(name: str, s: Column, p: str, o: Column) -> DataFrame:
        return t[name].select(F.lit(name).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    n = tasks_of(spark, t["lineitem"].count())

    def pairs(s: Column, p: str, o: Column, *keys: str) -> DataFrame:
        return t["lineitem"].select(*keys).repartition(n, *keys).distinct().select(F.lit("lineitem").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    parts = [
        of("customer", curie("CUST", "c_custkey"), "has_nation", curie("NAT", "c_nationkey")),
        of("orders", curie("ORD", "o_orderkey"), "ordered_by", curie("CUST", "o_custkey")),
        pairs(curie("ORD", "l_orderkey"), "has_part", curie("PART", "l_partkey"), "l_orderkey", "l_partkey"),
        pairs(curie("PART", "l_partkey"), "supplied_by", curie("SUPP", "l_suppkey"), "l_partkey", "l_suppkey"),
        of("supplier", curie("SUPP", "s_suppkey"), "in_nation", curie("NAT", "s_nationkey")),
        of("nation", curie("NAT", "n_nationkey"), "in_region", curie("REG", "n_regionkey")),
        of("nation", curie("NAT", "n_nationkey"), "label", F.col("n_name")),
        of("region", curie("REG", "r_regionkey"), "label", F.col("r_name")),
        of("part", curie("PART", "p_partkey"), "label", F.col("p_name")),
        of("customer", curie("CUST", "c_custkey"), "label", F.col("c_name")),
        of("supplier", curie("SUPP", "s_suppkey"), "label", F.col("s_name")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def is_a(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): parts under brands under types, customers and suppliers under nations under regions."""
    part = table(spark, d, "part")
    rows = [
        part.select(curie("PART", "p_partkey").alias("child"), curie("BRAND", "p_brand").alias("parent")),
        part.groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("t")).select(curie("BRAND", "p_brand"), curie("PTYPE", "t")),
        part.select(curie("PTYPE", "p_type"), F.lit("ROOT:PART")).distinct(),
        table(spark, d, "customer").select(curie("CUST", "c_custkey"), curie("NAT", "c_nationkey")),
        table(spark, d, "supplier").select(curie("SUPP", "s_suppkey"), curie("NAT", "s_nationkey")),
        table(spark, d, "nation").select(curie("NAT", "n_nationkey"), curie("REG", "n_regionkey")),
        table(spark, d, "region").select(curie("REG", "r_regionkey"), F.lit("ROOT:PLACE")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def mappings(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """(from_curie, to_curie, source_prefix): parts and suppliers of all lines, by return flag; once: without repeated rows."""
    rows = table(spark, d, "lineitem").select(curie("PART", "l_partkey").alias("from_curie"), curie("SUPP", "l_suppkey").alias("to_curie"), F.col("l_returnflag").alias("source_prefix"))
    return rows.distinct() if once else rows


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(term, article_id): the distinct lower-case words of five letters or more of each document."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term")
    return table(spark, d, "documents").select(words, F.col("doc_id").alias("article_id")).where("length(term) >= 5")


def exposures(spark: SparkSession, d: str) -> DataFrame:
    """(exposure_type, ts, lat, lon, value) from the events."""
    return table(spark, d, "events").select(F.col("event_type").alias("exposure_type"), "ts", (35 + F.col("user_id") / 1000.0).alias("lat"), (-79 - F.col("user_id") / 1000.0).alias("lon"), "value")


def patients(spark: SparkSession, d: str) -> DataFrame:
    """One nested record for each user: diag(code -> time -> kind), medList(code -> time), geoCode."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    one = per.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", stamp("first").alias("first"), stamp("last").alias("last")))).alias("e"))
    return one.select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int")).alias("race"),
        F.make_date(1940 + F.col("user_id").cast("int") % 60, F.lit(1), F.lit(1)).alias("birth_date"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["event_type"], F.create_map(x["first"], F.lit("OUTPATIENT"))))).alias("diag"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["event_type"], x["last"]))).alias("medList"),
        F.struct((35 + F.col("user_id") / 1000.0).alias("lat"), (-79 - F.col("user_id") / 1000.0).alias("long")).alias("geoCode"),
    )


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
