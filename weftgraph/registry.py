"""The queries of the library's own operators over the given tables, by name, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import curie as c
from weftgraph.operators import filters, measures, nearest, ontology, patterns, patterntable, typegraph
from weftgraph.plans import adapters, domain
from weftgraph.sources import tables as t
from weftgraph.storage import scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


IS_A = """is_a AS (
  SELECT 'PART:' || p_partkey AS child, 'BRAND:' || p_brand AS parent FROM part
  UNION SELECT 'BRAND:' || p_brand, 'PTYPE:' || arg_min(p_type, p_partkey) FROM part GROUP BY p_brand
  UNION SELECT 'PTYPE:' || p_type, 'ROOT:PART' FROM part
  UNION SELECT 'CUST:' || c_custkey, 'NAT:' || c_nationkey FROM customer
  UNION SELECT 'SUPP:' || s_suppkey, 'NAT:' || s_nationkey FROM supplier
  UNION SELECT 'NAT:' || n_nationkey, 'REG:' || n_regionkey FROM nation
  UNION SELECT 'REG:' || r_regionkey, 'ROOT:PLACE' FROM region)"""
CLOSURE = f"""WITH RECURSIVE {IS_A}, up AS (
  SELECT child AS id, parent AS ancestor, 1 AS depth FROM is_a
  UNION SELECT up.id, is_a.parent, up.depth + 1 FROM up JOIN is_a ON up.ancestor = is_a.child)"""
MAPPINGS = """m AS (SELECT DISTINCT 'PART:' || l_partkey AS a, 'SUPP:' || l_suppkey AS b, l_returnflag AS f FROM lineitem),
 e AS (SELECT a, b, f FROM m UNION SELECT b, a, f FROM m)"""
IXN = """ixn AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s FROM lineitem),
 said AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, 'Y' || year(l_shipdate) || '|F' || l_linestatus AS other FROM lineitem),
 typed AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_returnflag || '|' || l_linestatus AS types FROM lineitem),
 assoc AS (SELECT DISTINCT o_orderkey AS o, o_custkey AS c, l_partkey AS p, o_orderstatus || '|' || o_orderpriority AS pmids FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 target AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
 pathway AS (SELECT s_suppkey AS s, n_nationkey AS n, CASE WHEN n_regionkey = 1 THEN n_name || ' (human)' ELSE n_name END AS path_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def T(spark, d, name):
    return t.table(spark, d, name)


def chem(spark, d):
    return adapters.chem_graph(spark, d)


def names_of(spark, d, name, column):
    """Every name of a table, as those that are asked for."""
    return T(spark, d, name).select(F.col(column).alias("name")).distinct()


def ids(spark, d, name, prefix, column):
    return T(spark, d, name).select(t.curie(prefix, column).alias("id"))


# scans, sources, sinks


@query("SELECT 'NAT:' || n_nationkey AS s, n_name AS o FROM nation UNION ALL SELECT 'REG:' || r_regionkey, r_name FROM region")
def scan_quads(spark, d):
    path = scratch(spark)
    t.write_quads(t.quads(spark, d), path)
    return t.read_quads(spark, path, ["nation", "region"], ["label"]).select("s", "o")


@query("SELECT p_partkey, p_name, p_brand FROM part")
def scan_tsv_commented(spark, d):
    path = scratch(spark)
    T(spark, d, "part").select(F.concat_ws("\t", "p_partkey", "p_name", "p_brand").alias("value")).union(spark.range(1).select(F.lit("# a comment"))).write.text(path)
    return t.read_tsv(spark, path, "p_partkey long, p_name string, p_brand string")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_tsv_header(spark, d):
    path = scratch(spark)
    T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("sep", "\t").option("header", True).csv(path)
    return t.read_tsv(spark, path, "c_custkey long, c_name string, c_mktsegment string", comment=None, header=True)


def obo_of(spark, d):
    path = scratch(spark)
    part = T(spark, d, "part")
    lines = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), t.curie("PART", "p_partkey")), F.concat(F.lit("name: "), F.col("p_name")), F.concat(F.lit('synonym: "'), F.lower("p_type"), F.lit('" EXACT []')), F.concat(F.lit("xref: BRAND:"), F.regexp_replace("p_brand", r"\s", "_"), F.lit(" ! a brand")), F.concat(F.lit("is_a: SIZE:"), F.col("p_size"), F.lit(" {a=\"b\"} ! size"), F.lit("\n")))
    part.select(lines.alias("value")).write.text(path)
    return t.read_obo(spark, path)


@query("SELECT 'PART:' || p_partkey AS id, p_name AS name, lower(p_type) AS synonym, 'BRAND:' || regexp_replace(p_brand, '\\s', '_', 'g') AS xref, 'SIZE:' || p_size AS parent FROM part")
def scan_obo(spark, d):
    o = obo_of(spark, d)
    return o["terms"].join(o["synonyms"], "id").join(o["xrefs"], "id").join(o["is_a"].withColumnRenamed("child", "id"), "id")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def scan_nested_json(spark, d):
    path = scratch(spark)
    T(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props")).write.json(path)
    return t.read_json(spark, path, "event_id long, props struct<k: long>").select("event_id", F.col("props.k").alias("k"))


@query("SELECT 'P' || p_size AS curie, arg_max(p_name, (p_partkey)) AS iri FROM part GROUP BY p_size")
def scan_prefix_map(spark, d):
    part = T(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_size")).alias("curie"), F.col("p_name").alias("iri"), "p_partkey")
    later = part.groupBy("curie").agg(F.max_by("iri", "p_partkey").alias("iri"))
    earlier = part.groupBy("curie").agg(F.min_by("iri", "p_partkey").alias("iri"))
    return t.merge_prefixes(earlier, later)


@query("SELECT DISTINCT p_brand AS api, p_type AS in_type, 'S' || p_size AS out_type, p_size % 7 || '' AS predicate FROM part")
def flatten_registry(spark, d):
    part = T(spark, d, "part").withColumn("out", F.concat(F.lit("S"), F.col("p_size")))
    outs = part.groupBy("p_brand", "p_type").agg(F.map_from_arrays(F.collect_set("out"), F.transform(F.collect_set("out"), lambda x: F.concat(F.lit("/"), x))).alias("outs"))
    nested = outs.groupBy(F.col("p_brand").alias("api")).agg(F.map_from_entries(F.collect_list(F.struct("p_type", "outs"))).alias("types"))
    semantics = part.select(F.col("p_type").alias("in_type"), F.col("out").alias("out_type"), (F.col("p_size") % 7).cast("string").alias("predicate")).distinct()
    return t.flatten_registry(nested, semantics).select("api", "in_type", "out_type", "predicate")


@query("SELECT 't' || vec_id AS term, len(embedding) AS n FROM embeddings")
def scan_embeddings(spark, d):
    return t.vectors(T(spark, d, "embeddings"), F.concat(F.lit("T"), F.col("vec_id")), "embedding").select("term", "n")


@query("SELECT p_brand, string_agg(p_name, ';' ORDER BY p_name) AS names FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand")
def sink_tsv_report(spark, d):
    path = scratch(spark)
    t.write_report(T(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names")), path)
    return t.read_tsv(spark, path, "p_brand string, names string", comment=None, header=True)


@query("SELECT 'SUPP:' || s_suppkey AS id, s_name AS label, 'X' || s_nationkey AS node_type FROM supplier")
def sink_graph_json(spark, d):
    nodes = T(spark, d, "supplier").select(t.curie("SUPP", "s_suppkey").alias("id"), F.lit("Gene").alias("node_type"), F.col("s_name").alias("label"), F.create_map(F.lit("node_type"), F.concat(F.lit("X"), F.col("s_nationkey"))).alias("properties"))
    j = t.graph_json(nodes)
    return j.select("id", F.get_json_object("json", "$.label").alias("label"), F.get_json_object("json", "$.node_type").alias("node_type"))


@query("SELECT 'SUPP:' || s_suppkey AS source_id, 'NAT:' || s_nationkey AS target_id, 'in_nation' AS type, s_name AS name FROM supplier")
def sink_edges_json(spark, d):
    path = scratch(spark)
    edges = T(spark, d, "supplier").select(t.curie("SUPP", "s_suppkey").alias("source_id"), t.curie("NAT", "s_nationkey").alias("target_id"), F.lit("in_nation").alias("predicate"), F.lit("given").alias("source"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"))
    t.edges_json(edges).select("json").write.text(path)
    return t.read_json(spark, path, "source_id string, target_id string, type string, name string")


@query("SELECT 'SUPP:' || s_suppkey AS id, '...' AS name FROM supplier")
def sink_graph_export(spark, d):
    nodes = T(spark, d, "supplier").select(t.curie("SUPP", "s_suppkey").alias("id"), F.lit("Gene").alias("node_type"), F.col("s_name").alias("label"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"))
    return t.graph_json(t.for_export(nodes)).select("id", F.get_json_object("json", "$.name").alias("name"))


@query("SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def upsert_type_graph(spark, d):
    return t.upsert(T(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct(), T(spark, d, "customer").select(F.col("c_custkey").alias("id")), ["id"])


@query("SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey AND r.l_returnflag = 'R')")
def anti_existing(spark, d):
    """Pairs that no returned line has."""
    pairs = T(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_returnflag")
    returned = filters.equal_to(pairs, "l_returnflag", "R").select("part", "supplier").distinct()
    return t.missing(returned, pairs.select("part", "supplier").distinct(), ["part", "supplier"])


# projections, filters


@query("SELECT concat_ws(',', 'NAT:' || n_nationkey, n_name) AS row FROM nation")
def project_bindings(spark, d):
    rows = T(spark, d, "nation").select(t.curie("NAT", "n_nationkey").alias("n"), F.col("n_name").alias("name"))
    return filters.project(rows, ["n", "name"], flat=True).select(F.array_join("row", ",").alias("row"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000")
def bind_parameters(spark, d):
    T(spark, d, "orders").createOrReplaceTempView("weft_orders")
    return filters.run_template(spark, "SELECT o_orderkey, o_totalprice FROM weft_orders WHERE array_contains(:states, o_orderstatus) AND o_totalprice > :least", states=["F", "O"], least=1000)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def filter_values(spark, d):
    wanted = T(spark, d, "part").where("p_size > 25").select("p_partkey")
    return filters.where_in(T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", wanted)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)B[aeiou]')")
def filter_iregex(spark, d):
    return T(spark, d, "part").select("p_partkey", "p_name").where(filters.iregex(F.col("p_name"), "B[aeiou]"))


@query("""WITH p AS (SELECT DISTINCT 'omer#0*' || c_custkey || '$' AS pattern FROM customer UNION SELECT DISTINCT '^cust.*' || c_nationkey || '[02468]$' FROM customer UNION SELECT c_mktsegment || '|r#0+7$' FROM customer UNION SELECT '(.)0' || n_regionkey || '?1$' FROM nation)
SELECT pattern, 'CUST:' || c_custkey AS id, c_name AS label FROM customer JOIN p ON regexp_matches(c_name, '(?i)' || pattern)""")
def filter_iregex_table(spark, d):
    """As many patterns as customers and more, from the tables."""
    customer, nation = T(spark, d, "customer"), T(spark, d, "nation")
    asked = customer.select(F.concat(F.lit("omer#0*"), "c_custkey", F.lit("$")).alias("pattern"))
    asked = asked.union(customer.select(F.concat(F.lit("^cust.*"), "c_nationkey", F.lit("[02468]$")))).union(customer.select(F.concat("c_mktsegment", F.lit("|r#0+7$")))).union(nation.select(F.concat(F.lit("(.)0"), "n_regionkey", F.lit("?1$"))))
    return patterntable.matching_table(customer.select(t.curie("CUST", "c_custkey").alias("id"), F.col("c_name").alias("label")), asked)


@query("SELECT 'CUST:' || c_custkey AS s FROM customer UNION ALL SELECT 'CUST:' || c_custkey FROM customer")
def filter_prefix(spark, d):
    q = t.quads(spark, d)
    return q.where(filters.with_prefix(F.col("s"), "CUST")).select("s")


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-')")
def filter_pattern(spark, d):
    return filters.matching(T(spark, d, "orders"), "o_orderpriority", "^[12]-").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def filter_equals(spark, d):
    return filters.equal_to(T(spark, d, "lineitem"), "l_returnflag", "R").select("l_orderkey", "l_linenumber")


@query("SELECT 'ORD:' || l_orderkey AS id, 'SUPP:' || l_suppkey AS refid FROM lineitem WHERE l_returnflag = 'R'")
def filter_array_structs(spark, d):
    return adapters.records(spark, d).select("id", F.explode(filters.pick(F.col("links"), "kind", "Target", "refid")).alias("refid"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 0")
def filter_nodes_by_label(spark, d):
    nodes = T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array("c_mktsegment", F.when(F.col("c_acctbal") > 0, "CREDIT").otherwise("DEBIT")).alias("labels"), F.create_map(F.lit("name"), "c_name").alias("properties"))
    return filters.filter_nodes(nodes, ["BUILDING", "CREDIT"], ["name"])


@query("SELECT 'ORD:' || l_orderkey AS id, 'PART:' || l_partkey AS target_id, CASE WHEN l_linenumber % 2 = 0 THEN 'pmid:' || l_suppkey ELSE '' END AS pmids FROM lineitem")
def filter_publications(spark, d):
    return domain.associations(adapters.association_records(spark, d), "r").select("id", "target_id", F.array_join("pmids", ";").alias("pmids"))


@query("SELECT DISTINCT user_id || '' AS patient_id FROM events WHERE user_id % 2 = 0 AND user_id % 3 = 1")
def filter_optional(spark, d):
    return filters.patients_where(t.patients(spark, d), "2024-06-01", sex="F", race="B").select("patient_id")


@query("SELECT DISTINCT user_id || '' AS patient_id FROM events WHERE user_id = 4")
def filter_optional_place(spark, d):
    """The patients at one place; each place has one."""
    return filters.patients_where(t.patients(spark, d), "2024-06-01", sex="F", lat_long=(35 + 4 / 1000.0, -79 - 4 / 1000.0)).select("patient_id")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def filter_exposures(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.col("event_type").alias("exposure_type"), "ts", "value")
    return filters.filter_exposures(e, "click", "2024-01-05", "2024-01-10").select("event_id", "value")


@query("""WITH p AS (SELECT DISTINCT user_id, 35 + user_id / 1000.0 AS lat, -79 - user_id / 1000.0 AS lon FROM events), x AS (
 SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - 35.05) / 2), 2) + cos(radians(35.05)) * cos(radians(lat)) * power(sin(radians(lon + 79.05) / 2), 2)))) AS km FROM p)
SELECT lat, lon, round(km, 6) AS distance_km FROM x WHERE km <= 5""")
def within_radius(spark, d):
    places = t.exposures(spark, d).select("lat", "lon").distinct()
    return filters.within_radius(places, 35.05, -79.05, 5).withColumn("distance_km", F.round("distance_km", 6))


@query("""WITH p AS (SELECT DISTINCT 35 + user_id / 1000.0 AS lat, -79 - user_id / 1000.0 AS lon FROM events), s AS (SELECT 'SUPP:' || s_suppkey AS place, 35 + s_nationkey / 300.0 AS la, -79 - s_suppkey / 7000.0 AS lo, 1 + s_suppkey % 9 AS r FROM supplier), x AS (
 SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin(radians(lon - lo) / 2), 2)))) AS km FROM p, s)
SELECT lat, lon, place, round(km, 6) AS distance_km FROM x WHERE km <= r""")
def within_radius_of_places(spark, d):
    """All places of exposures that lie round each supplier."""
    points = t.exposures(spark, d).select("lat", "lon").distinct()
    places = T(spark, d, "supplier").select(t.curie("SUPP", "s_suppkey").alias("place"), (35 + F.col("s_nationkey") / 300.0).alias("lat"), (-79 - F.col("s_suppkey") / 7000.0).alias("lon"), (1 + F.col("s_suppkey") % 9).cast("double").alias("radius_km"))
    return filters.within_radius_of(points, places).withColumn("distance_km", F.round("distance_km", 6))


# joins and patterns


@query("SELECT 'CUST:' || o_custkey AS customer, 'PART:' || l_partkey AS part, r_name AS region FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def bgp_match(spark, d):
    return patterns.bgp(t.quads(spark, d), [("?order", "ordered_by", "?customer"), ("?order", "has_part", "?part"), ("?customer", "has_nation", "?nation"), ("?nation", "in_region", "?r"), ("?r", "label", "?region")], ["customer", "part", "region"])


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_multimap(spark, d):
    dim = T(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return patterns.lookup(T(spark, d, "customer"), dim, "c_nationkey").select("c_custkey", "n_name")


@query(f"""WITH {MAPPINGS}, ids AS (SELECT DISTINCT a AS id FROM e), terms AS (SELECT 'SUPP:' || s_suppkey AS id FROM supplier)
SELECT id, id AS resolved FROM ids WHERE id IN (SELECT id FROM terms) UNION ALL
SELECT DISTINCT id, b FROM ids JOIN e ON id = a WHERE id NOT IN (SELECT id FROM terms)""")
def lookup_fallback(spark, d):
    m = t.mappings(spark, d)
    every = m.select(F.col("from_curie").alias("id")).union(m.select("to_curie")).distinct()
    return patterns.lookup_fallback(every, ids(spark, d, "supplier", "SUPP", "s_suppkey"), m.select(F.col("from_curie").alias("id"), F.col("to_curie").alias("xref")))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_exists(spark, d):
    probe = filters.equal_to(T(spark, d, "orders"), "o_orderstatus", "F").select(F.col("o_custkey").alias("c_custkey"))
    return patterns.having(T(spark, d, "customer"), probe, "c_custkey").select("c_custkey", "c_name")


@query("SELECT 'ORD:' || o_orderkey AS order_id, 'CUST:' || o_custkey AS customer FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def join_existence_pattern(spark, d):
    """A pattern that shares one variable and gives no column: rows keep its multiplicity."""
    return patterns.bgp(t.quads(spark, d), [("?order_id", "ordered_by", "?customer"), ("?order_id", "has_part", "?any")], ["order_id", "customer"])


@query("SELECT DISTINCT 'NAT:' || c_nationkey AS id, 'CUST:' || c_custkey AS neighbor FROM customer UNION SELECT 'NAT:' || s_nationkey, 'SUPP:' || s_suppkey FROM supplier UNION SELECT 'NAT:' || n_nationkey, 'REG:' || n_regionkey FROM nation")
def join_undirected(spark, d):
    e = t.quads(spark, d).where("p != 'label'").select(F.col("s").alias("source_id"), F.col("o").alias("target_id"), F.col("p").alias("predicate"))
    return patterns.neighbors(e, ids(spark, d, "nation", "NAT", "n_nationkey")).select("id", "neighbor")


WORDS = "w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents), mentions AS (SELECT * FROM w WHERE length(term) >= 5)"
GIVEN = ("trash", "worthless", "licensed", "apache", "version")
GIVEN_SQL = ", ".join(f"('{x}')" for x in GIVEN)


@query(f"WITH {WORDS} SELECT a.term, b.term AS partner, count(*) AS n FROM mentions a JOIN mentions b USING (doc_id) WHERE a.term IN (VALUES {GIVEN_SQL}) AND a.term <> b.term GROUP BY ALL")
def join_two_hop(spark, d):
    return patterns.cooccurring(t.mentions(spark, d), spark.createDataFrame([(x,) for x in GIVEN], "term string"))


@query(f"WITH {WORDS} SELECT a.term, b.term AS partner, count(*) AS n FROM mentions a JOIN mentions b USING (doc_id) WHERE a.term IN (VALUES {GIVEN_SQL}) AND a.term <> b.term AND length(b.term) >= 12 GROUP BY ALL")
def join_category(spark, d):
    m = t.mentions(spark, d)
    categories = m.select(F.col("term").alias("name"), F.when(F.length("term") >= 12, "long").otherwise("short").alias("category")).distinct()
    pairs = patterns.cooccurring(m, spark.createDataFrame([(x,) for x in GIVEN], "term string"))
    return patterns.with_category(pairs, categories, "long").drop("category")


@query("SELECT 'PART:' || l_partkey AS id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT p_brand, arg_min(p_type, p_partkey) AS t FROM part GROUP BY p_brand) b USING (p_brand) WHERE t = (SELECT max(p_type) FROM part) GROUP BY 1")
def join_ancestor_semi(spark, d):
    root = T(spark, d, "part").agg(t.curie("PTYPE", F.max("p_type")).alias("id"))
    counts = T(spark, d, "lineitem").groupBy(t.curie("PART", "l_partkey").alias("id")).agg(F.count("*").alias("n"))
    return ontology.having_root(counts, t.is_a(spark, d), root)


# the domain questions


@query(f"WITH {IXN} SELECT 'CHEM:' || ixn.p AS compound, 'GENE:' || ixn.s AS gene, 'PATH:' || n AS path, path_name, 'PATH:' || n AS path_id, path_name LIKE '%(human)%' AS human FROM ixn JOIN pathway USING (s)")
def q_exposure_conditions(spark, d):
    return domain.exposure_conditions(chem(spark, d), ids(spark, d, "part", "CHEM", "p_partkey"))


@query(f"WITH {IXN} SELECT 'DIS:' || c AS disease, 'CHEM:' || p AS compound, pmids, 'DRUG:' || p AS drug, p_name AS drug_name FROM assoc JOIN part ON p = p_partkey")
def q_drugs_by_condition(spark, d):
    return domain.drugs_by_condition(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"))


@query(f"WITH {IXN} SELECT 'DIS:' || c AS source_id, 'DRUG:' || p AS target_id, 'CHEM:' || p AS compound, pmids FROM assoc JOIN part ON p = p_partkey")
def q_drugs_by_condition_graph(spark, d):
    return domain.drugs_by_condition_graph(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"))


@query(f"WITH {IXN} SELECT DISTINCT 'DIS:' || c AS disease, p_name AS drug_name, 'DRUG:' || p AS drug FROM assoc JOIN part ON p = p_partkey")
def q_drugs_by_disease(spark, d):
    return domain.drugs_by_disease(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"))


@query(f"WITH {IXN} SELECT DISTINCT 'DIS:' || c AS disease, 'DRUG:' || p AS drug, 'GENE:' || s AS gene, 'PATH:' || n AS path, path_name FROM assoc JOIN part ON p = p_partkey JOIN target USING (p) JOIN pathway USING (s)")
def q_genes_pathways_by_disease(spark, d):
    return domain.genes_pathways_by_disease(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"))


@query(f"WITH {IXN} SELECT DISTINCT 'DIS:' || c AS disease, 'DRUG:' || p AS drug, 'GENE:' || s AS gene, 'PATH:' || n AS path, path_name FROM assoc JOIN part ON p = p_partkey JOIN target USING (p) JOIN pathway USING (s)")
def q_genes_pathways_by_disease_all(spark, d):
    return domain.genes_pathways_by_disease(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"))


@query(f"WITH {IXN} SELECT DISTINCT 'DIS:' || c AS source_id, 'UNIPROT:' || s AS target_id, 'PATH:' || n AS kegg_path FROM assoc JOIN part ON p = p_partkey JOIN target USING (p) JOIN pathway USING (s)")
def q_genes_by_disease_graph(spark, d):
    return domain.genes_by_disease_graph(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"), None)


@query(f"WITH {IXN} SELECT DISTINCT p_name AS drug_name, 'GENE:' || ixn.s AS gene, 'DIS:' || c AS disease, c_name AS disease_name FROM assoc JOIN part ON p = p_partkey JOIN ixn USING (p) JOIN customer ON c = c_custkey ")
def q_drug_gene_disease(spark, d):
    return domain.drug_gene_disease(chem(spark, d), names_of(spark, d, "part", "p_name"), names_of(spark, d, "customer", "c_name"))


@query("""WITH l AS (SELECT *, l_returnflag || ';' || l_linestatus AS types, 'Y' || year(l_shipdate) || ';F' || l_linestatus AS pmids FROM lineitem)
SELECT DISTINCT 'CHEM:' || l_partkey AS compound, 'GENE:' || l_suppkey AS gene, 'MESH:' || l_partkey AS mesh, 'affects in ' || l_linenumber AS interaction, l.types, m.pmids
FROM l JOIN l m USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def q_compound_genes(spark, d):
    return domain.compound_genes(chem(spark, d), ids(spark, d, "part", "CHEM", "p_partkey")).withColumns({c: F.array_join(c, ";") for c in ("types", "pmids")})


@query(f"WITH {IXN} SELECT DISTINCT name, 'DRUG:' || p AS drug, p_name AS drug_name, 'GENE:' || s AS gene, other AS pmids FROM said JOIN part ON p = p_partkey JOIN (SELECT DISTINCT p_name AS name FROM part) ON contains(lower(p_name), lower(name))")
def q_drug_name_to_gene(spark, d):
    return domain.drug_name_to_gene(chem(spark, d), names_of(spark, d, "part", "p_name"))


@query("SELECT DISTINCT word AS name, 'CHEM:' || p_partkey AS compound, p_name AS drug_name FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part) ON contains(lower(p_name), lower(word))")
def q_drug_name_to_compound(spark, d):
    """Names are the second words of all names."""
    words = T(spark, d, "part").select(F.substring_index("p_name", " ", -1).alias("name")).distinct()
    return domain.drug_name_to_compound(chem(spark, d), words)


@query("SELECT DISTINCT name, 'CHEM:' || p_partkey AS compound, p_name AS drug_name FROM part JOIN (SELECT DISTINCT '^' || substr(p_name, 1, 3) || '.* ' || split_part(p_name, ' ', 2) || 's?$' AS name FROM part) ON regexp_matches(p_name, '(?i)' || name)")
def q_drug_name_pattern_to_compound(spark, d):
    """Names are patterns, from the beginnings and second words of all names."""
    asked = T(spark, d, "part").select(F.concat(F.lit("^"), F.substring("p_name", 1, 3), F.lit(".* "), F.substring_index("p_name", " ", -1), F.lit("s?$")).alias("name")).distinct()
    return domain.drug_name_to_compound(chem(spark, d), asked, patterns=True)


@query("SELECT DISTINCT name, p_name AS drug_name, 'DRUGBANK:' || p_partkey AS target_id FROM part JOIN (SELECT DISTINCT upper(p_name) AS name FROM part) ON contains(lower(p_name), lower(name))")
def q_drug_name_to_drugbank(spark, d):
    return domain.drug_name_to_id(chem(spark, d), names_of(spark, d, "part", "p_name").select(F.upper("name").alias("name")), "DRUGBANK")


@query("SELECT DISTINCT name, 'SUPP:' || s_suppkey AS id, s_name || ' of ' || n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT n_name AS name FROM nation) ON contains(lower(s_name || ' of ' || n_name), lower(name))")
def q_drug_name_to_provider_id(spark, d):
    """Suppliers as a provider's ligands, named with their nation, found by every nation's name."""
    nation = T(spark, d, "nation")
    ligands = T(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(t.curie("SUPP", "s_suppkey").alias("id"), F.concat("s_name", F.lit(" of "), "n_name").alias("name"))
    return domain.drug_name_to_provider_id(ligands, nation.select(F.col("n_name").alias("name")))


def every_gene(spark, d):
    """Suppliers, and customers, which no chemical interaction names."""
    return ids(spark, d, "supplier", "GENE", "s_suppkey").union(ids(spark, d, "customer", "GENE:C", "c_custkey").select(F.replace("id", F.lit("GENE:C:"), F.lit("GENE:C"))))


@query(f"WITH {IXN} SELECT DISTINCT 'GENE:' || s AS gene, 'PATH:' || n AS path, path_name FROM pathway WHERE s IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND EXISTS (SELECT 1 FROM assoc JOIN part ON p = p_partkey)")
def q_pathways_by_gene(spark, d):
    """Genes whose drug target has a GeneBank id: the customers' have none."""
    return domain.pathways_by_gene(adapters.gene_quads(spark, d), every_gene(spark, d))


@query(f"WITH {IXN} SELECT DISTINCT 'GENE:' || s AS gene, 'UNI:' || s AS protein, 'PATH:' || n AS path, path_name FROM pathway WHERE s IN (SELECT s FROM ixn)")
def q_gene_to_pathway_by_symbol(spark, d):
    """Gene symbols that an interaction names: no customer's."""
    return domain.pathways_by_symbol(adapters.gene_quads(spark, d), every_gene(spark, d))


@query("SELECT 'UNI:' || s_suppkey AS source_id, 'HGNC:' || s_suppkey AS target_id FROM supplier")
def q_same_as(spark, d):
    return domain.same_as(chem(spark, d), "owl:sameAs", "HGNC")


@query(f"WITH {IXN} SELECT DISTINCT 'DRUG:' || p AS drug, 'GENE:' || s AS gene FROM ixn JOIN part ON p = p_partkey")
def q_drug_to_gene(spark, d):
    return domain.drug_to_gene(chem(spark, d), ids(spark, d, "part", "DRUG", "p_partkey"))


@query(f"WITH {IXN} SELECT DISTINCT 'DIS:' || c AS disease, 'GENE:' || ixn.s AS gene FROM assoc JOIN ixn USING (p)")
def q_disease_to_gene(spark, d):
    return domain.disease_to_gene(chem(spark, d), ids(spark, d, "customer", "DIS", "c_custkey"))


DISEASE_GENES = f"""WITH {IXN}, a AS (SELECT DISTINCT c, p, pmids FROM assoc), g AS (SELECT DISTINCT p, s, other FROM said), w AS (SELECT DISTINCT c, s, pmids, other FROM a JOIN g USING (p)),
 e AS (SELECT DISTINCT c, s, unnest(string_split(pmids || '|' || other, '|')) AS id FROM w), t AS (SELECT c, s, string_agg(id, '|' ORDER BY id) AS pmids FROM e GROUP BY ALL)"""


@query(f"{DISEASE_GENES} SELECT c_name AS name, 'DIS:' || c AS disease, 'GENE:' || s AS gene, pmids FROM t JOIN customer ON c = c_custkey")
def q_disease_name_to_gene(spark, d):
    return domain.disease_name_to_gene(chem(spark, d), names_of(spark, d, "customer", "c_name"))


@query(f"{DISEASE_GENES} SELECT 'Customer' AS name, 'DIS:' || c AS disease, 'GENE:' || s AS gene, pmids FROM t")
def q_disease_name_to_gene_all(spark, d):
    """One name that every label contains."""
    return domain.disease_name_to_gene(chem(spark, d), names_of(spark, d, "customer", "c_name").select(F.substring_index("name", "#", 1).alias("name")))


@query(f"WITH {IXN} SELECT DISTINCT 'CHEM:' || p AS compound, 'DIS:' || c AS disease, p_name AS stressor_name FROM assoc JOIN part ON p = p_partkey")
def q_exposure_disease(spark, d):
    return domain.exposure_disease(chem(spark, d), ids(spark, d, "part", "CHEM", "p_partkey"), "^DIS:")


@query(f"WITH {IXN} SELECT DISTINCT c_name AS disease_name, p_name AS drug_name, path_name FROM assoc JOIN part ON p = p_partkey JOIN target USING (p) JOIN pathway USING (s) JOIN customer ON c = c_custkey")
def q_disease_drug_pathway(spark, d):
    return domain.disease_drug_pathway(chem(spark, d), names_of(spark, d, "customer", "c_name"))


@query("SELECT DISTINCT name, 'PTYPE:' || p_type AS category, p_type AS category_name FROM part JOIN (SELECT DISTINCT p_name AS name FROM part) ON contains(lower(p_name), lower(name))")
def q_broader_category(spark, d):
    broader = T(spark, d, "part").select(F.col("p_name").alias("label"), t.curie("PTYPE", "p_type").alias("category"), F.col("p_type").alias("category_name"))
    return domain.broader_category(broader, names_of(spark, d, "part", "p_name"))


@query("SELECT 'PART:' || p_partkey AS id, p_name AS name FROM part")
def q_term_label(spark, d):
    return patterns.lookup(ids(spark, d, "part", "PART", "p_partkey"), obo_of(spark, d)["terms"], "id")


@query("SELECT DISTINCT 'PART:' || l_partkey AS id, 'SUPP:' || l_suppkey AS part, s_name AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def q_anatomy_parts(spark, d):
    root = spark.createDataFrame([("ROOT:PLACE",)], "id string")
    return domain.parts_of(t.quads(spark, d), ontology.closure(t.is_a(spark, d)), "supplied_by", root)


@query("SELECT 'CUST:' || c_custkey AS id, 'REG:' || n_regionkey AS target, r_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'SUPP:' || s_suppkey, 'REG:' || n_regionkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'NAT:' || n_nationkey, 'REG:' || n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_cell_to_anatomy(spark, d):
    return domain.superclass_targets(t.quads(spark, d), t.is_a(spark, d), "in_region")


@query("SELECT 'CUST:' || c_custkey AS id, 'NAT:' || c_nationkey AS neighbor FROM customer")
def q_gene_anatomy(spark, d):
    e = t.quads(spark, d).where("p = 'has_nation'").select(F.col("s").alias("source_id"), F.col("o").alias("target_id"), F.col("p").alias("predicate"))
    return domain.one_hop(e, ids(spark, d, "customer", "CUST", "c_custkey"), "NAT", None)


@query("SELECT DISTINCT p_name AS name, 'DOID:' || p_size AS target_id FROM part")
def q_name_to_ids(spark, d):
    k = adapters.concepts(spark, d)
    return domain.name_to_ids(k, k.select("name"), "DOID")


@query("SELECT name, string_agg(a, ';' ORDER BY a) AS aliases FROM (SELECT p_name AS name, 'PART:' || p_partkey AS a FROM part UNION SELECT p_name, 'DOID:' || p_size FROM part) GROUP BY name")
def q_name_to_any_alias(spark, d):
    k = adapters.concepts(spark, d)
    return domain.name_to_any_alias(k, k.select("name"))


@query("SELECT DISTINCT p_name AS name, 'MESH.DISEASE:' || p_partkey AS target_id FROM part")
def q_name_to_mesh_disease(spark, d):
    k = adapters.concepts(spark, d)
    return domain.name_to_vocabulary(k, k.select("name"), "PART", "DOID", "MESH.DISEASE")


@query("SELECT DISTINCT p_type AS name, p_name AS chemical FROM part UNION SELECT DISTINCT p_name, p_name FROM part")
def q_ctd_name_to_chemical(spark, d):
    part = T(spark, d, "part")
    chemicals = part.groupBy(F.col("p_name").alias("name")).agg(F.collect_set(F.lower("p_type")).alias("synonyms"))
    names = part.select(F.col("p_name").alias("name")).union(part.select("p_type")).distinct()
    return domain.ctd_name_to_chemical(chemicals, names)


@query("SELECT 'PART:' || l_partkey AS chemical, 'SUPP:' || l_suppkey AS gene_id, l_returnflag || ';' || l_linestatus AS actions FROM lineitem WHERE l_linestatus = 'F'")
def q_ctd_chemical_to_gene(spark, d):
    li = T(spark, d, "lineitem").select(t.curie("PART", "l_partkey").alias("chemical"), t.curie("SUPP", "l_suppkey").alias("gene_id"), F.when(F.col("l_linestatus") == "F", "9606").otherwise("10090").alias("organism_id"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("actions"), F.lit("1|2").alias("pmids"))
    out = domain.ctd_chemical_to_gene(li, li.select("chemical"), "9606")
    return out.select("chemical", "gene_id", F.array_join("actions", ";").alias("actions"))


@query("SELECT DISTINCT 'ORD:' || l_orderkey AS id, s_name AS symbol FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'")
def q_drug_gene(spark, d):
    symbols = T(spark, d, "supplier").select(t.curie("SUPP", "s_suppkey").alias("refid"), F.col("s_name").alias("symbol"))
    return domain.linked_targets(adapters.records(spark, d), symbols)


@query("SELECT DISTINCT 'ORD:' || o_orderkey AS id, c_name AS symbol FROM orders JOIN customer ON o_custkey = c_custkey")
def q_disease_gene(spark, d):
    """Orders as a provider's disease records with a link to their customer as target."""
    link = F.struct(F.lit("Target").alias("kind"), t.curie("CUST", "o_custkey").alias("refid"))
    records = T(spark, d, "orders").select(t.curie("ORD", "o_orderkey").alias("id"), F.array(link).alias("links"))
    symbols = T(spark, d, "customer").select(t.curie("CUST", "c_custkey").alias("refid"), F.col("c_name").alias("symbol"))
    return domain.linked_targets(records, symbols)


@query("SELECT DISTINCT 'ORD:' || l_orderkey AS id, l_returnflag AS term FROM lineitem")
def q_target_disease(spark, d):
    return domain.target_terms(adapters.records(spark, d), "IDG Disease")


@query("SELECT DISTINCT 'PART:' || p_partkey AS id, 'UNIPROTKB:' || word AS target_id, 'synonym' AS predicate FROM part, unnest(string_split(p_name, ' ')) AS u(word)")
def q_gene_synonym(spark, d):
    genes = T(spark, d, "part").select(t.curie("PART", "p_partkey").alias("id"), F.array_distinct(F.split("p_name", " ")).alias("uniprot_ids"))
    return domain.gene_synonyms(genes, genes.select("id"))


@query("SELECT 'ORD:' || l_orderkey AS id, 'PART:' || l_partkey AS target_id, 'has_part' AS predicate, l_returnflag AS relation FROM lineitem")
def q_gene_disease(spark, d):
    return domain.associations(adapters.association_records(spark, d), "has_part").drop("pmids")


@query("SELECT 'ORD:' || l_orderkey AS id, 'GO:' || l_partkey AS target_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT p_brand, arg_min(p_type, p_partkey) AS t FROM part GROUP BY p_brand) b USING (p_brand) WHERE t = (SELECT min(p_type) FROM part)")
def q_gene_function(spark, d):
    root = T(spark, d, "part").agg(t.curie("PTYPE", F.min("p_type")).alias("id"))
    edges = domain.associations(adapters.association_records(spark, d), "has_part").select("id", "target_id")
    return domain.associations_below(edges, ontology.closure(t.is_a(spark, d)), root, "PART", "GO").select("id", "target_id")


@query("SELECT 'ORD:' || l_orderkey AS id, 'PART:' || l_partkey AS target_id, 'disease_to_phenotype' AS predicate, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS n_pmids FROM lineitem")
def q_disease_phenotype(spark, d):
    """Associations with the number of their PMID publications; null publications are none."""
    out = domain.associations(adapters.association_records(spark, d), "disease_to_phenotype")
    return out.select("id", "target_id", "predicate", F.size("pmids").alias("n_pmids"))


@query("SELECT 'ORD:' || l_orderkey AS id, 'GO:' || l_partkey AS target_id FROM lineitem JOIN part ON l_partkey = p_partkey")
def q_gene_go(spark, d):
    """Associations below the root of all parts."""
    edges = domain.associations(adapters.association_records(spark, d), "has_part").select("id", "target_id")
    root = spark.range(1).select(F.lit("ROOT:PART").alias("id"))
    return domain.associations_below(edges, ontology.closure(t.is_a(spark, d)), root, "PART", "GO").select("id", "target_id")


TYPED_PARTS = "SELECT p_partkey AS k, t FROM part JOIN (SELECT p_brand, arg_min(p_type, p_partkey) AS t FROM part GROUP BY p_brand) b USING (p_brand)"


@query(f"WITH p AS ({TYPED_PARTS}) SELECT 'ORD:' || l_orderkey AS id, 'GO:' || l_partkey AS target_id FROM lineitem JOIN p ON l_partkey = k WHERE t = (SELECT max(p_type) FROM part)")
def q_gene_process(spark, d):
    root = T(spark, d, "part").agg(t.curie("PTYPE", F.max("p_type")).alias("id"))
    edges = domain.associations(adapters.association_records(spark, d), "has_part").select("id", "target_id")
    return domain.associations_below(edges, ontology.closure(t.is_a(spark, d)), root, "PART", "GO").select("id", "target_id")


@query(f"WITH p AS ({TYPED_PARTS}) SELECT DISTINCT 'ORD:' || l_orderkey AS id, 'PART:' || l_partkey AS target_id, 'PTYPE:' || t || ';ROOT:PART' AS matched FROM lineitem JOIN p ON l_partkey = k WHERE t = (SELECT max(p_type) FROM part) UNION SELECT DISTINCT 'ORD:' || l_orderkey, 'PART:' || l_partkey, 'ROOT:PART' FROM lineitem JOIN p ON l_partkey = k WHERE t <> (SELECT max(p_type) FROM part)")
def q_gene_genetic_condition(spark, d):
    roots = T(spark, d, "part").agg(t.curie("PTYPE", F.max("p_type")).alias("id")).union(spark.range(1).select(F.lit("ROOT:PART")))
    edges = domain.associations(adapters.association_records(spark, d), "has_part")
    return domain.roots_above(edges, ontology.closure(t.is_a(spark, d)), roots).withColumn("matched", F.array_join("matched", ";"))


@query("SELECT DISTINCT 'MSH:' || p_partkey AS id, 'ORPHANET:' || p_partkey AS target_id FROM part UNION SELECT 'PART:' || p_partkey, 'ORPHANET:' || p_partkey FROM part")
def q_disease_genetic_condition(spark, d):
    terms = ids(spark, d, "part", "PART", "p_partkey")
    xrefs = T(spark, d, "part").select(t.curie("PART", "p_partkey").alias("id"), t.curie("MSH", "p_partkey").alias("xref"))
    every = terms.union(xrefs.select("xref"))
    root = spark.range(1).select(F.lit("ROOT:PART").alias("id"))
    return domain.genetic_conditions(every, terms, xrefs, ontology.closure(t.is_a(spark, d)), root, "PART", "ORPHANET")


@query("SELECT DISTINCT 'ORD:' || l_orderkey AS id, 'SUPP:' || l_suppkey AS target_id FROM lineitem WHERE l_linestatus = 'F'")
def q_go_annotation_cells(spark, d):
    x = F.struct(F.lit("SUPP").alias("db"), F.col("l_suppkey").cast("string").alias("id")), F.struct(F.lit("PART").alias("db"), F.col("l_partkey").cast("string").alias("id"))
    rows = T(spark, d, "lineitem").groupBy(t.curie("ORD", "l_orderkey").alias("id"), F.col("l_linestatus").alias("taxon")).agg(F.collect_list(F.struct(F.array(*x).alias("xrefs"))).alias("extensions"))
    return domain.annotation_cells(rows, "SUPP", "F")


@query("SELECT 'PART:' || p_partkey AS id, 'MESH:' || p_partkey AS target_id FROM part")
def q_doid_to_mesh(spark, d):
    xrefs = T(spark, d, "part").select(t.curie("PART", "p_partkey").alias("id"), t.curie("MSH", "p_partkey").alias("xref"))
    rows = patterns.lookup(ids(spark, d, "part", "PART", "p_partkey"), xrefs.where(filters.with_prefix(F.col("xref"), "MSH")), "id")
    return rows.select("id", c.rewrite_prefix(F.col("xref"), "MSH", "MESH").alias("target_id"))


@query("SELECT 'MESH:' || p_partkey AS id, 'PART:' || p_partkey AS target_id FROM part")
def q_mesh_to_phenotype(spark, d):
    """The other way: terms that cross-reference an identifier under the vocabulary's own prefix."""
    xrefs = T(spark, d, "part").select(t.curie("MSH", "p_partkey").alias("key"), t.curie("PART", "p_partkey").alias("target_id"))
    asked = T(spark, d, "part").select(t.curie("MESH", "p_partkey").alias("id")).withColumn("key", c.rewrite_prefix(F.col("id"), "MESH", "MSH"))
    return patterns.lookup(asked, xrefs, "key").select("id", "target_id")


@query("""WITH own AS (SELECT 'ORD:' || o_orderkey AS id, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT 'CUST:' || c_custkey, c_nationkey FROM customer)
SELECT id, 'NAT:' || n AS target, n_name AS label FROM own JOIN nation ON n = n_nationkey UNION SELECT id, 'REG:' || n_regionkey, r_name FROM own JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q_phenotype_to_anatomy(spark, d):
    """Orders under customers; nations have their regions as parts; what another graph says of customers does not count."""
    below = T(spark, d, "orders").select(t.curie("ORD", "o_orderkey").alias("child"), t.curie("CUST", "o_custkey").alias("parent"))
    q, root = t.quads(spark, d), spark.range(1).select(F.lit("ROOT:PLACE").alias("id"))
    other = q.where("p = 'has_nation'").select(F.lit("redundant").alias("g"), "s", "p", F.lit("NAT:0").alias("o"))
    return domain.phenotype_to_anatomy(q.unionByName(other), below.union(t.is_a(spark, d)), "has_nation", "in_region", root, "customer")


def place_edges(spark, d):
    return t.quads(spark, d).where(F.col("p").isin("has_nation", "in_nation", "in_region")).select(F.col("s").alias("source_id"), F.col("o").alias("target_id"), F.col("p").alias("predicate"))


@query("SELECT 'NAT:' || c_nationkey AS id, 'CUST:' || c_custkey AS neighbor FROM customer")
def q_disease_symptom(spark, d):
    return domain.one_hop(place_edges(spark, d), ids(spark, d, "nation", "NAT", "n_nationkey"), "CUST")


@query("SELECT 'SUPP:' || s_suppkey AS id, 'NAT:' || s_nationkey AS neighbor FROM supplier")
def q_gene_cell_component(spark, d):
    return domain.one_hop(place_edges(spark, d), ids(spark, d, "supplier", "SUPP", "s_suppkey"), "NAT", 200)


@query("SELECT 'SUPP:' || s_suppkey AS id, 'NAT:' || s_nationkey AS neighbor FROM supplier")
def q_gene_disease_hetio(spark, d):
    """Customers and suppliers are asked, suppliers alone are of an admitted vocabulary."""
    nodes = ids(spark, d, "supplier", "SUPP", "s_suppkey").unionByName(ids(spark, d, "customer", "CUST", "c_custkey"))
    return domain.one_hop_of(place_edges(spark, d), nodes, "NAT", ["SUPP", "HGNC"])


@query("SELECT 'rejected' AS state, 'SUPP' AS src_type, 'NAT' AS dst_type UNION ALL SELECT 'rejected', 'PART', 'SUPP' UNION ALL SELECT 'usable', * FROM (VALUES ('CUST', 'NAT'), ('ORD', 'CUST'), ('ORD', 'PART'), ('NAT', 'REG')) v")
def scan_type_config(spark, d):
    moves = typegraph.transitions_of(t.quads(spark, d))
    known = moves.select(F.col("src_type").alias("type")).union(moves.select("dst_type")).where("type != 'SUPP'")
    good, bad = typegraph.load_type_graph(moves, known)
    return good.select(F.lit("usable").alias("state"), "src_type", "dst_type").unionByName(bad.select(F.lit("rejected").alias("state"), "src_type", "dst_type"))


@query("SELECT DISTINCT 'ORD:' || l_orderkey AS id, 'SUPP:' || l_suppkey AS target_id, l_returnflag AS predicate FROM lineitem")
def q_go_cell_relations(spark, d):
    rel = T(spark, d, "lineitem").groupBy(t.curie("ORD", "l_orderkey").alias("id"), F.col("l_returnflag").alias("relation")).agg(F.flatten(F.collect_list(F.array(t.curie("SUPP", "l_suppkey"), t.curie("PART", "l_partkey")))).alias("targets"))
    nested = rel.groupBy("id").agg(F.collect_list(F.struct("relation", "targets")).alias("relations"))
    return domain.cross_ontology(nested, "SUPP")


@query("SELECT DISTINCT p_partkey AS key, upper(trim(word)) AS id FROM part, unnest(string_split(p_brand || ',' || p_type, ',')) AS u(word)")
def q_id_to_provider_id(spark, d):
    rows = T(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat_ws(",", "p_brand", "p_type").alias("list"))
    return domain.split_ids(rows, "list")


@query("SELECT 'PART:' || p_partkey AS id, 'BRAND:' || regexp_replace(p_brand, '\\s', '_', 'g') AS xref FROM part")
def q_xrefs_by_prefix(spark, d):
    x = obo_of(spark, d)["xrefs"]
    return ids(spark, d, "part", "PART", "p_partkey").join(x, "id").where(filters.with_prefix(F.col("xref"), "BRAND"))


@query(f"""WITH {MAPPINGS}, ids AS (SELECT DISTINCT a AS id FROM e), f AS (
 SELECT id, id AS resolved FROM ids WHERE id LIKE 'SUPP:%' UNION SELECT id, b FROM ids JOIN e ON id = a WHERE id NOT LIKE 'SUPP:%')
SELECT DISTINCT id, resolved FROM f""")
def q_id_to_doid(spark, d):
    m = written(t.mappings(spark, d), scratch(spark))
    every = m.select(F.col("from_curie").alias("id")).union(m.select("to_curie")).distinct()
    terms = m.select(F.col("to_curie").alias("id")).distinct()
    return ontology.ids_to_vocabulary(every, terms, m.select(F.col("from_curie").alias("id"), F.col("to_curie").alias("xref")), "SUPP")


@query("SELECT DISTINCT upper(p_name) AS name, 'PART:' || p_partkey AS id FROM part UNION SELECT DISTINCT b || ', ' || a, 'PART:' || p_partkey FROM (SELECT *, split_part(p_name, ' ', 1) AS a, array_to_string(list_slice(string_split(p_name, ' '), 2, 99), ' ') AS b FROM part) WHERE b <> ''")
def q_name_search(spark, d):
    part = T(spark, d, "part")
    terms = part.select(t.curie("PART", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    swapped = part.where("p_name like '% %'").select(F.concat(F.expr("substring(p_name, instr(p_name, ' ') + 1)"), F.lit(", "), F.substring_index("p_name", " ", 1)))
    names = part.select(F.upper("p_name").alias("name")).union(swapped).distinct()
    return ontology.name_search(names, terms, terms.select("id", F.lit("none").alias("synonym")))


@query("SELECT DISTINCT lower(word) AS name, 'PART:' || p_partkey AS id FROM part, unnest(string_split(p_name, ' ')) AS u(word)")
def q_name_substring_search(spark, d):
    terms = T(spark, d, "part").select(t.curie("PART", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    names = terms.select(F.explode(F.split(F.lower("name"), " ")).alias("name")).distinct()
    return ontology.name_search(names, terms, terms.select("id", F.lit("").alias("synonym")).where("false"), substring=True)


# graphs, paths, translation


@query(f"{CLOSURE} SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY ALL")
def transitive_closure(spark, d):
    return ontology.closure(t.is_a(spark, d))


@query(f"{CLOSURE} SELECT ancestor AS root, id FROM up WHERE ancestor IN ('ROOT:PART', 'ROOT:PLACE')")
def descendants(spark, d):
    return ontology.descendants(t.is_a(spark, d), spark.createDataFrame([("ROOT:PART",), ("ROOT:PLACE",)], "id string"))


@query("SELECT 'SUPP:' || s_suppkey AS id, 'REG:' || n_regionkey AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'CUST:' || c_custkey, 'REG:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'NAT:' || n_nationkey, 'REG:' || n_regionkey FROM nation")
def property_path(spark, d):
    e = t.quads(spark, d).where("p = 'in_region'").select(F.col("s").alias("source_id"), F.col("o").alias("target_id"))
    return ontology.property_path(ontology.closure(t.is_a(spark, d), reflexive=True), e)


@query(f"""WITH {MAPPINGS}, one AS (SELECT a AS q, b AS c, string_agg(DISTINCT f, ';' ORDER BY f) AS s FROM e WHERE a LIKE 'SUPP:%' GROUP BY ALL),
 two AS (SELECT x.q, e.b AS c, string_agg(DISTINCT e.f, ';' ORDER BY e.f) AS s FROM one x JOIN e ON x.c = e.a WHERE x.q <> e.b AND NOT EXISTS (SELECT 1 FROM one WHERE one.q = x.q AND one.c = e.b) GROUP BY ALL)
SELECT q AS query_id, c AS curie, 1 AS distance, s AS source_prefixes FROM one UNION ALL SELECT q, c, 2, s FROM two""")
def khop_synonyms(spark, d):
    """What every supplier is a synonym of: its parts, and the suppliers of those."""
    return ontology.khop(t.mappings(spark, d, once=False), 2, ids(spark, d, "supplier", "SUPP", "s_suppkey")).withColumn("source_prefixes", F.array_join("source_prefixes", ";"))


@query(f"""WITH {MAPPINGS}, one AS (SELECT DISTINCT a AS q, b AS c FROM e), two AS (SELECT DISTINCT x.q, y.c FROM one x JOIN one y ON x.c = y.q WHERE x.q <> y.c EXCEPT SELECT q, c FROM one),
 found AS (SELECT q, c, 1 AS d FROM one UNION ALL SELECT q, c, 2 FROM two), p AS (SELECT *, min(d) OVER (PARTITION BY q) AS least FROM found WHERE c LIKE 'SUPP:%')
SELECT q AS query_id, c AS curie, d AS distance FROM p WHERE d = least""")
def khop_expanding(spark, d):
    return ontology.khop_expanding(t.mappings(spark, d, once=False), "SUPP", 2).select("query_id", "curie", "distance")


@query("SELECT DISTINCT p_brand AS prefix FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT 'MESH'")
def valid_prefixes(spark, d):
    sources = T(spark, d, "part").groupBy(F.col("p_brand").alias("prefix")).agg(F.collect_set("p_type").alias("alternates"))
    return ontology.valid_prefixes(sources)


@query("SELECT 'usable' AS state, 'CUST' AS src_type, 'has_nation' AS link UNION ALL SELECT 'usable', 'ORD', 'ordered_by' UNION ALL SELECT 'usable', 'ORD', 'has_part' UNION ALL SELECT 'usable', 'PART', 'supplied_by' UNION ALL SELECT 'usable', 'NAT', 'in_region'")
def filter_enabled_edges(spark, d):
    """The graph's transitions, of which that of suppliers is switched off."""
    moves = typegraph.transitions_of(t.quads(spark, d)).withColumn("link", F.when(F.col("src_type") == "SUPP", "UNKNOWN").otherwise(F.col("link")))
    return filters.enabled(moves).select(F.lit("usable").alias("state"), "src_type", "link")


MOVES = "moves AS (SELECT * FROM (VALUES ('CUST','NAT','has_nation'),('ORD','CUST','ordered_by'),('ORD','PART','has_part'),('PART','SUPP','supplied_by'),('SUPP','NAT','in_nation'),('NAT','REG','in_region')) v(a, b, l))"


@query(f"""WITH RECURSIVE {MOVES}, p AS (SELECT b AS dst, 1 AS hops, 'ORD>' || b AS types, l AS links FROM moves WHERE a = 'ORD'
 UNION ALL SELECT b, hops + 1, types || '>' || b, links || '>' || l FROM p JOIN moves ON dst = a WHERE hops < 8), s AS (SELECT *, min(hops) OVER (PARTITION BY dst) AS least FROM p)
SELECT dst AS dst_type, CAST(hops AS INTEGER) AS hops, types, links FROM s WHERE hops = least""")
def shortest_paths_all(spark, d):
    moves = typegraph.transitions_of(t.quads(spark, d))
    out = typegraph.shortest_paths(moves, "ORD", moves.select("dst_type"))
    return out.select("dst_type", F.col("hops").cast("int").alias("hops"), F.array_join("types", ">").alias("types"), F.array_join("links", ">").alias("links"))


@query(f"""WITH RECURSIVE {MOVES}, p AS (SELECT b AS dst, 1 AS hops, l AS links FROM moves WHERE a = 'ORD'
 UNION ALL SELECT b, hops + 1, links || '>' || l FROM p JOIN moves ON dst = a WHERE hops < 100) SELECT dst AS dst_type, links FROM p""")
def path_enumerate(spark, d):
    out = typegraph.paths(typegraph.transitions_of(t.quads(spark, d)), "ORD")
    return out.select("dst_type", F.array_join("links", ">").alias("links"))


@query(f"""WITH RECURSIVE {MOVES}, p AS (SELECT b AS dst, 1 AS hops FROM moves WHERE a = 'ORD' UNION ALL SELECT b, hops + 1 FROM p JOIN moves ON dst = a WHERE hops < 8), s AS (SELECT *, min(hops) OVER (PARTITION BY dst) AS least FROM p)
SELECT 'ORD' AS node, 0 AS level, 1 AS paths UNION ALL SELECT dst, CAST(hops AS INTEGER), count(*) FROM s WHERE hops = least GROUP BY ALL""")
def shortest_path_counts(spark, d):
    moves = typegraph.transitions_of(t.quads(spark, d))
    return typegraph.path_counts(typegraph.predecessors(moves, "ORD"), "ORD").withColumn("paths", F.col("paths").cast("long"))


@query("SELECT * FROM (VALUES ('REG', 0, 'ORD', 'ordered_by'), ('REG', 1, 'CUST', 'has_nation'), ('REG', 2, 'NAT', 'in_region')) v(dst_type, level, node_type, ops)")
def compile_program(spark, d):
    moves = typegraph.transitions_of(t.quads(spark, d))
    return typegraph.program_of(moves, "ORD", moves.where("dst_type = 'REG'").select("dst_type")).withColumn("ops", F.array_join("ops", ";"))


@query("SELECT * FROM (VALUES ('REG', 0, 'ORD', 'ordered_by', 'ordered_by:bought;ordered_by:ord__ordered_by__cust'), ('REG', 1, 'CUST', 'has_nation', 'has_nation:bought;has_nation:cust__has_nation__nat'), ('REG', 2, 'NAT', 'in_region', 'in_region:bought;in_region:nat__in_region__reg')) v(dst_type, level, node_type, ops, names)")
def compile_program_names(spark, d):
    """Two operations of each link: both are named."""
    moves = typegraph.transitions_of(t.quads(spark, d))
    moves = moves.unionByName(moves.withColumn("op", F.lit("bought")))
    program = typegraph.program_of(moves, "ORD", moves.where("dst_type = 'REG'").select("dst_type"), named=True)
    return program.withColumns({"ops": F.array_join("ops", ";"), "names": F.array_join("names", ";")})


EXECUTED = """SELECT 0 AS level, 'ORD:' || o_orderkey AS source_id, 'ordered_by' AS predicate, 'CUST:' || o_custkey AS target_id, true AS type_ok FROM orders
UNION SELECT 1, 'CUST:' || c_custkey, 'has_nation', 'NAT:' || c_nationkey, true FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION SELECT 2, 'NAT:' || n_nationkey, 'in_region', 'REG:' || n_regionkey, true FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"""


@query(EXECUTED)
def execute_program(spark, d):
    q = t.quads(spark, d)
    moves = typegraph.transitions_of(q)
    program = typegraph.program_of(moves, "ORD", moves.where("dst_type = 'REG'").select("dst_type"))
    return typegraph.execute_program(program, ids(spark, d, "orders", "ORD", "o_orderkey"), q)


@query("SELECT DISTINCT CAST(0 AS INTEGER) AS level, 'ORD:' || l_orderkey AS source_id, 'has_part' AS predicate, 'PART:' || l_partkey AS target_id, false AS type_ok FROM lineitem UNION SELECT 0, 'ORD:' || o_orderkey, 'ordered_by', 'CUST:' || o_custkey, true FROM orders UNION SELECT 1, 'CUST:' || c_custkey, 'has_nation', 'NAT:' || c_nationkey, true FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def type_check_targets(spark, d):
    """A program whose first level also follows an edge to another type than its next one has."""
    program = spark.createDataFrame([(0, "ORD", ["has_part", "ordered_by"]), (1, "CUST", ["has_nation"])], "level int, node_type string, ops array<string>")
    return typegraph.execute_program(program, ids(spark, d, "orders", "ORD", "o_orderkey"), t.quads(spark, d))


@query("""WITH da AS (SELECT 'DA:' || o_orderkey AS da, 'DIS:' || o_custkey AS dis FROM orders), dc AS (SELECT DISTINCT 'DA:' || l_orderkey AS da, 'CHEM:' || l_partkey AS chem FROM lineitem),
 xc AS (SELECT 'IXN:.' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS ixn, 'CHEM:' || l_partkey AS chem, 'GENE:' || l_suppkey AS gene FROM lineitem),
 n AS (SELECT 'NAME.DISEASE:' || c_name AS source_id, 'names' AS predicate, 'DIS:' || c_custkey AS target_id FROM customer), chems AS (SELECT DISTINCT chem FROM dc JOIN da USING (da)),
 r AS (SELECT 'disease_condition' AS program, 0 AS level, * FROM n
 UNION SELECT 'disease_condition', 1, 'DIS:' || c_custkey, 'xref', 'DOID:' || c_nationkey FROM customer UNION SELECT 'disease_condition', 2, 'DOID:' || n_nationkey, 'is_condition', 'ORPHANET:' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
 UNION SELECT 'disease_gene', 0, * FROM n UNION SELECT 'disease_gene', 1, dis, 'inv_ctd:disease', da FROM da WHERE dis IN (SELECT target_id FROM n)
 UNION SELECT 'disease_gene', 2, da, 'ctd:cid', chem FROM dc JOIN da USING (da)
 UNION SELECT 'disease_gene', 3, chem, 'inv_ctd:cid', ixn FROM xc WHERE chem IN (SELECT chem FROM chems) UNION SELECT 'disease_gene', 3, chem, 'inv_ctd:cid', da FROM dc WHERE chem IN (SELECT chem FROM chems)
 UNION SELECT 'disease_gene', 4, ixn, 'ctd:gene', gene FROM xc WHERE chem IN (SELECT chem FROM chems)
 UNION SELECT 'drug_pathway', 0, 'NAME.DRUG:' || p_name, 'names', 'DRUG:' || p_partkey FROM part UNION SELECT 'drug_pathway', 1, 'DRUG:' || l_partkey, 'drugbank:target', 'GENE:' || l_suppkey FROM lineitem
 UNION SELECT 'drug_pathway', 2, 'GENE:' || s_suppkey, 'pharmgkb:uniprot', 'UNI:' || s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)
 UNION SELECT 'drug_pathway', 3, 'UNI:' || s_suppkey, 'kegg:path', 'PATH:' || s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))
SELECT program, CAST(level AS INTEGER) AS level, source_id, predicate, target_id, NOT (program = 'disease_gene' AND level = 3 AND target_id LIKE 'DA:%') AS type_ok FROM r""")
def clinical_outcome_pathway(spark, d):
    """From all names; the two programs of diseases share their first level."""
    q = adapters.outcome_quads(spark, d)
    drugs, diseases = (names_of(spark, d, n, column).select(t.curie(kind, "name").alias("id")) for n, column, kind in (("part", "p_name", "NAME.DRUG"), ("customer", "c_name", "NAME.DISEASE")))
    return domain.clinical_outcome_pathway(q, drugs, diseases)


@query("SELECT DISTINCT prefix AS type, CASE WHEN prefix IN ('NAT', 'REG') THEN 'Place' WHEN prefix IN ('CUST', 'SUPP') THEN 'Party' ELSE 'Thing' END AS concept FROM (VALUES ('CUST'), ('ORD'), ('PART'), ('SUPP'), ('NAT'), ('REG')) v(prefix)")
def assign_is_a(spark, d):
    types, concepts = type_concepts(spark, d)
    return typegraph.assign_is_a(types, concepts)


def type_concepts(spark, d):
    moves = typegraph.transitions_of(t.quads(spark, d))
    types = moves.select(F.col("src_type").alias("type")).union(moves.select("dst_type")).distinct()
    concept = F.when(F.col("type").isin("NAT", "REG"), "Place").when(F.col("type").isin("CUST", "SUPP"), "Party").otherwise("Thing")
    first = types.select("type", F.lit("Other").alias("concept"), F.lit(0).alias("position"))
    return types, first.unionByName(types.select("type", concept.alias("concept"), F.lit(1).alias("position")))


@query("SELECT * FROM (VALUES ('Party', 'Place'), ('Thing', 'Party'), ('Thing', 'Thing'), ('Place', 'Place')) v(src_concept, dst_concept)")
def lift_to_concepts(spark, d):
    types, concepts = type_concepts(spark, d)
    return typegraph.lift_to_concepts(typegraph.transitions_of(t.quads(spark, d)), typegraph.assign_is_a(types, concepts))


@query("SELECT * FROM (VALUES ('CUST', 'NAT'), ('CUST', 'REG'), ('SUPP', 'NAT'), ('SUPP', 'REG')) v(type_a, type_b)")
def type_matrix(spark, d):
    return typegraph.type_pairs(typegraph.assign_is_a(*type_concepts(spark, d)), "Party", "Place")


@query("SELECT 'CUST:' || c_custkey AS id, 'CUST' AS type FROM customer UNION ALL SELECT c_name, v.t FROM customer, (VALUES ('CUST'), ('SUPP')) v(t)")
def map_concept_types(spark, d):
    customer = T(spark, d, "customer")
    nodes = customer.select(t.curie("CUST", "c_custkey").alias("id"), F.lit("Place").alias("concept")).union(customer.select("c_name", F.lit("Party")))
    return typegraph.candidate_types(nodes, typegraph.assign_is_a(*type_concepts(spark, d)))


@query("SELECT 'CUST:' || c_custkey AS id, 'CLIENT' AS type_a, 'NAT' AS type_b, 'cust__has_nation__nat' AS op FROM customer UNION ALL SELECT 'SUPP:' || s_suppkey, 'SUPP', 'ORD', NULL FROM supplier")
def route_translation(spark, d):
    moves = typegraph.transitions_of(t.quads(spark, d))
    requests = ids(spark, d, "customer", "CUST", "c_custkey").withColumns({"type_a": F.lit("CLIENT"), "type_b": F.lit("NAT")}).union(ids(spark, d, "supplier", "SUPP", "s_suppkey").withColumns({"type_a": F.lit("SUPP"), "type_b": F.lit("ORD")}))
    router = moves.select(F.col("src_type").alias("type_a"), F.col("dst_type").alias("type_b"), "op")
    return typegraph.route(requests, router, spark.createDataFrame([("CLIENT", "CUST")], "id string, equivalent_id string")).select("id", "type_a", "type_b", "op")


@query("SELECT 'ORD:' || o_orderkey AS id, 'REG:' || n_regionkey AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def translate(spark, d):
    return typegraph.translate(ids(spark, d, "orders", "ORD", "o_orderkey"), t.quads(spark, d), "ORD", "REG")


@query("""WITH a AS (SELECT 'ORD:' || l_orderkey AS id, 'PART:' || l_partkey AS value FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY id ORDER BY value) <= 2),
 b AS (SELECT DISTINCT 'PART:' || l_partkey AS id, 'SUPP:' || l_suppkey AS value FROM lineitem WHERE 'PART:' || l_partkey IN (SELECT value FROM a)), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY value) <= 2)
SELECT 'PART' AS kind, * FROM a UNION ALL SELECT 'SUPP', * FROM c""")
def translate_chain(spark, d):
    return typegraph.translate_chain(ids(spark, d, "orders", "ORD", "o_orderkey"), t.quads(spark, d), ["ORD", "PART", "SUPP"], 2)


@query("""WITH a AS (SELECT DISTINCT 'SUPP:' || s_suppkey AS id, 'NAT:' || s_nationkey AS nat, 'REG:' || n_regionkey AS reg FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'SUPP' AS src_kind, 'NAT' AS dst_kind, id, nat AS value FROM a UNION ALL SELECT 'SUPP', 'REG', id, reg FROM a UNION ALL SELECT 'NAT', 'REG', 'NAT:' || n_nationkey, 'REG:' || n_regionkey FROM nation""")
def translate_all(spark, d):
    bound = {"SUPP": ids(spark, d, "supplier", "SUPP", "s_suppkey"), "NAT": ids(spark, d, "nation", "NAT", "n_nationkey")}
    return typegraph.translate_all(bound, t.quads(spark, d), ["SUPP", "NAT", "REG"])


@query("""WITH r AS (SELECT 'CUST:' || c_custkey AS id, 'NAT:' || c_nationkey AS nat, c_mktsegment AS m, c_name AS n FROM customer), k AS (SELECT *, min(id) OVER (PARTITION BY nat) AS representative FROM r)
SELECT representative, 'segments' AS key, 'set' AS kind, string_agg(DISTINCT m, ';' ORDER BY m) AS values FROM k GROUP BY representative
UNION ALL SELECT representative, 'names', 'list', string_agg(n, ';' ORDER BY id) FROM k GROUP BY representative""")
def merge_properties(spark, d):
    """Customers of one nation as synonyms: sets unite, lists follow the ids, and a key of mixed kinds is left out."""
    customer = T(spark, d, "customer").select(t.curie("CUST", "c_custkey").alias("id"), t.curie("NAT", "c_nationkey").alias("nat"), "c_mktsegment", "c_name", "c_custkey")
    kinds = [("segments", F.lit("set"), "c_mktsegment"), ("names", F.lit("list"), "c_name"), ("mixed", F.when(F.col("id") == F.col("first"), "list").otherwise("scalar"), "c_name")]
    low = customer.groupBy("nat").agg(F.min("id").alias("first"))
    rows = customer.join(low, "nat")
    properties = None
    for key, kind, column in kinds:
        one = rows.select("id", F.lit(key).alias("key"), kind.alias("kind"), F.array(column).alias("values"))
        properties = one if properties is None else properties.unionByName(one)
    good, _ = patterns.merge_properties(properties, rows.select(F.col("id").alias("a"), F.col("first").alias("b")))
    return good.where("key != 'mixed'").withColumn("values", F.array_join("values", ";"))


@query(f"""WITH RECURSIVE {IS_A}, n AS (SELECT 'CUST:' || c_custkey AS id, c_name AS label, 'NAT:' || c_nationkey AS rep FROM customer)
SELECT least(rep, min(id)) AS representative, count(*) AS n_labels FROM n GROUP BY rep""")
def merge_synonyms(spark, d):
    nodes = T(spark, d, "customer").select(t.curie("CUST", "c_custkey").alias("id"), F.col("c_name").alias("label"))
    links = T(spark, d, "customer").select(t.curie("CUST", "c_custkey").alias("a"), t.curie("NAT", "c_nationkey").alias("b"))
    return patterns.merge_synonyms(nodes, links).select("representative", F.size("labels").cast("long").alias("n_labels"))


@query("SELECT 'CUST:' || c_custkey AS id, 'CUST:' || min(c_custkey || '') OVER (PARTITION BY n_regionkey) AS representative FROM customer JOIN nation ON c_nationkey = n_nationkey")
def merge_synonyms_incremental(spark, d):
    """Customers linked by nation, and by a later version with their nations' regions."""
    customer, nation = T(spark, d, "customer"), T(spark, d, "nation")
    labels = ontology.reachable_min(customer.select(t.curie("CUST", "c_custkey").alias("a"), t.curie("NAT", "c_nationkey").alias("b")))
    version = patterns.extended(labels, nation.select(t.curie("NAT", "n_nationkey").alias("a"), t.curie("REG", "n_regionkey").alias("b")))
    return patterns.renamed(labels, [version]).where(filters.with_prefix(F.col("id"), "CUST"))


@query("SELECT 'SUPP:' || s_suppkey AS source_id, 'in_nation' AS predicate, 'NAT:' || s_nationkey AS target_id FROM supplier")
def op_registry(spark, d):
    q, r = t.quads(spark, d), typegraph.Registry()
    r.register_table(typegraph.transitions_of(q), q)
    return r["supp__in_nation__nat"](ids(spark, d, "supplier", "SUPP", "s_suppkey"))


@query("""SELECT 0 AS level, 'ord__ordered_by__cust' AS op, 'ORD:' || o_orderkey AS source_id, 'ordered_by' AS predicate, 'CUST:' || o_custkey AS target_id, true AS type_ok FROM orders
UNION SELECT 1, 'cust__has_nation__nat', 'CUST:' || c_custkey, 'has_nation', 'NAT:' || c_nationkey, true FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION SELECT 2, 'nat__in_region__reg', 'NAT:' || n_nationkey, 'in_region', 'REG:' || n_regionkey, true FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))""")
def execute_registered(spark, d):
    """The program from orders to regions by the functions that a registry holds."""
    q, r = t.quads(spark, d), typegraph.Registry()
    moves = typegraph.transitions_of(q)
    r.register_table(moves, q)
    return r.execute(typegraph.program_of(moves, "ORD", moves.where("dst_type = 'REG'").select("dst_type"), named=True), ids(spark, d, "orders", "ORD", "o_orderkey"))


# aggregates, limits, similarity


@query("SELECT p_brand, string_agg(p_name, ';' ORDER BY p_name) AS values FROM part GROUP BY p_brand")
def agg_multimap(spark, d):
    return measures.multimap(T(spark, d, "part"), "p_brand", "p_name").withColumn("values", F.array_join("values", ";"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def agg_last_wins(spark, d):
    return measures.last_per_key(T(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def agg_distinct(spark, d):
    return T(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS actions FROM lineitem GROUP BY l_suppkey")
def agg_set_union(spark, d):
    rows = T(spark, d, "lineitem").select("l_suppkey", F.array("l_returnflag").alias("a"))
    return measures.collect_actions(rows, "l_suppkey", "a").withColumn("actions", F.array_join("actions", ";"))


@query("SELECT o_custkey, string_agg(o_orderkey || '', ';' ORDER BY o_orderkey || '') AS joined FROM orders GROUP BY o_custkey")
def agg_string_join(spark, d):
    return measures.join_values(T(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("WITH n AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) SELECT count(*) AS total, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_hit, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS without_hit, CAST(sum(n) AS BIGINT) AS hits, round(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM n")
def agg_coverage(spark, d):
    return measures.coverage(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


def bucket_sql(interval: str, f: str) -> str:
    return f"SELECT event_type AS exposure_type, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS bucket, round({f}(value), 6) AS value FROM events GROUP BY ALL"


def bucketed(spark, d, resolution, aggregation):
    return measures.time_buckets(t.exposures(spark, d), resolution, aggregation).withColumn("value", F.round("value", 6))


@query(" UNION ALL ".join(f"SELECT event_type AS exposure_type, '{name}' AS resolution, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS bucket, round(avg(value), 6) AS avg, max(value) AS max FROM events GROUP BY ALL" for name, interval in (("hour", "1 hour"), ("day", "1 day"), ("7day", "7 days"), ("14day", "14 days"))))
def agg_time_bucket_all(spark, d):
    """All resolutions and both aggregations from one reading of the events."""
    return measures.rolled_up(measures.partials(t.exposures(spark, d))).withColumn("avg", F.round("avg", 6))


@query(bucket_sql("1 hour", "max"))
def agg_time_bucket_hour_max(spark, d):
    return bucketed(spark, d, "hour", "max")


@query(bucket_sql("1 day", "avg"))
def agg_time_bucket_day_avg(spark, d):
    return bucketed(spark, d, "day", "avg")


@query(bucket_sql("7 days", "avg"))
def agg_time_bucket_7day_avg(spark, d):
    return bucketed(spark, d, "7day", "avg")


@query(bucket_sql("14 days", "max"))
def agg_time_bucket_14day_max(spark, d):
    return bucketed(spark, d, "14day", "max")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sort_by(spark, d):
    return T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").orderBy("r_name", "n_name")


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem ORDER BY 1, 2 LIMIT 200")
def limit_rows(spark, d):
    return filters.limit_rows(T(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), 200)


@query("SELECT l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) <= 20")
def limit_each(spark, d):
    """The reference's limit for each question, asked of every supplier."""
    return filters.limit_each(T(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", 20)


VECTORS = "v AS (SELECT 't' || vec_id AS term, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def terms_of(spark, d):
    return T(spark, d, "embeddings").select(F.concat(F.lit("t"), F.col("vec_id")).alias("term"), F.col("embedding").alias("vec"))


@query("SELECT 't' || a.vec_id AS term_a, 'T' || b.vec_id AS term_b, coalesce(round(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6), 4), -1.0) AS similarity FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE b.vec_id IS NOT NULL")
def cosine_similarity(spark, d):
    v = T(spark, d, "embeddings")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.lit(1).alias("_")), "vec_id").select(F.concat(F.lit("t"), F.col("vec_id")).alias("term_a"), F.concat(F.lit("T"), F.col("vec_id") + 1).alias("term_b"))
    return measures.similarity(pairs, terms_of(spark, d)).withColumn("similarity", F.round("similarity", 4))


@query(f"WITH {VECTORS}, s AS (SELECT a.term, b.term AS partner, list_cosine_similarity(a.e, b.e) AS x FROM v a JOIN v b ON a.term <> b.term AND CAST(substr(a.term, 2) AS BIGINT) % 20 = 0) SELECT term, partner, CAST(row_number() OVER (PARTITION BY term ORDER BY round(x, 6) DESC, partner) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def topk_similar(spark, d):
    terms = T(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("t"), F.col("vec_id")).alias("term"))
    return measures.most_similar(terms_of(spark, d), terms, 10).select("term", "partner", F.col("rank").cast("int").alias("rank"))


@query(None)
def topk_similar_probed(spark, d):
    """topk_similar by hyperplane buckets to a measured recall of 0.95: approximate, so that tests hold it against the exact one."""
    terms = T(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("t"), F.col("vec_id")).alias("term"))
    rows, _, _ = nearest.most_similar_probed(terms_of(spark, d), terms, 10)
    return rows.select("term", "partner", F.col("rank").cast("int").alias("rank"), "similarity")


# set operations


@query("SELECT 'CUST:' || c_custkey AS id FROM customer UNION ALL SELECT 'SUPP:' || s_suppkey FROM supplier UNION ALL SELECT 'CUST:' || o_custkey FROM orders")
def union_all(spark, d):
    return ids(spark, d, "customer", "CUST", "c_custkey").unionByName(ids(spark, d, "supplier", "SUPP", "s_suppkey")).unionByName(ids(spark, d, "orders", "CUST", "o_custkey"))


@query("SELECT DISTINCT p_partkey AS id, lower(p_name) AS key FROM part UNION SELECT DISTINCT p_partkey, lower(word) FROM part, unnest(string_split(p_name, ' ')) AS u(word)")
def union_names_synonyms(spark, d):
    part = T(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("key")).union(part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")))).distinct()


# scalar functions


@query("SELECT p_partkey, upper(p_brand) AS prefix, p_name AS local, 'PART_' || p_partkey AS last, 'PART:' || p_partkey AS obo, 'PART_' || p_partkey AS gene FROM part")
def curie_parts(spark, d):
    """curie_prefix, un_curie, path_last, obo_to_curie, munge_gene."""
    identifier, iri = F.concat_ws(":", F.lower("p_brand"), "p_name", F.lit("third")), F.concat(F.lit("http://x.org/obo/PART_"), F.col("p_partkey"))
    return T(spark, d, "part").select("p_partkey", c.curie_prefix(identifier).alias("prefix"), c.un_curie(identifier).alias("local"), c.path_last(iri).alias("last"), c.obo_to_curie(iri).alias("obo"), c.munge_gene(iri).alias("gene"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short FROM documents")
def short_text(spark, d):
    return T(spark, d, "documents").select("doc_id", c.short_text(F.col("text")).alias("short"))


@query("SELECT page_id, CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END AS with_slash, regexp_replace(url, '/$', '') AS without FROM pages")
def terminate(spark, d):
    return T(spark, d, "pages").select("page_id", c.terminate(F.col("url")).alias("with_slash"), c.unterminate(F.col("url")).alias("without"))


def prefix_table(spark, d):
    return T(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("curie"), F.concat(F.lit("http://x.org/"), F.col("n_nationkey"), F.lit("/")).alias("iri"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey ELSE upper(c_custkey || 'a') END AS curie, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey || ':' || c_custkey || 'a' ELSE 'http://unknown/' || c_custkey || 'a' END AS compact, 'http://x.org/' || c_nationkey || '/' || c_custkey AS iri, 'http://x.org/' || c_nationkey || '/' AS type_iri FROM customer")
def iri_conversions(spark, d):
    """iri_to_curie_prefix, make_up_curie, iri_compact, curie_to_iri, guess_type."""
    p = prefix_table(spark, d)
    known = F.concat(F.lit("http://x.org/"), F.col("c_nationkey"), F.lit("/"), F.col("c_custkey"), F.lit("a"))
    rows = T(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, known).otherwise(F.concat(F.lit("http://unknown/"), F.col("c_custkey"), F.lit("a"))).alias("address"), F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(":"), F.col("c_custkey")).alias("identifier"), F.lit("none").alias("source"))
    out = c.iri_compact(rows, p, "address")
    out = c.make_up_curie(out, p, "address")
    out = c.guess_type(c.curie_to_iri(out, p, "identifier"), p, "identifier", "source")
    return out.select("c_custkey", "curie", "compact", "iri", "type_iri")


@query("SELECT event_id, '{\"http://x.org/k\":\"' || (props->>'$.k') || '\",\"kind\":\"' || event_type || '\"}' AS record FROM events")
def expand_context(spark, d):
    """Records of two keys, of which the context knows one, put together again."""
    record = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    rows = T(spark, d, "events").select("event_id", record.alias("record"))
    context = T(spark, d, "region").select(F.lit("k").alias("term"), F.lit("http://x.org/k").alias("iri")).distinct()
    return c.expand_context(rows, context, "record", ["event_id"]).withColumn("record", F.to_json("record"))


@query("SELECT event_id, CASE WHEN props->>'$.k' LIKE '1%' THEN props->>'$.k' END AS value FROM events")
def extract_path_values(spark, d):
    return T(spark, d, "events").select("event_id", c.extract_path_values(F.col("props"), "$.k", "1").alias("value"))


@query("SELECT 'GO:' || p_partkey AS id FROM part UNION ALL SELECT 'SUPP:' || s_suppkey FROM supplier")
def rewrite_prefix(spark, d):
    rows = ids(spark, d, "part", "PART", "p_partkey").unionByName(ids(spark, d, "supplier", "SUPP", "s_suppkey"))
    return rows.select(c.rewrite_prefix(F.col("id"), "PART", "GO").alias("id"))


@query("SELECT 'CUST:' || c_custkey AS id, 'Party' AS concept FROM customer UNION ALL SELECT 'NONE:' || n_nationkey, NULL FROM nation")
def abstract_type(spark, d):
    rows = ids(spark, d, "customer", "CUST", "c_custkey").unionByName(ids(spark, d, "nation", "NONE", "n_nationkey"))
    return c.abstract_type(rows, typegraph.assign_is_a(*type_concepts(spark, d)), "id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'Pathway' END AS node_type FROM orders")
def type_code(spark, d):
    return T(spark, d, "orders").select("o_orderkey", c.type_code(F.col("o_orderstatus")).alias("node_type"))


@query("SELECT p_partkey, p_type || ' ' || p_name AS inverted, p_name || ';' || p_type AS parts FROM part")
def invert_comma_name(spark, d):
    """invert_comma_name and split_multi."""
    return T(spark, d, "part").select("p_partkey", c.invert_comma_name(F.concat_ws(", ", "p_name", "p_type")).alias("inverted"), F.array_join(c.split_multi(F.concat_ws(" | ", "p_name", F.lit(""), "p_type")), ";").alias("parts"))


@query("SELECT DISTINCT user_id, 35 + user_id / 1000.0 AS lat, CAST(NULL AS DOUBLE) AS lon FROM events")
def parse_lat_lon(spark, d):
    p = c.parse_lat_lon(F.concat_ws(",", (35 + F.col("user_id") / 1000.0).cast("string"), F.lit("none")))
    return T(spark, d, "events").select("user_id", p.alias("p")).select("user_id", "p.lat", "p.lon").distinct()


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parse(spark, d):
    """date_parse and date_format."""
    return T(spark, d, "orders").select("o_orderkey", c.format_date(c.parse_date(F.date_format("o_orderdate", "yyyy-M-d"))).alias("day"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[{}?=/\\s]+', '_', 'g')) AS name FROM pages")
def normalize_name(spark, d):
    return T(spark, d, "pages").select("page_id", c.normalize_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '% %' THEN '\"' || p_name || '\"' ELSE p_name END AS keyword, p_name || ' (PART:' || p_partkey || ')' AS shortname, p_size = 1 AS synonym FROM part")
def quote_keyword(spark, d):
    """quote_keyword, node_shortname, edge_is_synonym."""
    return T(spark, d, "part").select("p_partkey", c.quote_keyword(F.col("p_name")).alias("keyword"), c.node_shortname(F.col("p_name"), t.curie("PART", "p_partkey")).alias("shortname"), c.edge_is_synonym(F.when(F.col("p_size") == 1, "SYNONYM").otherwise("other")).alias("synonym"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def valid_node_type(spark, d):
    nodes = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("node_type"))
    return c.valid_nodes(nodes, nodes.where("node_type != 'P'"))[0].select("id")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"WITH e AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL) SELECT user_id || '' AS patient_id, string_agg(event_type || '@' || {STAMP.format('a')} || '@OUTPATIENT', ';' ORDER BY event_type) AS visits, string_agg(event_type || '@' || {STAMP.format('b')}, ';' ORDER BY event_type) AS meds FROM e GROUP BY user_id")
def flatten_patient(spark, d):
    out = measures.flatten_patients(t.patients(spark, d))
    visits = F.transform("diagnoses", lambda x: F.concat_ws("@", x["diagnosis"], x["date"], x["type"]))
    return out.select("patient_id", F.array_join(visits, ";").alias("visits"), F.array_join(F.transform("medications", lambda x: F.concat_ws("@", x["medication"], x["date"])), ";").alias("meds"))


@query("SELECT user_id || '' AS patient_id, count(*) AS n_exposures, count(DISTINCT event_type) AS n_visits FROM events GROUP BY user_id")
def nest_endotype_request(spark, d):
    e = T(spark, d, "events").withColumn("visit_id", F.concat_ws("/", "user_id", "event_type"))
    visits = e.groupBy("visit_id", F.col("user_id").cast("string").alias("patient_id"), F.col("event_type").alias("visit_type")).agg(F.min("ts").cast("string").alias("time"))
    out = measures.endotype_requests(t.patients(spark, d), visits, e.select("visit_id", F.col("event_type").alias("exposure_type"), F.lit("u").alias("units"), "value"))
    parsed = F.from_json("request", "visits array<struct<exposures: array<struct<value: double>>>>")["visits"]
    return out.select("patient_id", F.aggregate(parsed, F.lit(0).cast("long"), lambda s, v: s + F.size(v["exposures"])).alias("n_exposures"), F.size(parsed).cast("long").alias("n_visits"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to regions: shortest paths of the type graph, compiled and run over all orders."""
    return execute_program(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(SQL)
