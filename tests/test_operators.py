"""The library's own operators on small tables with the odd cases that the given tables lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import curie as c
from weftgraph.operators import filters, measures, ontology, patterns, typegraph
from weftgraph.plans import domain
from weftgraph.sources import tables as t
from weftgraph.storage import scratch
from weftgraph.streaming.exposures import bucket_stream


def values(spark, column, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


ODD = ["DOID:2841", "go.bp:1:2", "http://purl.org/obo/HP_0002099", "none", "a/", None]


def test_identifier_expressions(spark):
    assert values(spark, c.curie_prefix, ODD) == ["DOID", "GO.BP", "HTTP", None, None, None]
    assert values(spark, c.un_curie, ODD) == ["2841", "1", "//purl.org/obo/HP_0002099", "none", "a/", None]
    assert values(spark, c.path_last, ODD) == ["DOID:2841", "go.bp:1:2", "HP_0002099", "none", "", None]
    assert values(spark, c.obo_to_curie, ODD)[2] == "HP:0002099"
    assert values(spark, c.munge_gene, ODD)[:3] == ["DOID:2841", "go.bp:1:2", "HP_0002099"]
    assert values(spark, c.terminate, ["a", "a/"]) == ["a/", "a/"] and values(spark, c.unterminate, ["a", "a/", "a//"]) == ["a", "a", "a/"]
    assert values(spark, c.short_text, ["x" * 81, "x" * 80]) == ["x" * 80 + "...", "x" * 80]
    assert values(spark, c.invert_comma_name, ["Arrhythmias, Cardiac", "Asthma"]) == ["Cardiac Arrhythmias", "Asthma"]
    assert values(spark, lambda x: c.split_multi(x), ["a| b ||c", ""]) == [["a", "b", "c"], []]
    assert values(spark, c.parse_date, ["2010-1-1", "2010-01-31", "x"]) == [dt.date(2010, 1, 1), dt.date(2010, 1, 31), None]
    assert values(spark, c.type_code, ["G", "?"]) == ["Gene", None]
    assert values(spark, lambda x: c.rewrite_prefix(x, "MSH", "MESH"), ["MSH:1", "MSHX:1"]) == ["MESH:1", "MSHX:1"]
    lat = values(spark, c.parse_lat_lon, ["35.5,-79", "x"])
    assert (lat[0]["lat"], lat[0]["lon"]) == (35.5, -79.0) and lat[1]["lat"] is None


def test_obo_stanzas(spark, tmp_path):
    text = 'format-version: 1.2\n\n[Term]\nid: DOID:1\nname: asthma\nsynonym: "wheeze" EXACT []\nxref: MESH:D1 ! note\nis_a: DOID:0 {a="b"} ! disease\nis_a: DOID:9\n\n[Term]\nid: DOID:2\nname: lone\n\n[Typedef]\nid: part_of\nname: part\n'
    (tmp_path / "o.obo").write_text(text)
    o = t.read_obo(spark, str(tmp_path / "o.obo"))
    assert {tuple(r) for r in o["terms"].collect()} == {("DOID:1", "asthma"), ("DOID:2", "lone")}
    assert [tuple(r) for r in o["synonyms"].collect()] == [("DOID:1", "wheeze")]
    assert [tuple(r) for r in o["xrefs"].collect()] == [("DOID:1", "MESH:D1")]
    assert {tuple(r) for r in o["is_a"].collect()} == {("DOID:1", "DOID:0"), ("DOID:1", "DOID:9")}


def test_obo_with_other_line_ends(spark, tmp_path):
    (tmp_path / "o.obo").write_bytes(b"format-version: 1.2\r\n\r\n[Term]\r\nid: A:1\r\nname: one\r\nis_a: A:0 ! zero\r\n\r\n[Typedef]\r\nid: p\r\nname: q\r\n\r\n[Term]\r\nid: A:2\r\nname: two\r\n")
    o = t.read_obo(spark, str(tmp_path / "o.obo"))
    assert {tuple(r) for r in o["terms"].collect()} == {("A:1", "one"), ("A:2", "two")}
    assert [tuple(r) for r in o["is_a"].collect()] == [("A:1", "A:0")]


def test_ragged_commented_rows(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# note\na\t1\tp|q\nb\n# more\nc\t3\n")
    rows = t.read_tsv(spark, str(tmp_path / "x.tsv"), "name string, n int, more string").collect()
    assert [tuple(r) for r in rows] == [("a", 1, "p|q"), ("b", None, None), ("c", 3, None)]


def test_closure_of_diamonds_and_cycles(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")], "child string, parent string")
    got = {(r["id"], r["ancestor"]): r["depth"] for r in ontology.closure(edges).collect()}
    assert got == {("d", "b"): 1, ("d", "c"): 1, ("b", "a"): 1, ("c", "a"): 1, ("d", "a"): 2, ("x", "y"): 1, ("y", "x"): 1}
    assert ontology.closure(edges, reflexive=True).where("depth = 0").count() == 6


def test_khop_and_names(spark):
    m = spark.createDataFrame([("MESH:1", "HP:1", "s1"), ("HP:1", "DOID:1", "s2"), ("MESH:1", "DOID:1", "s3"), ("DOID:1", "OMIM:1", "s4")], "from_curie string, to_curie string, source_prefix string")
    near = {(r["query_id"], r["curie"]): r["distance"] for r in ontology.khop(m, 3).collect()}
    assert near["MESH:1", "DOID:1"] == 1 and near["MESH:1", "OMIM:1"] == 2 and near["OMIM:1", "HP:1"] == 2
    names = spark.createDataFrame([("Arrhythmias, Cardiac",), ("A.*",), ("",), ("Wheeze",)], "name string")
    terms = spark.createDataFrame([("DOID:1", "cardiac arrhythmias"), ("DOID:2", "asthma")], "id string, name string")
    synonyms = spark.createDataFrame([("DOID:2", "wheeze")], "id string, synonym string")
    assert {tuple(r) for r in ontology.name_search(names, terms, synonyms).collect()} == {("Arrhythmias, Cardiac", "DOID:1"), ("Wheeze", "DOID:2")}


def test_patterns_keep_multiplicity_and_refuse_products(spark):
    q = spark.createDataFrame([("g", "a", "p", "b"), ("g", "a", "p", "c"), ("g", "b", "q", "x"), ("g", "c", "q", "x"), ("g", "z", "p", "z")], "g string, s string, p string, o string")
    two = [("?a", "p", "?b"), ("?b", "q", "?c")]
    assert [tuple(r) for r in patterns.bgp(q, two, ["a", "c"]).collect()] == [("a", "x"), ("a", "x")]
    assert patterns.bgp(q, two, ["a", "c"], distinct=True).count() == 1
    assert [r[0] for r in patterns.bgp(q, [("?a", "p", "?a")], ["a"]).collect()] == ["z"]
    with pytest.raises(ValueError):
        patterns.bgp(q, [("?a", "p", "?b"), ("?c", "q", "?d")], ["a"])


def test_all_shortest_paths_and_programs(spark):
    moves = spark.createDataFrame([("A", "B", "l1"), ("A", "C", "l2"), ("B", "D", "l3"), ("C", "D", "l4"), ("B", "D", "l5"), ("D", "A", "l6"), ("A", "E", "UNKNOWN")], "src_type string, dst_type string, link string").withColumn("op", F.col("link"))
    found = typegraph.shortest_paths(moves, "A", spark.createDataFrame([("D",), ("E",)], "t string"))
    assert {tuple(r["links"]) for r in found.collect()} == {("l1", "l3"), ("l1", "l5"), ("l2", "l4")}
    program = typegraph.compile_program(found)
    assert {(r["level"], r["node_type"]): r["ops"] for r in program.collect()} == {(0, "A"): ["l1", "l2"], (1, "B"): ["l3", "l5"], (1, "C"): ["l4"]}
    edges = spark.createDataFrame([("A:1", "l1", "B:1"), ("A:1", "l2", "X:1"), ("B:1", "l3", "D:1")], "s string, p string, o string")
    out = typegraph.execute_program(program, spark.createDataFrame([("A:1",), ("A:1",)], "id string"), edges)
    assert {(r["level"], r["target_id"], r["type_ok"]) for r in out.collect()} == {(0, "B:1", True), (0, "X:1", False), (1, "D:1", True)}
    good, bad = typegraph.load_type_graph(moves.union(spark.createDataFrame([("A", "Q", "l", "l")], moves.schema)), spark.createDataFrame([(x,) for x in "ABCDE"], "type string"))
    assert (good.count(), bad.count()) == (7, 1)


def test_publications_and_filters(spark):
    df = spark.createDataFrame([(1, [("pmid:1",), ("DOI:2",), ("PMID:3",)]), (2, None), (3, [])], "i int, p array<struct<id: string>>")
    assert {r["i"]: r["x"] for r in df.select("i", filters.pmids(F.col("p")).alias("x")).collect()} == {1: ["pmid:1", "PMID:3"], 2: [], 3: []}
    points = spark.createDataFrame([(35.0, -79.0), (35.0, -79.02), (36.0, -79.0)], "lat double, lon double")
    assert filters.within_radius(points, 35.0, -79.0, 5).count() == 2
    assert filters.where_in(points, "lat", list(range(2000))).count() == 3


def test_similarity_of_unknown_and_zero_terms(spark):
    e = spark.createDataFrame([("aspirin", [1.0, 0.0]), ("kit", [1.0, 1.0]), ("zero", [0.0, 0.0])], "term string, vec array<float>")
    pairs = spark.createDataFrame([("Aspirin", "kit"), ("aspirin", "none"), ("two words", "kit"), ("zero", "kit")], "term_a string, term_b string")
    assert {r["term_a"]: r["similarity"] for r in measures.similarity(pairs, e).where("term_b != 'none'").collect()} == {"Aspirin": 0.707107, "two words": -1.0, "zero": -1.0}


def test_merge_and_upsert(spark):
    nodes = spark.createDataFrame([("b", "B"), ("a", "A"), ("z", None)], "id string, label string")
    links = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {r["representative"]: (r["synonyms"], r["labels"]) for r in patterns.merge_synonyms(nodes, links).collect()} == {"a": (["a", "b"], ["A", "B"]), "z": (["z"], [])}
    assert sorted(r[0] for r in t.upsert(nodes.select("id"), spark.createDataFrame([("a",), ("q",), ("q",)], "id string"), ["id"]).collect()) == ["a", "b", "q", "z"]


def test_split_identifier_lists(spark):
    rows = spark.createDataFrame([("p1", "doid:1, DOID:2"), ("p2", ""), ("p3", None)], "key string, ids string")
    assert {tuple(r) for r in domain.split_ids(rows, "ids").collect()} == {("p1", "DOID:1"), ("p1", "DOID:2")}


def test_buckets_over_a_stream(spark):
    path = scratch(spark)
    rows = [("pm25", dt.datetime(2011, 1, 1, 5), 30.0), ("pm25", dt.datetime(2011, 1, 1, 7), 10.0), ("pm25", dt.datetime(2011, 1, 2, 0), 14.0), ("pm25", dt.datetime(2011, 1, 9), 1.0)]
    df = spark.createDataFrame(rows, "exposure_type string, ts timestamp, value double")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    run = bucket_stream(stream, "day").writeStream.outputMode("complete").format("memory").queryName("weft_buckets").start()
    run.processAllAvailable()
    run.stop()
    got = {r["bucket"].day: r["value"] for r in spark.table("weft_buckets").collect()}
    assert got == {1: 20.0, 2: 14.0, 9: 1.0} == {r["bucket"].day: r["value"] for r in measures.time_buckets(df, "day").collect()}


def test_limits_are_of_each_entity(spark):
    edges = spark.createDataFrame([(f"DIS:{i}", f"GENE:{g}", "p") for i in range(30) for g in range(3)], "source_id string, target_id string, predicate string")
    genes = spark.createDataFrame([(f"GENE:{g}",) for g in range(3)], "id string")
    got = domain.one_hop(edges, genes, "DIS", 20).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {f"GENE:{g}": 20 for g in range(3)}
    assert domain.one_hop_of(edges, genes, "DIS", ["HGNC"]).count() == 0


def test_names_are_found_inside_labels(spark):
    """Names shorter and longer than the runs they meet by, with signs of patterns, against brute force."""
    labels = ["Cardiac Arrhythmias", "Asthma", "asthma, allergic", "A.* odd (name)", "", None, "ab", "b", "Thyroid Neoplasms of the thyroid", "x" * 50]
    names = ["asthma", "ASTHMA", "A.*", "thyroid neoplasms", "b", "", None, "zz", "xxxxxxxxxxxx", "(name)", "allergic asthma", "y" * 60]
    got = patterns.containing(spark.createDataFrame(list(enumerate(labels)), "id int, label string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = {(n, i) for n in names if n for i, x in enumerate(labels) if x and n.lower() in x.lower()}
    assert {(r["name"], r["id"]) for r in got.collect()} == want and got.count() == len(want)


def test_longest_registered_base(spark):
    prefixes = spark.createDataFrame([("HP", "http://purl.obolibrary.org/obo/HP_"), ("OBO", "http://purl.obolibrary.org/obo/"), ("V", "http://x.org/voc#"), ("X", "http://x.org")], "curie string, iri string")
    iris = ["http://purl.obolibrary.org/obo/HP_0002099", "http://purl.obolibrary.org/obo/DOID_1", "http://x.org/voc#asthma", "http://x.org/a/b/", "urn:none", None, ""]
    df = spark.createDataFrame(list(enumerate(iris)), "i int, iri string")
    assert {r["i"]: r["curie"] for r in c.to_curie(df, prefixes, "iri").collect()} == {0: "HP", 1: "OBO", 2: "V", 3: "X", 4: None, 5: None, 6: None}
    assert [r["compact"] for r in c.iri_compact(df, prefixes, "iri").orderBy("i").collect()] == ["HP:0002099", "OBO:DOID_1", "V:asthma", "X:a/b", "urn:none", None, ""]


def test_properties_of_synonyms_merge(spark):
    rows = [("a", "tags", "set", ["y", "x"]), ("b", "tags", "set", ["x", "z"]), ("a", "refs", "list", ["1"]), ("b", "refs", "list", ["1", "2"]), ("a", "name", "scalar", ["n"]), ("b", "name", "scalar", ["m"]), ("a", "odd", "set", ["1"]), ("b", "odd", "list", ["1"]), ("q", "odd", "list", ["9"])]
    good, bad = patterns.merge_properties(spark.createDataFrame(rows, "id string, key string, kind string, values array<string>"), spark.createDataFrame([("b", "a")], "a string, b string"))
    assert {(r["representative"], r["key"]): r["values"] for r in good.collect()} == {("a", "tags"): ["x", "y", "z"], ("a", "refs"): ["1", "1", "2"], ("a", "name"): ["n", "m"], ("q", "odd"): ["9"]}
    assert [(r["representative"], r["key"], r["kinds"]) for r in bad.collect()] == [("a", "odd", ["list", "set"])]


def test_parallel_operations_keep_their_names(spark):
    moves = spark.createDataFrame([("A", "B", "l", "one"), ("A", "B", "l", "two"), ("A", "B", "UNKNOWN", "three")], "src_type string, dst_type string, link string, op string")
    found = typegraph.shortest_paths(moves, "A", spark.createDataFrame([("B",)], "t string"))
    assert [(r["ops"], r["names"]) for r in typegraph.compile_program(found, moves).collect()] == [(["l"], ["l:one", "l:two"])]


def test_chains_go_on_with_what_is_bound(spark):
    q = spark.createDataFrame([("g", "A:1", "p", "B:1"), ("g", "A:1", "p", "B:2"), ("g", "B:2", "q", "C:2"), ("g", "B:3", "q", "C:3")], "g string, s string, p string, o string")
    things = spark.createDataFrame([("A:1",)], "id string")
    run = lambda b: {(r["kind"], r["id"], r["value"]) for r in typegraph.translate_chain(things, q, ["A", "B", "C"], 2, b).collect()}
    assert run(None) == {("B", "A:1", "B:1"), ("B", "A:1", "B:2"), ("C", "B:2", "C:2")}
    assert run({"B": spark.createDataFrame([("B:3",)], "id string")}) == {("B", "A:1", "B:1"), ("B", "A:1", "B:2"), ("C", "B:3", "C:3")}


def test_synonyms_of_some_ids(spark):
    m = spark.createDataFrame([("S:1", "P:1", "x"), ("P:1", "T:1", "y"), ("S:2", "T:2", "z"), ("T:2", "T:3", "z")], "from_curie string, to_curie string, source_prefix string")
    ids = spark.createDataFrame([("S:1",), ("S:2",)], "id string")
    assert {(r["query_id"], r["curie"], r["distance"]) for r in ontology.khop(m, 2, ids).collect()} == {("S:1", "P:1", 1), ("S:1", "T:1", 2), ("S:2", "T:2", 1), ("S:2", "T:3", 2)}
    assert {(r["query_id"], r["curie"], r["distance"]) for r in ontology.khop_expanding(m, "T", 3, ids).collect()} == {("S:1", "T:1", 2), ("S:2", "T:2", 1)}


def test_most_similar_in_blocks_is_that_of_all(spark):
    e = spark.createDataFrame([(f"t{i:02}", [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "term string, vec array<float>")
    terms = e.select("term").limit(5)
    one = {tuple(r) for r in measures.most_similar(e, terms, 4).collect()}
    assert one == {tuple(r) for r in measures.most_similar(e, terms, 4, block=7).collect()} and len(one) == 20


def test_a_cluster_needs_a_shared_folder():
    from weftgraph import storage

    class Context:
        applicationId, master = "none", "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf: dict = {}

    with pytest.raises(RuntimeError):
        storage.shared_root(Session())


def test_finished_folders_can_be_deleted(spark):
    from weftgraph import storage

    before = storage.made(spark)
    storage.written(spark.range(3), scratch(spark))
    assert storage.cleared(spark, before) == 1 and storage.made(spark) == before


def test_domain_questions_have_no_cap_of_their_own(spark):
    edges = spark.createDataFrame([(f"DIS:{i}", "GENE:1", "p") for i in range(300)], "source_id string, target_id string, predicate string")
    assert domain.one_hop(edges, spark.createDataFrame([("GENE:1",)], "id string"), "DIS").count() == 300


@pytest.mark.parametrize(("name", "cap"), [("q_genes_pathways_by_disease_all", 2000), ("q_disease_name_to_gene_all", 500)])
def test_whole_questions_match_their_sql(spark, sf_dir, name, cap):
    from pathlib import Path

    from weftgraph import registry

    con = pytest.importorskip("duckdb").connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(registry.SQL[name])
    columns = [x[0] for x in want.description]
    got = sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).select(*columns).collect()))
    assert got == sorted(want.fetchall()) and len(got) > cap


def test_shortest_paths_of_a_long_chain(spark):
    moves = spark.createDataFrame([(f"T{i}", f"T{i + 1}", "l") for i in range(10)], "src_type string, dst_type string, link string")
    got = typegraph.shortest_paths(moves, "T0", spark.createDataFrame([("T10",)], "dst_type string")).collect()
    assert [(r["dst_type"], r["hops"]) for r in got] == [("T10", 10)]
