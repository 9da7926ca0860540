"""Graph patterns and other joins against brute force, with hot keys."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import bgp as trees
from weftgraph.operators import patterns, typegraph
from weftgraph.plans import domain
from weftgraph.functions import curie as c


def brute(quads, triples, select, values=None, distinct=False):
    rows = [{}]
    for pattern in triples:
        rows = [b for r in rows for _, s, p, o in quads if (b := bound(r, pattern, (s, p, o))) is not None]
    rows = [r for r in rows if all(r[v] in ids for v, ids in (values or {}).items())]
    out = Counter(tuple(r[c] for c in select) for r in rows)
    return Counter(set(out)) if distinct else out


def bound(row, pattern, triple):
    row = dict(row)
    for term, value in zip(pattern, triple):
        if not term.startswith("?"):
            if term != value:
                return None
        elif row.setdefault(term[1:], value) != value:
            return None
    return row


CASES = [
    [("?a", "p", "?b"), ("?b", "q", "?c"), ("?c", "r", "?d")],
    [("?a", "p", "?b"), ("?a", "q", "?c"), ("?d", "r", "?b"), ("?d", "p", "?e")],
    [("?a", "p", "?b"), ("?b", "q", "?c"), ("?c", "p", "?a")],  # cyclic
    [("?a", "p", "?b"), ("?a", "p", "?b"), ("n1", "q", "?b")],
    [("?a", "p", "?a"), ("?a", "?b", "?c")],
    [("?a", "p", "?b"), ("?b", "q", "?c"), ("?b", "r", "?d"), ("?d", "q", "?e")],
]


@pytest.mark.parametrize("triples", CASES)
@pytest.mark.parametrize("distinct", [False, True])
def test_patterns_match_brute_force(spark, triples, distinct):
    r = random.Random(str(triples))
    nodes = [f"n{i}" for i in range(7)]
    quads = [("g", r.choice(nodes[:1] * 5 + nodes), p, r.choice(nodes)) for p in "pqr" for _ in range(16)]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string")
    variables = sorted({t[1:] for x in triples for t in x if t.startswith("?")})
    for select, asked in [(variables[:2], {}), (variables[-1:], {variables[0]: nodes[1:2]}), (variables[:1], {variables[-1]: ["n0", "n3"], variables[0]: nodes}), (variables, {variables[1]: nodes[:4]}), (variables[:2], {variables[0]: ["none"]})]:
        given = {v: spark.createDataFrame([(x,) for x in ids], "id string") for v, ids in asked.items()}
        got = Counter(map(tuple, patterns.bgp(df, triples, select, given, distinct).collect()))
        assert got == brute(quads, triples, select, asked, distinct)


def test_patterns_without_a_shared_variable_only_test(spark):
    quads = [("g", "a", "p", "x"), ("g", "b", "p", "y"), ("g", "c", "q", "z")]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string")
    two = [("?a", "p", "?b"), ("?c", "q", "?d")]
    assert patterns.bgp(df, two, ["a"], distinct=True).count() == 2
    assert patterns.bgp(df, [*two, ("?d", "none", "?e")], ["a"], distinct=True).count() == 0
    for select, distinct in ((["a", "c"], True), (["a"], False)):
        with pytest.raises(ValueError):
            patterns.bgp(df, two, select, distinct=distinct)


def test_restricted_patterns_reduce_their_neighbours(spark):
    """Few ids at one end: the other end's rows are reduced before anything is joined."""
    quads = [("g", f"a{i}", "p", f"b{i % 50}") for i in range(400)] + [("g", f"b{i}", "q", f"c{i % 10}") for i in range(50)] + [("g", f"c{i}", "r", f"d{i}") for i in range(10)]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string")
    triples = [("?a", "p", "?b"), ("?b", "q", "?c"), ("?c", "r", "?d")]
    nodes = [trees.Node(trees.scan(df, t)) for t in triples]
    nodes[2].df, nodes[2].selective = nodes[2].df.where("d = 'd3'"), True
    tree = trees.join_tree([n.variables for n in nodes], {"a", "d"})
    from weftgraph.storage import scratch

    nodes[2].open = True
    trees.reduced(nodes, tree, scratch(spark))
    assert [n.df.count() for n in nodes] == [40, 5, 1]
    got = patterns.bgp(df, triples, ["a", "d"], {"d": spark.createDataFrame([("d3",)], "id string")}, distinct=True)
    assert got.count() == 40


def test_a_compound_of_most_rows(spark):
    """A third of all records name one compound; its pairs are made once, and variables that nothing needs are gone before."""
    quads = [("g", f"A:{i}", "ctd:disease", f"DIS:{i % 40}") for i in range(900)] + [("g", f"A:{i}", "ctd:cid", "CHEM:0" if i % 3 else f"CHEM:{i}") for i in range(900)]
    quads += [("g", f"X:{i}", "ctd:cid", "CHEM:0" if i % 3 else f"CHEM:{i}") for i in range(900)] + [("g", f"X:{i}", "ctd:gene", f"GENE:{i % 25}") for i in range(900)]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string").repartition(3)
    ids = spark.createDataFrame([(f"DIS:{i}",) for i in range(40)], "id string")
    got = {tuple(r) for r in domain.disease_to_gene(df, ids).collect()}
    by, genes = {}, {}
    for _, s, p, o in quads:
        if p == "ctd:cid":
            (by if s.startswith("A:") else genes).setdefault(o, set()).add(s)
    kind = {s: o for _, s, p, o in quads if p in ("ctd:disease", "ctd:gene")}
    assert got == {(kind[a], kind[x]) for chem in by for a, x in itertools.product(by[chem], genes.get(chem, ()))}
    plan = domain.disease_to_gene(df, ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_evidence_of_diseases_and_genes(spark):
    quads = [("g", "D:1", "label", "Asthma"), ("g", "A:1", "ctd:disease", "D:1"), ("g", "A:1", "ctd:cid", "C:1"), ("g", "A:1", "ctd:pmids", "1|2"), ("g", "X:1", "ctd:cid", "C:1"), ("g", "X:1", "ctd:gene", "G:1"), ("g", "X:1", "ctd:pubmedids", "2|9"), ("g", "X:2", "ctd:cid", "C:1"), ("g", "X:2", "ctd:gene", "G:1"), ("g", "X:2", "ctd:pubmedids", "7")]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string")
    names = spark.createDataFrame([("asthma",), ("cough",)], "name string")
    assert [tuple(r) for r in domain.disease_name_to_gene(df, names).collect()] == [("asthma", "D:1", "G:1", "1|2|7|9")]


def test_programs_share_their_first_levels(spark):
    quads = [("g", "N:1", "names", "D:1"), ("g", "D:1", "x", "E:1"), ("g", "D:1", "y", "F:1"), ("g", "D:1", "x", "F:2"), ("g", "M:1", "names", "D:9")]
    df = spark.createDataFrame(quads, "g string, s string, p string, o string")
    schema = "level int, node_type string, ops array<string>"
    one = spark.createDataFrame([(0, "N", ["names"]), (1, "D", ["x"]), (2, "E", ["z"])], schema)
    two = spark.createDataFrame([(0, "N", ["names"]), (1, "D", ["y"])], schema)
    start, other = spark.createDataFrame([("N:1",)], "id string"), spark.createDataFrame([("M:1",)], "id string")
    got = typegraph.execute_programs({"one": (one, start), "two": (two, start), "three": (two, other)}, df)
    assert {(r["program"], r["level"], r["source_id"], r["target_id"], r["type_ok"]) for r in got.collect()} == {("one", 0, "N:1", "D:1", True), ("one", 1, "D:1", "E:1", True), ("one", 1, "D:1", "F:2", False), ("two", 0, "N:1", "D:1", True), ("two", 1, "D:1", "F:1", True)}


def test_a_registry_executes_programs(spark):
    """Two operations of one link, one of which gives another type; functions run, and not tables alone."""
    edges = lambda rows: spark.createDataFrame(rows, "source_id string, predicate string, target_id string")
    r = typegraph.Registry()
    r.register("one", "A", "B", "l", lambda nodes: nodes.select(F.col("id").alias("source_id"), F.lit("own").alias("predicate"), F.regexp_replace("id", "A:", "B:").alias("target_id")))
    r.register("two", "A", "B", "l", lambda nodes: nodes.join(edges([("A:1", "x", "C:9")]), F.col("id") == F.col("source_id")).drop("id"))
    r.register("three", "B", "D", "m", lambda nodes: nodes.select(F.col("id").alias("source_id"), F.lit("own").alias("predicate"), F.lit("D:0").alias("target_id")))
    moves = spark.createDataFrame([("A", "B", "l", "one"), ("A", "B", "l", "two"), ("B", "D", "m", "three")], "src_type string, dst_type string, link string, op string")
    program = typegraph.program_of(moves, "A", spark.createDataFrame([("D",)], "t string"), named=True)
    got = {tuple(x) for x in r.execute(program, spark.createDataFrame([("A:1",), ("A:2",), ("Z:1",)], "id string")).collect()}
    assert got == {(0, "one", "A:1", "l", "B:1", True), (0, "one", "A:2", "l", "B:2", True), (0, "two", "A:1", "l", "C:9", False), (1, "three", "B:1", "m", "D:0", True), (1, "three", "B:2", "m", "D:0", True)}
    with pytest.raises(KeyError):
        typegraph.Registry().execute(program, spark.createDataFrame([("A:1",)], "id string"))


def test_paths_go_on_to_their_end(spark):
    moves = spark.createDataFrame([(f"T{i}", f"T{i + 1}", "l") for i in range(7)] + [("T7", "T0", "l"), ("T3", "T1", "m")], "src_type string, dst_type string, link string")
    got = sorted((r["dst_type"], len(r["links"])) for r in typegraph.paths(moves, "T0").collect())
    assert got == [(f"T{i}", i) for i in range(1, 8)]
    assert typegraph.paths(moves, "T0", 2).count() == 2


def test_records_are_put_together_again(spark):
    rows = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {}), (3, None), (4, {"z": 5})], "i int, record map<string,int>")
    context = spark.createDataFrame([("a", "http://a"), ("b", "http://b")], "term string, iri string")
    got = {r["i"]: r["record"] for r in c.expand_context(rows, context, "record", ["i"]).collect()}
    assert got == {1: {"http://a": "1", "http://b": "2"}, 2: {}, 3: None, 4: {"z": "5"}}
