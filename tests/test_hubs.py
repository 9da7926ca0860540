"""What goes through a hub is shuffled as lists, and nothing is lost on the way."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.operators import joins, measures, ontology
from weftgraph.operators.bgp import bgp


def shuffled_rows(spark, run):
    """Rows that the stages of a run have written to shuffles, and the run's result."""
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm

    def stages():
        found = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return sum(n for i, n in stages().items() if i not in before), out


ODD = ["a", "", "\x1e", "\x1f", "\x1b", "\x1bn", "\x1b0", "x\x1ey", "\x1b1\x1f", "ä", None]


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("listed", [1, 1000])
def test_lists_hold_any_text(spark, tmp_path, monkeypatch, distinct, listed):
    monkeypatch.setattr(joins, "LISTED", listed)
    monkeypatch.setattr(joins, "HOT_LISTS", 3)
    rows = [(f"k{i % 3}", i, f"r{i % 5}") for i in range(30)] + [(None, 1, "r")]
    facts = [(f"k{i % 3}", ODD[i % len(ODD)], ODD[i // 3 % len(ODD)]) for i in range(99)] + [(None, "z", "z")]
    got = joins.listed_join(spark.createDataFrame(rows, "k string, n int, r string"), spark.createDataFrame(facts, "k string, x string, y string"), ["k"], ["r", "n", "x", "y"], f"file://{tmp_path}", distinct)
    want = [(r, n, x, y) for k, n, r in rows for j, x, y in facts if k is not None and k == j]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, set(want) if distinct else want))


@pytest.mark.parametrize("hot", [1, 20_000_000])
def test_hot_values_are_joined_as_rows(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_WAYS", hot)
    left = spark.createDataFrame([(f"k{i % 4}", f"r{i % 9}") for i in range(40)], "k string, r string")
    right = spark.createDataFrame([(f"k{i % 4}", f"x{i % 7}") for i in range(80)], "k string, x string")
    got = joins.listed_join(left, right, ["k"], ["r", "x"], f"file://{tmp_path}").collect()
    assert len(got) == len(set(got)) and set(got) == set(left.join(right, "k").select("r", "x").collect())


def test_patterns_pass_hubs_as_lists(spark):
    """300 diseases and 300 genes of one compound are 90,000 pairs; only lists of them are shuffled."""
    rows = [(f"i{i}", "cid", "c") for i in range(300)] + [(f"i{i}", "gene", f"g{i}") for i in range(300)] + [(f"a{i}", "of", "c") for i in range(300)] + [(f"a{i}", "disease", f"d{i}") for i in range(300)]
    quads = spark.createDataFrame([("g", *r) for r in rows], "g string, s string, p string, o string")
    asked = [("?i", "cid", "?c"), ("?i", "gene", "?gene"), ("?a", "of", "?c"), ("?a", "disease", "?disease")]
    n, pairs = shuffled_rows(spark, lambda: bgp(quads, asked, ["disease", "gene"], distinct=True).collect())
    assert len(pairs) == len(set(pairs)) == 90_000 and n < 20_000


@pytest.mark.parametrize("bits", [0, 32])
def test_neighbourhoods_keep_their_prefixes(spark, monkeypatch, bits):
    """Sets of source prefixes are those of brute force, as bits of a number and as sets."""
    monkeypatch.setattr(ontology, "BITS", bits)
    r = random.Random(5)
    edges = {(f"P:{r.randrange(12)}", f"S:{r.randrange(9)}", r.choice(["a", "b", "c"])) for _ in range(90)} | {("P:1", "S:1", None)}
    both = {(x, y, f) for a, b, f in edges for x, y in ((a, b), (b, a))}
    got = {(r["query_id"], r["curie"], r["distance"]): r["source_prefixes"] for r in ontology.khop(spark.createDataFrame(list(edges), "from_curie string, to_curie string, source_prefix string"), 2).collect()}
    one, two = {}, {}
    for a, b, f in both:
        one.setdefault((a, b, 1), set()).add(f)
    for a, b, _ in both:
        for x, c, f in both:
            if x == b and c != a and (a, c, 1) not in one:
                two.setdefault((a, c, 2), set()).add(f)
    assert got == {k: sorted(f for f in v if f is not None) for k, v in (one | two).items()}


def test_neighbourhoods_of_a_hub_are_shuffled_once_found(spark):
    """250 suppliers of 40 parts each: 400,000 ways, of which at most 62,250 pairs are new."""
    edges = [(f"P:{p}", f"S:{s}", "x") for p in range(40) for s in range(250)]
    mappings = spark.createDataFrame(edges, "from_curie string, to_curie string, source_prefix string")
    ids = spark.createDataFrame([(f"S:{s}",) for s in range(250)], "id string")
    n, found = shuffled_rows(spark, lambda: ontology.khop(mappings, 2, ids).collect())
    assert len(found) == 10_000 + 250 * 249 and n < 200_000


@pytest.mark.parametrize("block", [7, 5000])
def test_similar_vectors_leave_a_block_by_k(spark, block):
    """Copies, ties, null and zero vectors: the same rows as pair by pair, of which a block's k a term are shuffled."""
    r = random.Random(3)
    vecs = [[r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(60)] + [[1.0, 2.0, 0.0, 1.0]] * 30 + [[0.0] * 4, [1.0, None, 0.0, 0.0]]
    table = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(vecs)], "term string, vec array<double>")
    for k in (3, 91):
        got = measures.most_similar(table, table, k, block).select("term", "partner", "similarity", "rank").collect()
        pairs = table.crossJoin(table.select(F.col("term").alias("partner"), F.col("vec").alias("other"))).where("term != partner")
        pairs = pairs.select("term", "partner", F.round(measures.dot(measures.unit(F.col("vec")), measures.unit(F.col("other"))), 6).alias("similarity"))
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("similarity"), "partner"))).where(F.col("rank") <= k).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    n, _ = shuffled_rows(spark, lambda: measures.most_similar(table, table, 3, 5000).collect())
    assert n < 92 * 91 / 4


def test_last_pairs_are_not_shuffled_again(spark):
    """800 suppliers, some in two spellings, 400 of them to each of 20 parts: 600,000 pairs, which nobody shuffles once they are found."""
    name = lambda s: f"SUPPLIER:{s:04d}" if s % 50 == 0 else f"SUPPLIER:{s}"
    edges = [(f"PART:{p}", name(s), "ANR"[s % 3]) for p in range(20) for s in random.Random(p).sample(range(800), 400)]
    mappings = spark.createDataFrame(edges, "from_curie string, to_curie string, source_prefix string")
    by = {}
    for p, s, _ in edges:
        by.setdefault(p, set()).add(s)
    want = {(s, p, 1) for p, s, _ in edges} | {(b, c, 2) for s in by.values() for b in s for c in s if b != c}
    ids = mappings.select(F.col("to_curie").alias("id")).distinct()
    for find in (lambda: ontology.khop(mappings, 2, ids), lambda: ontology.khop_expanding(mappings, "PART", 2, ids), lambda: ontology.khop_expanding(mappings.where("from_curie != 'PART:0'"), "SUPPLIER", 2, ids)):
        n, found = shuffled_rows(spark, lambda find=find: {(x["query_id"], x["curie"], x["distance"]) for x in find().collect()})
        assert n < 200_000
        assert found == want or found == {x for x in want if x[2] == 1} or found == {(b, c, 2) for p, s in by.items() if p != "PART:0" for b in s for c in s if b != c}
