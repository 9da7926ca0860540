"""Operators for deep graphs, hot keys, many points and many patterns, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import filters, joins, measures, nearest, ontology, patterns, patterntable, typegraph


# patterns


def brute_matches(labels, asked):
    return {(p, i) for p in asked if p is not None for i, x in labels if x is not None and re.search(p, x, re.I | re.A)}


ASKED = ["asthma", "^Asth", "thma$", "", None, "a.c", "colou?r", "(ab)+c", "(ab)*c", "x{2}y", "[abc]sthma", r"\d+", r"a\.c", "asthma|cold", "as(th|t)ma", "(?:no)?cold", "b+c?", "(a(bc)?d)e", "zzz", "C.*D$", "q|", "a{0,2}b", "^$", "ä", "A[.]c", "(?!x)abc", "f(oo|o)", "ab+?c", "(xy){1,2}z", r"\bcold\b", "[^a]b", "cold|", "yes|no|maybe", "s+"]
LABELS = ["Asthma", "ASTHMATIC", "a.c", "abc", "color", "COLOUR", "ababc", "c", "xxy", "", None, "cold", "a cold day", "ade", "abcde", "Ä", "foo", "12", "nocold", "a b\nc d", "xyxyz", "maybe not", "b"]


def test_pattern_tables_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(patterntable, "SCANNED", 5)
    labels = list(enumerate(LABELS)) + [(100, "Asthma")]
    df = spark.createDataFrame(labels, "id int, label string")
    asked = spark.createDataFrame([(p, 1) for p in ASKED + ASKED[:3]], "pattern string, id int")
    for gram in (2, 8):
        got = [(r["pattern"], r["id"]) for r in patterntable.matching_table(df, asked, gram).collect()]
        assert len(got) == len(set(got))
        # Python folds no "Ä" in ASCII mode, and neither does the JVM
        assert set(got) == brute_matches(labels, ASKED)


def test_required_runs(spark):
    known = {"asthma": ["asthma"], "colou?r": ["colo", "r"], "(ab)+c": ["ab", "c"], "(ab)*c": ["c"], "x{2}y": ["y"], r"a\.cd": ["a", "cd"], "as(th|t)ma": [], "(?!x)abc": [], "a(bc(d)?e)f": ["a", "bc", "e", "f"], "": [], "b+c?": ["b"], "[abc]sthma": ["sthma"], "(a": []}
    df = spark.createDataFrame([(p,) for p in known], "p string").select("p", patterntable.required(F.col("p")).alias("r"))
    assert {r["p"]: r["r"] for r in df.collect()} == known


def test_a_thousand_patterns_meet_by_their_runs(spark):
    labels = [(i, f"drug {i % 97} of class {i % 13} number {i}") for i in range(600)]
    asked = [f"number {i}$" for i in range(700)] + [f"drug {i} .* {i % 13}" for i in range(300)]
    got = patterntable.matching_table(spark.createDataFrame(labels, "id int, label string"), spark.createDataFrame([(p,) for p in asked], "pattern string"))
    assert {(r["pattern"], r["id"]) for r in got.collect()} == brute_matches(labels, asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# radius


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("scale", [0.5, 40.0, 900.0, 4000.0])
def test_points_round_places_match_brute_force(spark, scale):
    r = random.Random(scale)
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(250)] + [(900 + i, 35.0, -79.0) for i in range(100)]
    points += [(500, 90.0, 0.0), (501, -90.0, 10.0), (502, 0.0, 180.0), (503, 0.0, -180.0), (504, 89.9, 100.0), (505, None, 1.0), (506, 1.0, None), (507, 0.0, 179.9999)]
    places = [(f"p{i}", r.uniform(-90, 90), r.uniform(-180, 180), scale * r.uniform(0.1, 1)) for i in range(40)] + [(f"q{i}", *points[i][1:], scale) for i in range(20)]
    places += [("north", 89.99, 12.0, scale), ("south", -90.0, 0.0, scale), ("line", 0.0, -179.9999, scale), ("none", 10.0, 10.0, None), ("minus", 35.0, -79.0, -1.0), ("zero", 35.0, -79.0, 0.0), ("lost", None, 1.0, 5.0)]
    got = filters.within_radius_of(spark.createDataFrame([(*p, "x") for p in points], "i int, lat double, lon double, radius_km string"), spark.createDataFrame(places, "place string, lat double, lon double, radius_km double"))
    want = {(i, p) for i, a, b in points if a is not None and b is not None for p, c, d, km_ in places if c is not None and km_ is not None and km_ >= 0 and km(a, b, c, d) <= km_}
    rows = got.collect()
    assert {(x["i"], x["place"]) for x in rows} == want and len(rows) == len(want)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan


def test_no_places(spark):
    points = spark.createDataFrame([(1.0, 1.0)], "lat double, lon double")
    assert filters.within_radius_of(points, spark.createDataFrame([], "place string, lat double, lon double, radius_km double")).count() == 0


# deep graphs


def brute_closure(edges):
    up = defaultdict(set)
    for a, b in edges:
        if a != b:
            up[a].add(b)
    out = {}
    for a in list(up):
        now, depth, seen = {a}, 0, {a}
        while now:
            depth += 1
            now = {y for x in now for y in up.get(x, ())} - seen
            seen |= now
            out |= {(a, y): depth for y in now}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closures_of_odd_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(f"t{r.randrange(40)}", f"t{r.randrange(40)}") for _ in range(55)] + [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("c20", "c15"), ("c3", None), ("t1", "t1")]
    df = spark.createDataFrame(edges, "child string, parent string")
    want = brute_closure([e for e in edges if None not in e])
    assert {(x["id"], x["ancestor"]): x["depth"] for x in ontology.closure(df).collect()} == want
    assert {(x["id"], x["ancestor"]): x["depth"] for x in ontology.closure(df, max_depth=3).collect()} == {k: d for k, d in want.items() if d <= 3}
    roots = ["t3", "c17", "none"]
    got = [x["id"] for x in ontology.below(df, spark.createDataFrame([(x,) for x in roots], "id string")).collect()]
    cycle = {x for x in roots if any((x, y) in want and (y, x) in want for _, y in want)}  # a root on a cycle stands below itself
    assert len(got) == len(set(got)) and set(got) - cycle == {a for a, b in want if b in roots} - cycle


def test_a_chain_of_ten_thousand_terms(spark):
    """In as many rounds as the logarithm of its depth, and without a closure."""
    edges = spark.range(10_000).select(F.concat(F.lit("T:"), "id").alias("child"), F.concat(F.lit("T:"), F.col("id") + 1).alias("parent"))
    got = ontology.below(edges, spark.createDataFrame([("T:7000",), ("T:9000",)], "id string"))
    assert got.count() == 9000
    assert got.where("id = 'T:6999'").count() == 1 and got.where("id = 'T:9000'").count() == 0
    short = edges.where("child in ('T:0', 'T:1', 'T:2', 'T:3', 'T:4', 'T:5', 'T:6', 'T:7', 'T:8')")
    assert ontology.closure(short).count() == 45


def test_a_ladder_of_a_million_paths(spark):
    """Two types on each of twenty levels, all linked with both of the next: paths are counted, programs compiled, none is made."""
    rungs = [("S", f"L1{x}", "l", "o") for x in "ab"] + [(f"L{i}{x}", f"L{i + 1}{y}", f"l{y}", "o") for i in range(1, 20) for x in "ab" for y in "ab"] + [(f"L20{x}", "E", "l", "o") for x in "ab"]
    moves = spark.createDataFrame(rungs + [("L5a", "S", "back", "o"), ("S", "E", "UNKNOWN", "o")], "src_type string, dst_type string, link string, op string")
    found = typegraph.predecessors(moves, "S")
    assert found.count() == len(rungs)
    counts = {r["node"]: (r["level"], int(r["paths"])) for r in typegraph.path_counts(found, "S").where("node in ('S', 'L1a', 'L20b', 'E')").collect()}
    assert counts == {"S": (0, 1), "L1a": (1, 1), "L20b": (20, 2**19), "E": (21, 2**20)}
    program = typegraph.program_of(moves, "S", spark.createDataFrame([("E",), ("L2a",)], "t string")).collect()
    assert len(program) == 1 + 2 * 20 + 1 + 2 and {tuple(r["ops"]) for r in program if r["dst_type"] == "E" and 0 < r["level"] < 20} == {("la", "lb")}
    assert typegraph.program_of(moves, "S", spark.createDataFrame([("none",)], "t string")).count() == 0


# hot keys


def test_hubs_are_split(spark):
    rows = [(i, "hub" if i % 3 == 0 else f"k{i % 50}") for i in range(300)]
    facts = [(f"v{i}", "hub" if i % 10 == 0 else f"k{i % 80}") for i in range(2000)] + [("null", None)]
    a, b = spark.createDataFrame([*rows, (9999, None)], "i int, k string"), spark.createDataFrame(facts, "v string, k string")
    want = Counter((i, v) for i, k in rows for v, x in facts if x == k)
    for heavy, size in ((10**9, 10), (50, 20), (0, 1)):
        got = joins.split_join(a, b, "k", heavy, size)
        assert Counter((r["i"], r["v"]) for r in got.collect()) == want and set(got.columns) == {"i", "k", "v"}


def test_synonyms_round_a_hub(spark, monkeypatch):
    """One identifier with a tenth of all mappings, split over tasks of even size."""
    rows = [("HUB:0", f"A:{i}", "x") for i in range(60)] + [(f"B:{i % 90}", f"A:{i}", "y") for i in range(540)]
    df = spark.createDataFrame(rows, "from_curie string, to_curie string, source_prefix string")
    plain = sorted(map(tuple, ontology.khop(df, 2).select("query_id", "curie", "distance").collect()))
    sizes = []

    def split(rows, facts, key, heavy=20, size=10):
        out = joins.split_join(rows, facts, key, heavy, size)
        sizes.append(facts.groupBy(key).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ontology, "split_join", split)
    assert sorted(map(tuple, ontology.khop(df, 2).select("query_id", "curie", "distance").collect())) == plain and sizes == [60]


def test_new_links_move_only_what_they_touch(spark):
    r = random.Random(4)
    old = [(f"n{r.randrange(400)}", f"n{r.randrange(400)}") for _ in range(180)]
    new = [(f"n{r.randrange(420)}", f"n{r.randrange(420)}") for _ in range(12)] + [("new1", "new0"), ("n5", "n5"), (None, "n1")]
    later = [("new0", "n3"), ("m", "n7")]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    labels = ontology.reachable_min(frame(old))
    first = patterns.extended(labels, frame(new))
    second = patterns.extended(patterns.renamed(labels, [first]), frame(later))
    got = patterns.renamed(labels, [first, second])
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in ontology.reachable_min(frame(old + new + later)).collect()}
    assert got.count() == got.select("id").distinct().count()
    assert first[0].count() <= 2 * len(new) and first[1].count() <= 2 * len(new)


def test_roll_ups_are_the_buckets(spark):
    r = random.Random(2)
    rows = [(f"e{i % 3}", datetime(2011, 1, 1) + timedelta(minutes=r.randrange(60 * 24 * 60)), r.uniform(0, 9)) for i in range(500)] + [("e0", datetime(1969, 12, 30, 5), 1.0), ("none", datetime(2011, 1, 1), None)]
    df = spark.createDataFrame(rows, "exposure_type string, ts timestamp, value double")
    hours = measures.partials(df)
    got = {(x["exposure_type"], x["resolution"], x["bucket"]): (x["avg"], x["max"]) for x in measures.rolled_up(hours).collect()}
    want = {}
    for resolution in measures.RESOLUTIONS:
        high = {(x["exposure_type"], x["bucket"]): x["value"] for x in measures.time_buckets(df, resolution, "max").collect()}
        for x in measures.time_buckets(df, resolution, "avg").collect():
            want[x["exposure_type"], resolution, x["bucket"]] = (x["value"], high[x["exposure_type"], x["bucket"]])
    assert got.keys() == want.keys()
    for k, (a, m) in want.items():
        assert got[k][1] == m and (got[k][0] is None) == (a is None) and (a is None or got[k][0] == pytest.approx(a))


def test_given_vectors_are_found_by_probes(spark, sf_dir):
    from weftgraph import registry

    exact = {(r["term"], r["partner"]) for r in registry.topk_similar(spark, sf_dir).collect()}
    got = {(r["term"], r["partner"]) for r in registry.topk_similar_probed(spark, sf_dir).collect()}
    assert len(got & exact) >= 0.9 * len(exact) and exact


def test_probes_reach_the_recall(spark):
    """Clustered vectors: most exact neighbours from a few of the buckets; verified similarities are exact."""
    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(f"t{i:03}", [x + r.gauss(0, 0.2) for x in centres[i % 30]]) for i in range(600)] + [("zero", [0.0] * 12), ("short", [1.0]), ("none", None)]
    df = spark.createDataFrame(rows, "term string, vec array<double>")
    terms = df.select("term").where("term < 't200'")
    exact = {(x["term"], x["partner"]): x["similarity"] for x in measures.most_similar(df.where("size(vec) = 12 and term != 'zero'"), terms, 10).collect()}
    got, recall, share = nearest.most_similar_probed(df, terms, 10)
    rows = {(x["term"], x["partner"]): x["similarity"] for x in got.collect()}
    hits = rows.keys() & exact.keys()
    assert recall >= 0.95 and len(hits) >= 0.9 * len(exact) and share < 0.35
    assert all(rows[p] == pytest.approx(exact[p], abs=2e-6) for p in hits) and max(Counter(t for t, _ in rows).values()) == 10
    whole, recall, share = nearest.most_similar_probed(df, terms, 10, recall=1.0, sample=10**6)
    assert {(x["term"], x["partner"]) for x in whole.collect()} == exact.keys() and recall == 1.0
    assert nearest.most_similar_probed(df.limit(0), terms)[0].count() == 0


def test_runs_are_never_broadcast(spark):
    """Runs are many more than a plan estimates: no join on them collects a side on the driver."""
    labels = spark.createDataFrame([("a", "Asthma"), ("b", "Blue")], "id string, label string")
    names = spark.createDataFrame([("asth",), ("lu",)], "name string")
    for found in (patterns.containing(labels, names), patterntable.matching_table(labels, names.withColumnRenamed("name", "pattern"))):
        assert sorted(r["id"] for r in found.collect()) == ["a", "b"]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_distinct_joins_that_keep_their_key_are_not_made_distinct_again(spark):
    rows = [("g", f"a{i % 9}", "one", f"c{i % 4}") for i in range(80)] + [("g", f"c{i % 4}", "two", f"b{i % 7}") for i in range(60)]
    quads = spark.createDataFrame(rows, "g string, s string, p string, o string")
    want = {(s, o, b) for _, s, p, o in rows if p == "one" for _, c, q, b in rows if q == "two" and c == o}
    ask = [("?a", "one", "?c"), ("?c", "two", "?b")]
    whole = patterns.bgp(quads, ask, ["a", "c", "b"], distinct=True)
    assert not whole._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    assert sorted(map(tuple, whole.collect())) == sorted(want)
    assert sorted(map(tuple, patterns.bgp(quads, ask, ["a", "b"], distinct=True).collect())) == sorted({(a, b) for a, _, b in want})
    assert sorted(r[0] for r in patterns.bgp(quads, ask[:1], ["c"], distinct=True).collect()) == sorted({o for _, _, p, o in rows if p == "one"})
    none = [("?x", "one", "?y"), ("?y", "none", "?z")]  # a test that nothing passes
    assert patterns.bgp(quads, ask + none, ["a", "b"], distinct=True).isEmpty()
