"""Edges that levels read are made once, and many are dealt out with the ids that they start from."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_hubs import shuffled_rows
from weftgraph.operators import joins, typegraph


def graph(spark, n=3000):
    """A to B to C to D, each edge said twice and made distinct."""
    rows = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("k"))
    steps = [rows.select(F.concat(F.lit(f"{a}:"), "k").alias("s"), F.lit(f"to_{b}").alias("p"), F.concat(F.lit(f"{b}:"), "k").alias("o")).distinct() for a, b in ("AB", "BC", "CD")]
    return steps[0].union(steps[1]).union(steps[2]).select(F.lit("g").alias("g"), "s", "p", "o")


def test_chains_make_their_edges_once(spark):
    quads = graph(spark)
    n, rows = shuffled_rows(spark, lambda: typegraph.translate_chain(spark.range(3000).select(F.concat(F.lit("A:"), "id").alias("id")), quads, list("ABCD")).collect())
    assert len(rows) == 9000 and n < 45_000


@pytest.mark.parametrize("rows", [10, 500_000])
def test_levels_that_are_dealt_out_lose_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "TASK_ROWS", rows)
    r = random.Random(2)
    edges = {(f"{a}:{r.randrange(30)}", f"{a}{b}", f"{b}:{r.randrange(9)}") for a, b in ("AB", "BC", "BB") for _ in range(90)} | {("A:1", "AB", None), (None, "BC", "C:1")}
    quads = spark.createDataFrame([(g, *e) for e in edges for g in ("x", "y")], "g string, s string, p string, o string")
    program = spark.createDataFrame([(0, "A", ["AB"]), (1, "B", ["BB", "BC"])], "level int, node_type string, ops array<string>")
    ids = [f"A:{i % 20}" for i in range(40)] + [None]
    got = typegraph.execute_program(program, spark.createDataFrame([(x,) for x in ids], "id string"), quads)
    first = {(0, s, p, o) for s, p, o in edges if p == "AB" and s in ids}
    second = {(1, s, p, o) for s, p, o in edges if p != "AB" and s in {x[3] for x in first if x[3]}}
    found = [tuple(x) for x in got.select("level", "source_id", "predicate", "target_id").collect()]
    assert len(found) == len(set(found)) and set(found) == first | second


def test_many_edges_are_dealt_out_by_their_number(spark, monkeypatch):
    """200 pairs of 16 lines a task: more tasks than a shuffle has by itself."""
    monkeypatch.setattr(joins, "TASK_ROWS", 16)
    edges = spark.createDataFrame([(f"A:{i}", "AB", f"B:{i}") for i in range(200)], "s string, p string, o string")
    there = typegraph.execute_program(spark.createDataFrame([(0, "A", ["AB"])], "level int, node_type string, ops array<string>"), edges.select(F.col("s").alias("id")), edges, checked=False)
    assert there.count() == 200 and len(there.inputFiles()) >= 10
