"""Searches by name and resolved ids: hot keys are split, and only ids without an own answer go on."""

from pyspark.sql import functions as F

from weftgraph.operators import ontology


def test_a_synonym_of_very_many_terms_is_split(spark):
    many = spark.range(120_000).select(F.concat(F.lit("T:"), "id").alias("id"), F.concat(F.lit("name "), "id").alias("name"))
    odd = spark.createDataFrame([("T:a", "Heart Failure"), ("T:a", "heart failure"), ("T:b", None), ("T:c", "Name 7")], "id string, name string")
    names = spark.createDataFrame([("NAME 7",), ("NAME 7",), ("name 7",), ("Failure, Heart",), ("nothing",), (None,)], "name string")
    out = ontology.name_search(names, many.unionByName(odd), many.select("id", F.lit("None").alias("synonym")))
    assert "_salt" in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("Failure, Heart", "T:a"), ("NAME 7", "T:7"), ("NAME 7", "T:c"), ("name 7", "T:7"), ("name 7", "T:c")]


def test_ids_with_an_answer_go_no_further(spark):
    ids = spark.createDataFrame([("A:1",), ("A:2",), ("A:3",), ("D:9",)], "id string")
    terms = spark.createDataFrame([("D:9",), ("A:3",)], "id string")
    xrefs = spark.createDataFrame([("D:1", "A:1"), ("D:1", "D:7"), ("B:2", "A:2"), ("B:2", "D:2"), ("B:2", "D:2"), ("A:3", "D:3"), ("D:9", "D:8")], "id string, xref string")
    out = ontology.ids_to_vocabulary(ids, terms, xrefs, "D")
    assert "Window" not in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("A:1", "D:1"), ("A:2", "D:2"), ("A:3", "D:3"), ("D:9", "D:9")]
