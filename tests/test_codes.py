"""Texts are numbers and come back as they were."""

import pytest

from weftgraph.functions import codes

TEXTS = ["A:1", "A:0", "A:007", "A:07", "A:1:5", "A:", ":", "A:12345678901234", "A:+5", "A:-5", "A: 5", "A:5 ", "A:٣", "A:1x", "B#000000012", "B#12", "B:#5", "B#:5", "x", "", "7", "|", "-1|x", "0|A:", "ä:3", "A:1.0", "A:00", None]


@pytest.mark.parametrize("some", [TEXTS, ["A:1", "A:22", None], ["A:1", "B:1"], ["C#001"], ["x", "y"], [None], []])
def test_texts_come_back(spark, some):
    df = spark.createDataFrame([(x,) for x in some], "x string")
    [coding] = codes.codings(df, [["x"]])
    rows = df.select("x", coding.code(df["x"]).alias("n")).select("x", "n", coding.text(codes.F.col("n")).alias("back")).collect()
    assert [r["back"] for r in rows] == [r["x"] for r in rows]
    assert len({r["n"] for r in rows}) == len(set(some))
    other = spark.createDataFrame([(x,) for x in ("Z:1", "A:01", "A:1:", "zz")], "x string").select(coding.code(codes.F.col("x")).alias("n"))
    assert some is TEXTS or [r["n"] for r in other.collect()] == [None] * 4


def test_many_forms_stay_texts(spark):
    df = spark.createDataFrame([(f"{chr(97 + i % 26)}{i}x", f"G:{i}", f"H:{i}") for i in range(600)], "x string, g string, h string")
    assert codes.codings(df, [["x"], ["g", "h"], ["g"]]) == [None, codes.Coding(("0|G:", "0|H:")), codes.Coding(("0|G:",))]
