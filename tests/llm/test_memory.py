"""What Python workers hold: one operator a task, and memory given back by groups too."""

import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from weftgraph.llm import jaccard, repeats, shared


def test_repeated_passages_need_one_worker_a_task(spark):
    text = "a passage of more than fifty bytes, é included, that two documents hold"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "x" + text, "en", "s", 1), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, text, len(text)), (2, "x", 1), (3, "", 0)}


@pytest.mark.parametrize("size, calls", [(10, 0), (200_000, 1)])
def test_groups_give_memory_back(monkeypatch, size, calls):
    gone = []
    monkeypatch.setattr(shared, "FORGET", [lambda: gone.append(1)])
    h, s, d = (pa.array([1, 2]).to_numpy().astype("uint64") for _ in range(3))
    table = pa.table({"block": [1], "bucket": [0], "payload": [repeats.told_of(h, s, d.astype("int64"))]})
    assert shared.freed(repeats.judge_segments)(table).num_rows == 1 and len(gone) == 1
    group = pd.DataFrame({"node": [1], "side": [0], "cross": [False], "shingles": [bytes(8 * size)]})
    jaccard.checked(0.8)(group)
    assert len(gone) == 1 + calls
