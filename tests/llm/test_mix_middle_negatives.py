"""Source mixing, fill-in-the-middle and hard negatives against brute force and odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import maxproduct, middle, mixing, negatives


# hard negatives


def brute_negatives(rows, is_anchor, k=5, m=3, low=50, high=95):
    """rows: (vec_id, vector, label) of those that take part."""
    w = [[int(min(1e308, np.floor(256 * float(x)))) for x in v] for _, v, _ in rows]
    out = []
    for a, (i, _, label) in enumerate(rows):
        if not is_anchor(i):
            continue
        found = [(-sum(x * y for x, y in zip(w[a], w[b])), j, b, other) for b, (j, v, other) in enumerate(rows) if b != a and len(w[b]) == len(w[a])]
        found = sorted((-max(-(2**63), min(2**63 - 1, -s)), j, b, other) for s, j, b, other in found)
        for s, p, *_ in [f for f in found if f[3] == label][:k]:
            hard = [f for f in found if f[3] != label and low * -s <= 100 * -f[0] <= high * -s][:m]
            out += [(i, p, r + 1, f[1], -s, -f[0]) for r, f in enumerate(hard)]
    return sorted(out)


def asked(df, is_anchor, **settings):
    got = negatives.hard_negatives(df, is_anchor, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "BLOCK", 25)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    r = np.random.default_rng(3)
    near = r.normal(size=(4, 6))
    rows = [(i, (near[i % 4] * r.uniform(0.1, 3) + r.normal(size=6) * 0.4).round(3).tolist(), int(r.integers(0, 3))) for i in range(240)]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(20, [0.0] * 6, 1), (1000, rows[20][1], 2), (1010, [1.0, 2.0], 1), (1020, [1.0, 2.0], 1), (1021, [1.0, 1.5], 0)]
    rows += [(-10, rows[3][1], 0), (2**62 + 1, rows[3][1], 0), (2000, [-x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*x, "other") for x in rows], "vec_id long, embedding array<double>, label int, row string").repartition(5)
    assert asked(df, F.col("vec_id") % 10 == 0) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert asked(df, F.col("vec_id") % 10 == 0, positives=2, negatives=4, low=20, high=100) == brute_negatives(rows, lambda i: i % 10 == 0, 2, 4, 20, 100)


def test_negatives_of_huge_and_hot_vectors(spark):
    """A label with most rows, copies, and components far over 53 bits."""
    rows = [(i, [1.0, float(i % 5)], 0 if i % 6 else 1) for i in range(120)] + [(200 + i, [1e14 * (i + 1), 3.0], i % 2) for i in range(6)] + [(300, [1e307, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert asked(df, F.col("vec_id") % 50 == 0) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_rows_without_numbers_take_no_part(spark):
    schema = "vec_id long, embedding array<float>, label int"
    good = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.7], 0)]
    odd = [(None, [1.0, 1.0], 1), (3, None, 1), (4, [], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 0), (8, [0.7, 0.7], None)]
    df = spark.createDataFrame(good + odd, schema)
    assert asked(df, F.col("vec_id") == 0) == brute_negatives(good, lambda i: i == 0) != []
    assert asked(spark.createDataFrame([], schema), F.col("vec_id") == 0) == []
    assert asked(df.where("label = 1"), F.col("vec_id") == 0) == []


def test_top_products_decide_by_rows(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.25, 0.0]), (3, [1e200, 0.0]), (4, [1e308, 1.0])]
    got = maxproduct.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 2**63 - 1), (4, 2**63 - 1), (1, 65536), (1, 65536), (2, 32768)]


# mixing


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by giving out the excess again and again, and what each row takes by walking each source's order."""
    sizes = defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        sizes[s] += count(t)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] < level * weight[s]}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
    out = []
    for s in names:
        budget, own = int(target[s] + 0.5), sorted((hashlib.md5(f"{'null' if i is None else i}|{count(t)}".encode()).hexdigest()[:15], i is None, i or 0, count(t)) for i, t, x in rows if x == s)
        taken = [0] * len(own)
        while budget and sizes[s]:
            for j, (*_, n) in enumerate(own):
                taken[j] += min(n, budget)
                budget -= min(n, budget)
        out += [(None if null else i, n, sizes[s], target[s], x) for (_, null, i, n), x in zip(own, taken)]
    return out


def same_mix(got, want):
    pair = lambda rows: sorted((repr(r[0]), *r[1:3], r[4], r[3]) for r in rows)
    a, b = pair(got), pair(want)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert [x[4] for x in a] == pytest.approx([x[4] for x in b])


def test_mix_matches_a_walk(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 10)
    monkeypatch.setattr(mixing, "COPIES", 4)
    r = np.random.default_rng(5)
    rows = [(i, " ".join("w" * k for k in range(1, int(r.integers(1, 40)))), str(r.choice(["b", "a", "é", "", "\U0001f600", "z"], p=[0.5, 0.02, 0.1, 0.08, 0.1, 0.2]))) for i in range(150)]
    rows += [(None, "no id", "b")] * 9 + [(3, rows[3][1], rows[3][2])] * 6 + [(500, None, "b"), (501, "", None), (502, "one two", None), (503, " \t\x0b ", "only space"), (504, "no break  wide", "a"), (505, "x " * 3000, "a")]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, source string, size int, target double").repartition(3)
    got = mixing.mixed(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    same_mix(got, brute_mix(rows))
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(df.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    by = Counter()
    for x in mixing.mixed(df).collect():
        assert 0 <= x["taken"] <= 2 * x["size"]
        by[x["source"], x["target"]] += x["taken"]
    assert all(abs(n - t) <= 0.5 for (_, t), n in by.items())
    same_mix(mixing.mixed(df, weights=(1, 5), share=2.5, most=3).select("doc_id", "size", "source_size", "target", "taken").collect(), brute_mix(rows, (1, 5), 2.5, 3))


def test_the_mixture_holds_what_the_mix_takes(spark):
    rows = [(i, f"doc {i} " + "word " * (i % 7), "ab"[i % 2]) for i in range(60)] + [(None, "same size", "a"), (None, "other text", "a"), (4, "doc 4 word word word word ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, given = mixing.mixed(df).collect(), Counter((s, i, t) for i, t, s in rows)
    got = mixing.mixture(df).collect()
    counts = Counter()
    for x in got:
        counts[x["source"], x["doc_id"]] += len(x["text"].split())
    want = Counter()
    for x in plan:
        want[x["source"], x["doc_id"]] += x["taken"]
    assert +counts == +want
    whole = [x for x in got if (x["source"], x["doc_id"], x["text"]) in given]
    assert len(got) - len(whole) <= 2  # one cut document a source
    assert max(Counter((x["source"], x["doc_id"], x["text"], x["epoch"]) for x in whole).values()) <= 2


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mixed(spark.createDataFrame([(1, None, None), (1, "", "a")], schema)).collect()
    assert [(r["target"], r["taken"], r["source_size"]) for r in got] == [(0.0, 0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([], schema), share=3)


def test_mix_stays_in_the_jvm(spark, sf_dir):
    plan = mixing.op12_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# fill in the middle


def brute_middle(i, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{mid}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(units), form, len(prefix), len(mid), out


def test_middles_match_brute_force(spark):
    texts = ["", None, "a", "é", "One two  three.\n", "<", "<P", "P>S><", "a<P>b", "x<M>", "<S>", "日本語 text\U0001f600!", "<<<>>>SMP<", "abc" * 50_000 + "é" * 70_000, "\x00\x7f\x80"]
    rows = [(i * 37 + k, t) for k, t in enumerate(texts) for i in range(12)] + [(None, "no id")] * 2 + [(2**63 - 1, "last"), (-(2**63), "first one")]
    df = spark.createDataFrame([(*r, "p", 0) for r in rows], "doc_id long, text string, form string, n int")
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], repr(r["prefix_chars"]), repr(r["middle_chars"]), bytes(r["output"]), bytes(r["restored"])) for r in middle.middles(df).collect())
    want = []
    for i, t in rows:
        n, form, p, m, out = brute_middle(i, t)
        want.append((repr(i), n, form, repr(p), repr(m), out.encode(), (t or "").encode()))
    assert got == sorted(want)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert middle.middles(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rotation_at_all_cuts(monkeypatch):
    monkeypatch.setattr(middle, "STEP", 3)
    given = bytes(range(17))
    for start in range(5):
        for cut in range(start, 17):
            for end in range(cut, 18):
                b = bytearray(given)
                middle.rotate(b, start, cut, end)
                assert bytes(b) == given[:start] + given[cut:end] + given[start:cut] + given[end:]
                middle.rotate(b, start, start + end - cut, end)
                assert bytes(b) == given


def test_given_documents_restore(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id")["text"]
    for r in middle.middles(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        assert bytes(r["restored"]).decode() == docs[r["doc_id"]]
        assert bytes(middle.restored(bytes(r["output"]), r["form"])).decode() == docs[r["doc_id"]]
