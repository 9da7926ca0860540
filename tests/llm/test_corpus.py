"""Near duplicates, repeats, leaks, resampling, search, sharding and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import decontaminate, jaccard, maxproduct, repeats, resampling, sharding, tokencount
from weftgraph.llm.shared import CHARACTERS, components, salted_join, shared_dir, shingle_hashes, word_hashes


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def word_list(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text, n=5):
    w = word_list(text)
    n = min(n, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_classes(docs, similarity=0.8):
    """doc_id to (class, links) by comparing all pairs."""
    sets = {i: frozenset(shingles(t)) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    distinct = {}
    for i in sorted(sets):
        if sets[i]:
            distinct.setdefault(sets[i], i)
    links = Counter()
    keys = list(distinct)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            both = len(a & b)
            if both and both >= similarity * (len(a) + len(b) - both) - 1e-9:
                links[distinct[a]] += 1
                links[distinct[b]] += 1
                p, q = sorted((find(distinct[a]), find(distinct[b])))
                parent[q] = p
    for i, s in sets.items():
        if s and find(i) != find(distinct[s]):
            p, q = sorted((find(i), find(distinct[s])))
            parent[q] = p
    return {i: (find(i), links[distinct[s]] if s else 0) for i, s in sets.items()}


def edited(words, at):
    return " ".join("new" if i == at else w for i, w in enumerate(words))


def test_near_duplicates_match_all_pairs(spark, documents):
    base = [f"w{i}" for i in range(120)]
    rows = list(zip(documents["doc_id"].tolist(), documents["text"]))
    rows += [(1000 + i, edited(base, i)) for i in range(0, 60, 3)] + [(2000 + i, " ".join(base)) for i in range(5)]
    rows += [(3000, ""), (3001, None), (3002, "..."), (3003, "one two"), (3004, "One, two!"), (3005, "three")]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, "one two", 0), (3003, "one two", 0)], "doc_id long, text string, class_id int")
    got = jaccard.join_near(df, block=7).toPandas()
    assert len(got) == len(rows) + 2 and got["doc_id"].isna().sum() == 1
    want = brute_classes(rows)
    named = got[got["doc_id"].notna()]
    assert {int(r.doc_id): (int(r.class_id), r.n_links) for r in named.itertuples()} == want
    assert named.set_index("doc_id")["n_copies"][2000] == 5
    assert jaccard.join_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_those_of_the_pattern():
    texts = ["", None, "İ_x ΣΑΣ 12½", "a" * (CHARACTERS + 7) + " b c", "x y2 " * CHARACTERS, "\ud800 q", "q b c"]
    known = {}
    for text, hashes in zip(texts, word_hashes(texts)):
        found = word_list(text)
        assert len(found) == len(hashes)
        for w, h in zip(found[:1000], hashes.tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_prefixes_shorten_until_the_recall():
    few = [0] * jaccard.BINS
    k = jaccard.prefix_length(few, jaccard.LONGEST, 0.8)  # one pair at the threshold
    assert jaccard.chance(0.8, k) >= jaccard.RECALL > jaccard.chance(0.8, k + 1)
    high = [0] * (jaccard.BINS - 1) + [10**6]
    assert jaccard.prefix_length(high, jaccard.LONGEST, 0.8) == jaccard.LONGEST
    low = [10**6] + [0] * (jaccard.BINS - 1)
    assert jaccard.prefix_length(low, jaccard.LONGEST, 0.8) == k
    assert jaccard.prefix_length(low, 3, 0.8) == 3


def test_tries_link_all_nodes_of_a_prefix(spark):
    """Runs of one prefix, in one batch or many, make one component."""
    rng = np.random.default_rng(12)
    labels = [[int(x) << 56 | int(y) for x, y in zip(rng.integers(0, 3, 2), rng.integers(0, 9, 2))] for _ in range(300)]
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "node long, labels array<long>")
    leaves = kept_table(spark, jaccard.tries(nodes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        links = jaccard.linked(leaves, 1, shared_dir(spark)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for tree in range(2):
        assert {(labels[r["a"]][0] >> 56, labels[r["a"]][1] >> 56) for r in links}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links), shared_dir(spark)).collect()}
    parent = {i: i for i in range(300)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for tree in range(2):
        first = {}
        for i, v in enumerate(labels):
            j = first.setdefault(v[tree] >> 56, i)
            p, q = sorted((find(i), find(j)))
            parent[q] = p
    assert got == {i: find(i) for i in range(300)}


def test_near_duplicates_of_long_texts_sizes_and_repeated_ids(spark):
    """Blocks by size class, a long text, one doc_id with two texts, repeated rows: as by all pairs."""
    rng = np.random.default_rng(13)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [(i, " ".join(base[: 395 - 5 * i])) for i in range(60)]  # a chain of growing differences
    long = [f"v{x}" for x in rng.integers(0, 10**6, 60_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[:-3000])), (502, " ".join(long[:-20000]))]
    df = spark.createDataFrame(rows + [(0, rows[0][1])] * 50 + [(7, "another text of the same id")], "doc_id long, text string")
    want = brute_classes(rows)
    got = [r for r in jaccard.join_near(df, block=9).collect() if (r["doc_id"], r["n_links"]) != (7, 0)]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want and len(got) == len(rows) + 50
    assert want[501] == (500, 1) and want[502][0] == 502 and want[59][0] == 0
    assert {r["n_copies"] for r in got if r["doc_id"] == 0} == {51}


def test_salted_joins_are_joins(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(500)], "k long, v long")
    facts = spark.createDataFrame([(i, i * i) for i in range(2, 7)], "k long, f long")
    for how in ("inner", "left"):
        got = salted_join(rows, facts, "k", how).select("k", "v", "f").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, rows.join(facts, "k", how).select("k", "v", "f").collect()))


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {i: find(i) for i in parent}


def brute_repeats(docs):
    first = {}
    for i, t in sorted((i, t) for i, t in docs if i is not None):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if i is not None and first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum())
        out.append((i, len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def plain(df):
    rows = []
    for r in df.collect():
        rows.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("parts", [1, 3])  # in one part, the common passage is a hot minimizer
def test_repeats_match_brute_force(spark, documents, parts):
    rng = np.random.default_rng(1)
    some = documents.head(60)
    common = "a passage of twenty+ bytes"
    rows = list(zip(some["doc_id"].tolist(), some["text"]))
    rows += [(1000 + i, "".join(rng.choice(list("abcdef "), 40)) + common + "".join(rng.choice(list("abcdef "), 60))) for i in range(60)]
    rows += [(-3, "a" * 300), (2000, "a" * 200), (2001, "ab" * 100), (2002, rows[2][1]), (2003, "é" * 60 + "a" * 60), (2004, rows[70][1]), (2005, ""), (2006, None), (2007, "x" * 49), (2008, "x" * 49), (None, rows[2][1]), (2004, rows[70][1])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, spans int").repartition(parts)
    got = repeats.remove_repeats(df, block_bytes=9000, bucket_bytes=20_000)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert plain(got) == sorted(brute_repeats([(i, (t or "").encode()) for i, t in rows]), key=repr)


def test_hot_minimizers_are_sent_string_by_string():
    """Segments around one frequent gram: all strings' verdicts are those of brute force."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    gram = "QQQQQQQQQQQQQQQQQQQQ"
    texts = ["".join(rng.choice(list("abcdefgh"), 45)) + gram + "".join(rng.choice(list("abcdefgh"), 45)) for _ in range(40)]
    texts += texts[:5]
    raw = [t.encode() for t in texts]
    x = repeats.Segments(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw]), np.arange(len(raw)) + 1, np.ones(len(raw), bool))
    h, s, d, line = x.sent()
    assert len(np.unique(h)) <= len(h) <= len(x.entry_at) and (np.diff(h.astype(object)) >= 0).all()
    table = pa.table({"block": [1], "bucket": [0], "payload": [repeats.told_of(h, s, d)]})
    state = np.frombuffer(repeats.judge_segments(table).column("payload")[0].as_py(), np.uint8)
    assert ((state == repeats.SPREAD) == (s == 0)).all()


def test_longest_previous_factors():
    texts = [b"banana", b"bandana", b"cabana", b"banana"]
    keys, docs, sizes = [], [], []
    for i, t in enumerate(texts):
        for p in range(len(t)):
            keys.append(t[p:])
            docs.append(i)
            sizes.append(len(t) - p)
    got = repeats.longest_previous_factors(np.array(keys, "S7"), np.array(sizes), np.array(docs))

    def factor(i):
        return max((next((n for n in range(min(len(a), len(keys[i])), -1, -1) if a[:n] == keys[i][:n]), 0) for a, d in zip(keys, docs) if d < docs[i]), default=0)

    assert got.tolist() == [factor(i) for i in range(len(keys))]


def brute_leaks(docs, items, similarity=0.8):
    out = {}
    for i, t in docs:
        w = word_list(t)
        for k, b in items:
            n, s = len(word_list(b)), shingles(b)
            for start in range(len(w) - n + 1) if n else ():
                own = shingles(" ".join(w[start : start + n]))
                least = sum((own & s).values())
                score = least / (sum(own.values()) + sum(s.values()) - least)
                if score >= similarity and score > out.get((i, k), (0,))[0]:
                    out[i, k] = (score, start, n)
    return out


def test_leaks_match_brute_force(spark, documents, sf_dir):
    items = [(r.item_id, r.text) for r in pd.read_parquet(f"{sf_dir}/benchmark.parquet").head(12).itertuples()]
    w = items[0][1].split()
    docs = [(r.doc_id, r.text[:900]) for r in documents.head(25).itertuples()]
    docs += [(900, "Before. " + items[1][1].upper() + " after"), (901, "x y z " + " ".join(w[:-1] + ["changed"]) + " q"), (902, " ".join(w[: len(w) // 2])), (903, items[2][1] + " " + items[2][1]), (904, ""), (905, None), (906, "two words"), (None, items[3][1])]
    items += [(500, "Two, words"), (501, ""), (502, None), (503, items[0][1])]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for a_pass in (2000, 5):
        got = decontaminate.contaminated(left, right, items_a_pass=a_pass).collect()
        assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["n_words"]) for r in got} == want
    assert (900, 1) in want and (901, 0) in want and (901, 503) in want and (906, 500) in want and (None, 3) in want
    assert decontaminate.contaminated(left, right.limit(0)).count() == 0
    assert decontaminate.contaminated(left.limit(0), right).count() == 0


def test_equal_benchmark_rows_are_one_item(spark):
    item = " ".join(f"word{i}" for i in range(12))
    items = spark.createDataFrame([(7, item)] * 40 + [(8, item), (None, None), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (1, f"before {item} after"), (2, "other words")], "doc_id long, text string")
    for a_pass in (2000, 3):
        got = decontaminate.contaminated(docs, items, items_a_pass=a_pass).collect()
        assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in got) == [(1, 7, 1.0, 1)] * 2 + [(1, 8, 1.0, 1)] * 2


def test_texts_shorter_than_an_item_leak(spark):
    """A text that is an item without some of its words is compared as a whole."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 400, n))) for i, n in enumerate((15, 38, 59, 59, 4, 6))] + [(6, "one two " * 20)]
    docs = [(100 * i + k, " ".join(t.split()[k // 2 : len(t.split()) - (k + 1) // 2])) for i, t in items for k in range(1, 16)]
    docs += [(9000, "v1 v2 v3"), (9001, ""), (9002, None)]
    want = {}
    for d, text in docs:
        own = shingles(text)
        for i, t in items:
            least = sum((own & shingles(t)).values())
            score = least / max(1, sum(own.values()) + sum(shingles(t).values()) - least)
            if len(word_list(text)) < len(word_list(t)) and score >= 0.8:
                want[d, i] = (score, 0, len(word_list(text)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["n_words"]) for r in got} == want
    assert (101, 1) in want and (210, 2) in want and (212, 2) not in want


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(3)
    items = decontaminate.Items([" ".join(f"v{x}" for x in rng.integers(0, 500, 20)) for _ in range(50)], 5)
    others = word_hashes([" ".join(f"v{x}" for x in rng.integers(0, 500, 20)) for _ in range(300)])
    prints = np.array([decontaminate.simhash(shingle_hashes(h)) for h in others], np.uint64)
    for flips in range(0, 28, 3):  # near ones too
        bits = np.array([sum(1 << int(b) for b in rng.choice(64, flips, replace=False)) for _ in range(50)], np.uint64)
        prints = np.r_[prints, items.print ^ bits]
    place, item = items.within_radius(prints, 0)
    want = {(p, i) for p in range(len(prints)) for i in range(50) if int(prints[p] ^ items.print[i]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(place.tolist(), item.tolist())) == want


def test_edits_at_the_threshold_are_found(spark):
    """Windows edited at an edge or inside as much as 0.8 allows, by one repeated word or by many: those of brute force."""
    rng = np.random.default_rng(14)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 10**5, n))) for i, n in enumerate(rng.integers(15, 60, 40))]
    docs = []
    for i, t in items:
        for k, word in enumerate(("same", None, "same", None)):
            w = t.split()
            for n in range(1, 8):  # as many words as keep 0.8
                v = list(w)
                at = range(n) if k < 2 else [len(w) // 2] * (n > 0) + list(range(len(w) - n + 1, len(w)))
                for j in at:
                    v[j] = word or f"new{rng.integers(10**9)}"
                s = shingles(t), shingles(" ".join(v))
                if sum((s[0] & s[1]).values()) / sum((s[0] | s[1]).values()) >= 0.8:
                    docs.append((1000 * i + 10 * k + n, "before it " + " ".join(v) + " after it"))
    want = brute_leaks(docs, items)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want) > 300 and found <= set(want) and len(found) >= 0.998 * len(want)


def test_long_documents_are_searched_to_their_end(spark):
    item = " ".join(f"item{i}" for i in range(30))
    long = "filler words go on " * 200_000 + item
    got = decontaminate.contaminated(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in got] == [(1, 9, 1.0, 800_000)]


def made_corpus(n=3000):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary, rng.integers(5, 120)))
        kind = i % 10
        if kind == 0:
            text = text.replace(" ", "### ")
        elif kind == 1:
            text += " vile awful"
        rows.append((i, text))
        if i % 3 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_resampling_rejects_what_held_out_labels_reject(spark):
    rows, labels = made_corpus()
    docs, marks = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, key double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, marks).toPandas()
    assert list(got.columns) == ["doc_id", "text", "log_weight", "key"]
    kept = set(got["doc_id"])
    held_out = [i for i, _ in rows if i % 3]
    good, bad = [i for i in held_out if i % 10 > 1], [i for i in held_out if i % 10 <= 1]
    assert np.mean([i in kept for i in good]) > 0.98 and np.mean([i in kept for i in bad]) < 0.02
    assert set(resampling.resample(docs, marks, ["doc_id"]).toPandas()["doc_id"]) == kept
    assert resampling.resample(docs, marks, ["doc_id"], k=100).count() == 100
    assert resampling.resample(docs, marks.limit(0), ["doc_id"]).count() == len(rows)
    assert resampling.resample(docs.limit(0), marks, ["doc_id"]).count() == 0


def test_resampling_adds_up_markers_spread_over_rare_words(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rare = lambda: "vileß" + "".join(rng.choice(list("abcdefgh"), 8))
    rows = [(i, " ".join([*rng.choice(vocabulary, 60), *(rare() for _ in range(4 if i % 10 == 1 else i % 2))])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i, _ in rows if i % 3 == 0], "doc_id long, quality int, toxic int")
    kept = set(resampling.resample(docs, marks, ["doc_id"]).toPandas()["doc_id"])
    held_out = [i for i, _ in rows if i % 3]
    assert np.mean([i in kept for i in held_out if i % 10 == 1]) < 0.02 < 0.98 < np.mean([i in kept for i in held_out if i % 10 != 1])


def brute_ngrams(text):
    """The n-grams of a text, named."""
    words = word_list(text)
    marks = [m for m in re.findall(r"[^\w\s]+", (text or "").lower())]
    out = {("word", w) for w in words} | {("pair", *p) for p in zip(words, words[1:])} | {("mark", m[-3:]) for m in marks}
    for k in resampling.STARTS:
        starts = Counter(w[:k] for w in words if len(w) >= k)
        out |= {("start", s, t) for s, n in starts.items() for t in resampling.TIMES if n >= t}
    total = len(words) + len(marks)
    counts = {"marks": len(marks), "capitals": len(re.findall(r"[A-Z]{2,}", text or "")), "repeats": sum(a == b for a, b in zip(words, words[1:])), "distinct": len(set(words))}
    return out | ({(k, round(6 * (v / (total + 20)) ** 0.5)) for k, v in counts.items()} if total else set())


def test_weights_and_sample_match_brute_force(spark):
    """Log weights by dictionaries of named n-grams, and the k largest of their keys."""
    rows, labels = made_corpus(900)
    rows += [(5000, ""), (5001, None), (5002, "vile ### AWFUL awfully awfulness vile")]
    good = {i for i, q, t in labels if q and not t}
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(brute_ngrams(text))
        if i in good:
            target.update(brute_ngrams(text))
    c, share, ratio = resampling.CHANCE, len(good) / len(rows), {}
    for g, n in raw.items():
        expected, middle, spread = n * share, target[g] + c * c / 2, c * (target[g] + c * c / 4) ** 0.5
        ratio[g] = np.log((middle + spread) / expected) if expected > middle + spread else np.log((middle - spread) / expected) if expected < middle - spread else 0.0
    want = {}
    for i, text in rows:
        every = [x for x in brute_every(text)]
        want[i] = sum(max(0, ratio[g]) for g in every) / max(1, len(every)) + sum(min(0, ratio[g]) for g in set(every))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, marks, ["doc_id"], k=len(rows)).toPandas().set_index("doc_id")
    # n-grams that share a bucket of 2**20 are rare here
    assert np.mean([abs(got["log_weight"][i] - w) < 1e-3 for i, w in want.items()]) > 0.97
    some = resampling.resample(docs, marks, ["doc_id"], k=100).toPandas()
    assert set(some["doc_id"]) == set(got["key"].nlargest(100).index)


def brute_every(text):
    """brute_ngrams with repeated words, pairs and marks as often as they stand."""
    words = word_list(text)
    named = brute_ngrams(text)
    out = [("word", w) for w in words] + [("pair", *p) for p in zip(words, words[1:])] + [("mark", m[-3:]) for m in re.findall(r"[^\w\s]+", (text or "").lower())]
    for g in named:
        if g[0] == "start":
            n = sum(len(w) >= len(g[1]) and w.startswith(g[1]) for w in words)
            out += [g] * (n - g[2] + 1)
        elif g[0] not in ("word", "pair", "mark"):
            out.append(g)
    return out


def test_chance_does_not_depend_on_the_corpus_size(spark):
    rows = [(0, 36, 0), (1, 29, 0), (2, 1000, 240)]
    marked = []
    for total in (10_000, 10_000_000):
        counts = spark.createDataFrame([(-1, total, total * 3 // 10), *rows], "bucket long, raw long, target long")
        marked.append(dict(zip(*(v.tolist() for v in resampling.log_ratios(counts)))))
    assert marked[0] == marked[1] and set(marked[0]) == {0, 2}


def test_resampling_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert resampling.resample(docs, marks).count() == 5


def test_kth_key_is_exact(spark):
    rng = np.random.default_rng(6)
    keys = np.r_[rng.normal(size=5000), [1.5] * 3000, [-1e6, 1e6]]
    df = spark.createDataFrame(pd.DataFrame({"key": keys}))
    for k in (1, 2, 400, 3000, 8001):
        assert resampling.kth_key(df, k, bins=16, few=50) == np.sort(keys)[-k]
    assert resampling.kth_key(df, 8002) == -np.inf


def brute_top(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v):
            vectors[i] = [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]
    out = set()
    for q, v in vectors.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_products_match_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(maxproduct, "BLOCK", 64)
    rows = [(i, (rng.normal(size=8) * np.exp(spread * rng.normal())).astype(np.float32).tolist()) for i in range(600)]
    rows[100] = (100, [0.0] * 8)
    rows += [(700 + i, rows[7][1]) for i in range(20)] + [(750, None), (800, [1.0, None, *[1.0] * 6]), (850, [float("nan")] * 8), (900, [float("inf")] * 8), (950, []), (None, [1.0] * 8), (1000, [1.0, 2.0]), (1001, [3.0, 4.0]), (1050, [2.0, 1.0, 1.0]), (1100, [-v for v in rows[50][1]]), (1150, [3e12] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {tuple(r) for r in maxproduct.top_products(df, F.col("vec_id") % 50 == 0).collect()}
    want = brute_top(rows)
    assert {r for r in got if abs(r[3]) < 2**62} == {r for r in want if abs(r[3]) < 2**62}
    assert maxproduct.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_a_store_keeps_every_row_through_compactions(spark):
    store = sharding.ShardStore(spark, shared_dir(spark), fan=3)
    rows = [(i % 7 if i % 5 else None, f"t{i}" if i % 4 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, arrival string")
    for k in range(4):
        store.append(df.where(F.coalesce(F.col("a"), F.lit(0)) % 4 == k))
    before, runs = store.version(), len(store.manifest()["runs"])
    assert (before, runs) == (4, 4)
    store.compact()
    assert len(store.manifest()["runs"]) < 3 and store.version() > before
    assert Counter(map(tuple, store.read().collect())) == Counter(rows) == Counter(map(tuple, store.read(before).collect()))
    with pytest.raises(sharding.Conflict):
        store.commit(before, None, [])
    # a writer that died after its claim: others wait, then take the claim over
    now = store.version()
    store._fs.create(store._path(f"{store.root}/manifests/v{now + 1:08d}.claim"), False).close()
    with pytest.raises(sharding.Conflict):
        store.commit(now, store.manifest()["schema"], store.manifest()["runs"])
    assert store.commit(now, store.manifest()["schema"], store.manifest()["runs"], patience=0) == now + 1
    assert store.vacuum() == 0  # readers of older versions have time to end
    assert store.vacuum(grace=0) == 4
    assert Counter(map(tuple, store.read().collect())) == Counter(rows)
    assert sharding.sharded(df.limit(0)).count() == 0
    assert Counter(map(tuple, sharding.sharded(df).collect())) == Counter(rows)


def test_vacuum_beside_writers_and_readers(spark):
    """A run that is written and not yet committed, a dead writer's, and versions that readers have open."""
    root = shared_dir(spark)
    store, other = sharding.ShardStore(spark, root, fan=2), sharding.ShardStore(spark, root, fan=2)
    one, two = spark.createDataFrame([(i, "a") for i in range(5)], "i int, t string"), spark.createDataFrame([(9, "b")], "i int, t string")
    store.append(one)
    with other._run() as path:
        two.write.parquet(path)
        assert store.vacuum(grace=0) == 0
        other._added(two, [{"path": path, "bytes": other._bytes(path)}])
        assert store.vacuum(grace=0) == 0
    assert store.read().count() == 6
    old = store.read(1)
    store.compact()
    assert store.vacuum() == 0 and old.count() == 5 and store.read(2).count() == 6
    assert store.vacuum(keep=2, grace=0) == 0 and store.read(2).count() == 6
    with other._run() as path:
        two.write.parquet(path)
        assert store.vacuum(grace=0, abandoned=-1.0) == 3  # both merged runs, and the one of a writer that counts as dead
    assert store.read().count() == 6


def test_a_folder_that_cannot_be_written_raises(spark):
    store = sharding.ShardStore(spark, shared_dir(spark))
    store._fs.create(store._path(f"{store.root}/file"), False).close()
    with pytest.raises(Exception, match="file"):
        store._claimed(store._path(f"{store.root}/file/v1.claim"), 300)


def test_shards_are_those_of_the_table(spark, documents, sf_dir):
    got = {r["doc_id"]: r["text_sha256"] for r in sharding.op4_shards(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(documents["doc_id"], documents["text"])}


def test_pipeline_stages(spark, documents, sf_dir):
    """Each stage against brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10_000, "", None, None, 0), (10_001, None, "en", "s", None), (None, "no id at all", "en", "s", 12), (10_002, documents["text"][3], "en", "s", 1)], docs.schema)
    passages = pd.read_parquet(f"{sf_dir}/benchmark.parquet")["text"].head(6)
    leaky = spark.createDataFrame([(20_000 + i, f"{documents['text'][150 + i]} {t}", "en", "s", 1) for i, t in enumerate(passages)], docs.schema)
    docs = docs.unionByName(odd).unionByName(leaky)
    for name, stage in corpus_pipeline.STAGES:
        before, docs_before = docs.toPandas(), docs
        docs = kept_table(spark, stage(spark, docs, sf_dir))
        after = docs.toPandas()
        pairs = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text) for r in before.itertuples()]
        if name == "quality":
            marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
            rows = resampling.resample(docs_before, marks, ["doc_id"], k=before.shape[0]).toPandas()
            some = marks.toPandas().drop_duplicates("doc_id")
            good = dict(zip(some["doc_id"], (some["quality"] == 1) & (some["toxic"] == 0)))
            own = rows[rows["doc_id"].isin(list(good))]
            cut = resampling.cut_of(own["log_weight"].to_numpy(), own["doc_id"].map(good).to_numpy(bool))
            least = np.sort(rows["key"])[-int((rows["log_weight"] >= cut).sum())]
            assert Counter(after["doc_id"].fillna(-1)) == Counter(rows.loc[rows["key"] >= least, "doc_id"].fillna(-1))
        elif name == "near_duplicates":
            classes = brute_classes([p for p in pairs if p[0] is not None])
            assert set(after["doc_id"].dropna()) == {i for i, (c, _) in classes.items() if i == c}
            assert after["doc_id"].isna().sum() == before["doc_id"].isna().sum()
        elif name == "repeated_passages":
            want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute_repeats([(i, (t or "").encode()) for i, t in pairs])}
            assert {None if pd.isna(r.doc_id) else int(r.doc_id): r.text for r in after.itertuples()} == want
            assert (after["n_chars"] == after["text"].str.len()).all()
        elif name == "benchmark_leaks":
            items = [(r.item_id, r.text) for r in pd.read_parquet(f"{sf_dir}/benchmark.parquet").itertuples()]
            grams = {g for _, b in items for g in shingles(b)}
            leaks = {i for i, _ in brute_leaks([p for p in pairs if grams & set(shingles(p[1]))], items)}
            assert leaks and set(after["doc_id"].dropna()) == {i for i, _ in pairs if i is not None and i not in leaks}
        if name != "packed_sequences":
            assert list(after.columns) == corpus_pipeline.COLUMNS
        else:
            library = Tokenizer.from_file(tokencount.vocabulary())
            want = Counter()
            for i, t in pairs:
                ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
                want.update((i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096))
            assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in after.itertuples()) == want
            filled = after.groupby("sequence_id")["length"].sum()
            assert filled.max() <= 4096 and len(filled) <= -(-int(filled.sum()) // 4096) * 1.02 + 1
            for _, x in after.sort_values("offset").groupby("sequence_id"):
                assert (x["offset"].to_numpy() == np.r_[0, x["length"].cumsum()[:-1]]).all()


def kept_table(spark, df):
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)
