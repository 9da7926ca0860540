"""Near-duplicate documents: an n-gram Jaccard join by a MinHash LSH forest with exact verification.

Rows of equal shingle sets form one node.  Each tree of the forest is a prefix trie: the nodes'
labels of LONGEST symbols, sorted, so that nodes of a common prefix are neighbours.  Prefixes of
the longest kind are matched first.  What they link is verified exactly, and the similarities
found, each weighted by the chance that a pair of its similarity had to meet, tell the recall; from
them follows to which prefix length nodes go on, until the target recall is reached.  Nodes of one
prefix are linked to the least of them (links grow with the nodes, not with pairs), and pairs within
a group of linked nodes are verified by blocks; blocks of sets whose sizes exclude the similarity
never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import SHINGLE_WORDS, SIMILARITY, batches_of, components, freed, mapped, mixed, salt_of, salted_join, shared_dir, shingle_hashes, texts_of, word_hashes, written

TREES = 28
#: Symbols of a label, 8 bits each: a label is a 64-bit number.
LONGEST = 8
RECALL = 0.9998
BLOCK = 256
#: Bytes of shingles from which a group's task gives its memory back at once.
LARGE = 1 << 20
#: Classes of similarity in which linked pairs are counted.
BINS = 20


def chance(similarity: np.ndarray | float, length: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair of this similarity shares a prefix of a length in any tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(found: list[int], length: int, similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix, length at most, that reaches the recall on the pairs that found stands for.

    found: linked pairs by class of similarity, from the threshold up, met with prefixes of a length.
    Each stands for 1 / chance pairs; one pair at the threshold is added, so that few finds do not
    stand for many.
    """
    low = similarity + np.arange(len(found)) * (1 - similarity) / len(found)
    there = np.array(found, float) / chance(low, length, trees)
    there[0] += 1
    while length > 1 and (there * chance(low, length, trees)).sum() < recall * there.sum():
        length -= 1
    return length


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed parameters of n hash functions."""
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(lists: list[np.ndarray], hashes: int) -> np.ndarray:
    """The MinHash signature of each non-empty array of shingle hashes: 8 bits for each of the hashes.

    The bits are those of the least value mixed once more; its own highest bits are nearly all zero.
    """
    flat = (np.concatenate(lists) >> np.uint64(32)).astype(np.uint32)
    first = np.r_[0, np.cumsum([len(x) for x in lists])[:-1]]
    a, b = multipliers(hashes)
    out = np.empty((len(lists), hashes), np.uint8)
    value = np.empty(len(flat), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(hashes):
            np.multiply(flat, a[j], out=value)
            value += b[j]
            out[:, j] = np.minimum.reduceat(value, first) * np.uint32(0x9E3779B1) >> np.uint32(24)
    return out


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits of a non-empty set of shingle hashes, given once each."""
    with np.errstate(over="ignore"):
        one, two = mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def signed(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, set_id (null: no words), its number of shingles and its label in each tree, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = [np.unique(shingle_hashes(h, words)) for h in word_hashes(texts_of(b))]
            full = [s for s in sets if len(s)]
            labels = iter(signatures(full, trees * LONGEST).view(">i8").tolist() if full else ())
            yield {"doc_id": b.column("doc_id"), "set_id": [set_id(s) if len(s) else None for s in sets], "shingles": [len(s) for s in sets], "labels": [next(labels) if len(s) else None for s in sets]}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, set_id binary, shingles long, labels array<long>")


def tries(nodes: DataFrame) -> DataFrame:
    """(tree, label, node), sorted over all partitions: the leaves of the forest in order.

    A label's highest bytes are its first symbols.  Sorting by node too splits a label of many nodes.
    """
    rows = nodes.select("node", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "node")
    return rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")


def trie_links(leaves: DataFrame, length: int) -> DataFrame:
    """Links (a, b) that connect the nodes of each common prefix of a length, from the forest's sorted leaves.

    Neighbours in order are compared: nothing is shuffled but the links, and the few prefixes that
    go on beyond a batch, whose least nodes are linked to each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            tree, label, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "label", "node"))
            prefix = label >> np.int64(8 * (LONGEST - length))
            first = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])])
            many = np.diff(np.r_[first, len(tree)])
            low = np.minimum.reduceat(node, first)  # in most trees the same for a group of near copies: few links differ
            hub = np.repeat(low, many)
            some = np.flatnonzero(np.repeat(many > 1, many) & (hub != node))
            # a step back in order is where one sorted file ends and another begins: prefixes may go on elsewhere there too
            back = np.flatnonzero((tree[1:] < tree[:-1]) | ((tree[1:] == tree[:-1]) & (label[1:] < label[:-1])))
            open_ = np.unique(np.searchsorted(first, np.r_[0, len(tree) - 1, back, back + 1], side="right") - 1)
            pair = np.unique(np.stack([node[some], hub[some]]), axis=1)
            no, at = [None] * pair.shape[1], first[open_]
            yield {"a": np.r_[pair[0], low[open_]].tolist(), "b": pair[1].tolist() + [None] * len(open_), "tree": no + tree[at].tolist(), "prefix": no + prefix[at].tolist()}

    return mapped(leaves, run, "a long, b long, tree int, prefix long", 1 << 16)


def linked(leaves: DataFrame, length: int, path: str) -> DataFrame:
    """trie_links' links with those between batches, as a written table (a, b)."""
    found = written(trie_links(leaves, length), f"{path}/found", 1 << 16)
    far = found.where("b is null").groupBy("tree", "prefix").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low != high").select("tree", "prefix", "low")
    more = found.where("b is null").select("a", "tree", "prefix").join(far, ["tree", "prefix"]).where("a != low").select("a", F.col("low").alias("b"))
    return written(found.where("b is not null").select("a", "b").unionByName(more).distinct(), f"{path}/links")


def pair_links(similarity: float):
    """Verifies the pairs of a pair of blocks: each node's links, by class of similarity, and the least node it is connected to there."""
    scaled = round(similarity * 10_000)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(s, np.uint64) for s in x["shingles"]]
        node, side = x["node"].to_numpy(), x["side"].to_numpy()
        size = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        column, owner = column[shared], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        column = np.cumsum(np.r_[0, np.diff(column) != 0]) if len(column) else column
        both = np.zeros((len(sets), len(sets)), np.float32)  # exact for sets of less than 2**24 shingles
        wide = 1024
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            at = slice(np.searchsorted(column, start), np.searchsorted(column, start + wide))
            part = np.zeros((len(sets), wide), np.float32)
            part[owner[at], column[at] - start] = 1
            both += part @ part.T
        one, two = np.nonzero(both * np.float32(2) >= similarity * np.minimum(size[:, None], size[None, :]))
        if len(np.unique(side)) > 1 or bool(x["cross"].iloc[0]):
            ok = side[one] != side[two]
        else:
            ok = one != two
        one, two = one[ok], two[ok]
        common = both[one, two].astype(np.int64)
        union = size[one] + size[two] - common
        ok = common * 10_000 >= scaled * union
        one, two, common, union = one[ok], two[ok], common[ok], union[ok]
        root = np.arange(len(sets))
        while len(one):  # the least node that each is connected to, by halving distances
            new = root.copy()
            np.minimum.at(new, one, root[two])
            new = new[new]
            if (new == root).all():
                break
            root = new
        bins = np.minimum(((common / union - similarity) * BINS / max(1e-9, 1 - similarity) + 1e-9).astype(np.int64), BINS - 1)
        counts = np.zeros((len(sets), BINS), np.int64)
        np.add.at(counts, (one, bins), 1)
        has = np.unique(one)
        return pd.DataFrame({"node": node[has], "links": pd.Series(list(counts[has]), dtype=object), "root": node[root[has]]})

    return run


def checked(similarity: float):
    """pair_links that gives memory back after pairs of blocks with many shingles."""
    return freed(pair_links(similarity), lambda x: x["shingles"].map(len).sum() > LARGE)


def placed(grouped: DataFrame, nodes: DataFrame, similarity: float, block: int, path: str) -> DataFrame:
    """node, doc_id, set_id, component, own and others (blocks) of each node of a group (grouped: id, component).

    A group of at most `block` nodes is one block.  A larger one has blocks by class of set size, in
    which the largest is 1 / similarity times the least: pairs lie in one class or in neighbouring ones.
    """
    rows = salted_join(grouped.select(F.col("id").alias("node"), "component"), grouped.groupBy("component").agg(F.count("*").alias("size")), "component")
    step = F.lit(-np.log(max(similarity, 1e-9)) if similarity < 1 else 1e-6)
    kind = F.when(F.col("size") <= block, 0).otherwise(F.floor(F.log(F.col("shingles").cast("double")) / step + 1e-9)).cast("int")
    rows = written(rows.join(nodes.select("node", "doc_id", "set_id", "shingles"), "node").withColumn("kind", kind), f"{path}/placed")
    parts = rows.groupBy("component", "kind").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    near = parts.select("component", F.explode(F.array(F.col("kind") - 1, "kind", F.col("kind") + 1)).alias("kind"), F.struct("kind", "parts").alias("near"))
    parts = parts.join(near.groupBy("component", "kind").agg(F.collect_list("near").alias("near")), ["component", "kind"]).withColumn("at", F.struct("component", "kind")).drop("component", "kind")
    rows = salted_join(rows.withColumn("at", F.struct("component", "kind")), parts, "at")
    number = lambda k, i: k.cast("long") * F.lit(1 << 32) + i
    own = number(F.col("kind"), F.pmod(F.xxhash64("node"), F.col("parts")))
    others = F.flatten(F.transform("near", lambda n: F.transform(F.sequence(F.lit(0), n["parts"] - 1), lambda i: number(n["kind"], i))))
    return rows.select("node", "doc_id", "set_id", "component", own.alias("own"), others.alias("others"))


def verified(docs: DataFrame, nodes: DataFrame, grouped: DataFrame, words: int, similarity: float, block: int, path: str) -> DataFrame:
    """node, component, links (by class of similarity), root of the pairs of each group (grouped: id, component), by pairs of blocks."""
    place = placed(grouped, nodes, similarity, block, path)
    texts = docs.select("doc_id", "text").join(place, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()  # nodes that this task has sent: of repeated rows one counts
        for b in batches:
            sets = [np.unique(shingle_hashes(h, words)) for h in word_hashes(texts_of(b))]
            keep = []
            for i, (n, s, k) in enumerate(zip(b.column("node").to_pylist(), sets, b.column("set_id").to_pylist())):
                if n not in seen and len(s) and set_id(s) == k:  # a doc_id may have other texts too
                    seen.add(n)
                    keep.append(i)
            rows = b.take(pa.array(keep, pa.int64()))
            yield {c: rows.column(c) for c in ("node", "component", "own", "others")} | {"shingles": [sets[i].tobytes() for i in keep]}

    sets = mapped(texts.select("doc_id", "node", "set_id", "component", "own", "others", "text"), cut, "node long, component long, own long, others array<long>, shingles binary")
    pairs = sets.withColumn("other", F.explode("others")).select("component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("cross"), "shingles")
    check = checked(similarity)
    run = lambda key, x: check(x).assign(component=key[0])[["component", "node", "links", "root"]]
    return pairs.groupBy("component", "one", "two").applyInPandas(lambda k, x: run(k, x), "component long, node long, links array<long>, root long")


def forest_links(docs: DataFrame, nodes: DataFrame, home: str, words: int, similarity: float, recall: float, block: int) -> DataFrame:
    """node, component, links, root: the exact links of each node among those that the forest brings together.

    Prefixes are matched at full length, then at the length that the links found ask for, until it
    stays; groups that did not grow are not verified again.  Only sums by class reach the driver.
    """
    leaves = written(tries(nodes), f"{home}/tries")
    length, found, before = LONGEST, None, None
    while True:
        at = f"{home}/{length}"
        near = components(linked(leaves, length, at), f"{at}/near")
        sizes = written(near.groupBy("component").agg(F.count("*").alias("size")), f"{at}/sizes")
        if found is None:
            now = verified(docs, nodes, near, words, similarity, block, at)
        else:
            same = sizes.join(before, ["component", "size"], "left_semi").select("component")
            grown = salted_join(near, sizes.join(before, ["component", "size"], "left_anti").select("component"), "component")
            now = salted_join(found, same, "component").select(found.columns).unionByName(verified(docs, nodes, grown, words, similarity, block, at))
        with batches_of(docs.sparkSession, 200):
            found, before = written(now, f"{at}/verified"), sizes
        sums = found.agg(*[F.coalesce(F.sum(F.col("links")[i]), F.lit(0)).alias(f"n{i}") for i in range(BINS)]).first()
        shorter = prefix_length(list(sums), length, similarity, TREES, recall)
        if shorter == length:
            return found
        length = shorter


def join_near(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of each row of docs (doc_id, text).

    class_id: the least doc_id of the documents connected by links; n_links: the number of other
    shingle sets that this row's set is linked to, exactly; n_copies: rows with its own set, itself
    included.  Texts without words (null and empty ones) have no links and are classes of their own; a
    text of fewer words than a shingle is one shingle.  Rows of null doc_id have a null class.  Rows
    of one doc_id with different texts are judged each by its text, repeated rows alike.  Ties are
    as good as links (similarity or more).  A text of any length is one set.  An empty table gives
    none; further columns are not read.
    """
    home = shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(signed(docs, words, TREES), f"{home}/signed").withColumn("salt", salt_of("doc_id"))
    named = rows.where("set_id is not null and doc_id is not null")
    own = named.groupBy("set_id", "salt").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("shingles").alias("shingles"), F.first("labels").alias("labels"))
    nodes = own.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.sum("n_copies").alias("n_copies"), F.first("shingles").alias("shingles"), F.first("labels").alias("labels"), F.collect_list("salt").alias("salts"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), f"{home}/nodes")
    found = forest_links(docs, nodes, home, words, similarity, recall, block)
    total = F.aggregate("links", F.lit(0).cast("long"), lambda a, b: a + b)
    counts = found.groupBy("node").agg(F.sum(total).alias("n_links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), f"{home}/classes").select(F.col("id").alias("node"), "component")
    facts = nodes.drop("labels").join(counts, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = written(facts, f"{home}/facts")
    facts = salted_join(facts, facts.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component")
    facts = facts.select("set_id", F.explode("salts").alias("salt"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    out = named.select("doc_id", "set_id", "salt").join(facts, ["set_id", "salt"]).select("doc_id", "class_id", "n_links", "n_copies")
    alone = rows.where("set_id is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and the number of links of every document."""
    return join_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS node, count(*) AS n_copies FROM s GROUP BY s),
g AS (SELECT node, len(s) AS n, unnest(s) AS g FROM c),
pairs AS (SELECT a.node AS x, b.node AS y, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM g a JOIN g b ON a.g = b.g AND a.node <> b.node GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 10 * k >= 8 * (n + m - k)),
reach AS (SELECT node AS id, node AS r FROM c UNION SELECT reach.id, links.y FROM reach JOIN links ON reach.r = links.x),
classes AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id), n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT s.doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM s JOIN c USING (s) JOIN classes ON node = id LEFT JOIN n ON node = x
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM w WHERE len(w) = 0
"""
