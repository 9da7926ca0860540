"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions.  For an anchor and a group of vectors
the triangle inequality of angles gives an interval of angles, so of cosines, and with the norms an
interval of scores, widened by what rounding can move.  Where it meets none of the scores that the
anchor still wants, the group is left out; within a group, sorted by the angle to its own reference,
only the window of angles that can give a wanted score is scored, in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.maxproduct import FACTS, SEEDS, norms, products, whole_vectors
from weftgraph.llm.shared import mapped, partitions, shared_dir, small, written

REFERENCES = 16
#: Vectors of each number of components that are scored first, so that windows start narrow; the first of them are the references.
SAMPLE = 2048
BLOCK, ANCHORS = 2048, 512
#: What rounding may move an angle by (acos near 1 turns 1e-14 into 1e-7), and a product of norms, as a share.
ANGLE, SHARE = 1e-6, 1e-9
NONE = -(2**63)
GROUP = ["dims", "label", "ref"]


def angles_to(v: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The angle of each row to each direction (unit rows); a row of length 0 has right angles."""
    most = np.abs(v).max(axis=1, initial=0)
    unit = v / np.where(most > 0, most, 1)[:, None]
    length = np.sqrt((unit * unit).sum(axis=1))
    return np.arccos(np.clip(unit @ directions.T / np.where(length > 0, length, 1)[:, None], -1, 1))


def matrix(raw: bytes, columns: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, columns)


def samples(rows: DataFrame) -> DataFrame:
    """dims, s_rows, s_labels, s_vecs, directions: SAMPLE vectors at most of each number of components, in one row."""

    def gather(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["_n"])
        dims = int(x["dims"].iloc[0])
        vecs = matrix(b"".join(x["vec"]), dims)
        some = vecs[np.sort(np.unique(vecs, axis=0, return_index=True)[1])[: 4 * REFERENCES]]
        length = norms(some)
        some = (some[length > 0] / length[length > 0, None])[:REFERENCES]
        some = np.vstack([some, np.eye(1, dims).repeat(REFERENCES - len(some), axis=0)])  # too few: the first axis again
        return pd.DataFrame([(dims, x["row"].to_numpy(np.int64).tobytes(), x["label"].to_numpy(np.int64).tobytes(), vecs.tobytes(), some.tobytes())], columns=["dims", "s_rows", "s_labels", "s_vecs", "directions"])

    order = Window.partitionBy("dims").orderBy(F.xxhash64("row"), "row")
    some = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE)
    return some.select("dims", "row", "label", "vec", "_n").groupBy("dims").applyInPandas(gather, "dims int, s_rows binary, s_labels binary, s_vecs binary, directions binary")


def with_angles(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows with angles to all references, the nearest reference (ref) and the angle to it (theta)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for n in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == n))
                found = angles_to(matrix(b"".join(part.column("vec").to_pylist()), n), matrix(part.column("directions")[0].as_py(), n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * REFERENCES), pa.array(found.ravel()))
                yield {c: part.column(c) for c in ("row", "vec_id", "label", "dims", "norm", "anchor", "vec")} | {"angles": lists, "ref": pa.array(found.argmin(axis=1)), "theta": pa.array(found.min(axis=1))}

    schema = "row long, vec_id long, label long, dims int, norm double, anchor boolean, vec binary, angles array<double>, ref int, theta double"
    return mapped(rows.join(small(seeds.select("dims", "directions"), SEEDS), "dims"), run, schema)


def groups(rows: DataFrame) -> DataFrame:
    """GROUP with parts, least and most of the norms and of the angles to every reference."""
    each = lambda f: F.array(*[f(F.col("angles")[i]) for i in range(REFERENCES)])
    return rows.groupBy(*GROUP).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"), F.min("norm").alias("short"), F.max("norm").alias("long"), each(F.min).alias("near"), each(F.max).alias("far"))


def blocks(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The vectors of each group in blocks of about BLOCK, by their angle to the group's reference."""
    numbered = rows.join(small(facts.select(*GROUP, "parts"), FACTS), GROUP).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def gather(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["theta", "row"])
        first = x.iloc[0]
        arrays = [x[c].to_numpy(t).tobytes() for c, t in (("row", np.int64), ("vec_id", np.int64), ("theta", np.float64), ("norm", np.float64))]
        return pd.DataFrame([(*(int(first[c]) for c in (*GROUP, "part")), *arrays, b"".join(x["vec"]))], columns=[*GROUP, "part", "rows", "ids", "thetas", "norms", "vecs"])

    return numbered.select(*GROUP, "part", "row", "vec_id", "theta", "norm", "vec").groupBy(*GROUP, "part").applyInPandas(gather, "dims int, label long, ref int, part int, rows binary, ids binary, thetas binary, norms binary, vecs binary")


class Asked:
    """A block of anchors: rows, ids, vectors, norms, angles, and the windows of scores that each wants (lows, highs)."""

    def __init__(self, r) -> None:
        self.rows, self.ids = (np.frombuffer(x, np.int64) for x in (r["a_rows"], r["a_ids"]))
        self.vecs, self.angles = matrix(r["a_vecs"], r["dims"]), matrix(r["a_angles"], REFERENCES)
        self.norms = norms(self.vecs)
        n = max(1, len(self.rows))
        self.lows, self.highs = (np.frombuffer(r[c], np.int64).reshape(n, -1) if r.get(c) else np.empty((n, 0), np.int64) for c in ("lows", "highs"))

    def reached(self, short: float, long: float, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which anchors can have a wanted score in a group of such norms and angles to the references."""
        least = np.maximum(self.angles - far, near - self.angles).max(axis=1) - ANGLE
        most = np.minimum(self.angles + far, 2 * math.pi - self.angles - near).min(axis=1) + ANGLE
        high, low = np.cos(np.clip(least, 0, math.pi)), np.cos(np.clip(most, 0, math.pi))
        with np.errstate(over="ignore"):
            top = self.norms * np.where(high > 0, long, short) * high
            bottom = self.norms * np.where(low > 0, short, long) * low
            slack = np.minimum(self.norms * long * SHARE + 1, 1e300)
        top, bottom = (np.clip(x, -1e300, 1e300) for x in (top, bottom))
        top, bottom = top + slack, bottom - slack
        wanted = self.lows <= self.highs
        return (wanted & (self.lows <= top[:, None]) & (self.highs >= bottom[:, None])).any(axis=1)

    def window(self, ref: int, thetas: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where, among a block's vectors by their angle to a reference, each anchor can have a wanted score."""
        wanted = self.lows <= self.highs
        low = np.where(wanted, self.lows, 2**62).min(axis=1).astype(np.float64)
        high = np.where(wanted, self.highs, -(2**62)).max(axis=1).astype(np.float64)
        short, long = lengths.min(), lengths.max()
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            least = (low - 1 - np.abs(low) * SHARE) / (self.norms * np.where(low > 0, long, short))
            most = (high + 1 + np.abs(high) * SHARE) / (self.norms * np.where(high > 0, short, long))
        least, most = np.nan_to_num(least, nan=-1.0, posinf=2.0, neginf=-2.0), np.nan_to_num(most, nan=1.0, posinf=2.0, neginf=-2.0)
        wide, narrow = np.arccos(np.clip(least, -1, 1)), np.arccos(np.clip(most, -1, 1))
        own = self.angles[:, ref]
        start = np.searchsorted(thetas, np.maximum(own - wide, narrow - own) - ANGLE)
        end = np.searchsorted(thetas, np.minimum(own + wide, 2 * math.pi - narrow - own) + ANGLE, side="right")
        return start, np.where(wanted.any(axis=1) & (least <= 1) & (most >= -1), end, 0)


def scored(asked: Asked, ref: int, block: dict, k: int) -> tuple[np.ndarray, ...]:
    """(anchor's place, window's place, id, row, score) of the k best of each anchor's windows in a block: higher scores, then smaller ids, then smaller rows."""
    rows, ids = (np.frombuffer(block[c], np.int64) for c in ("rows", "ids"))
    thetas, lengths = (np.frombuffer(block[c], np.float64) for c in ("thetas", "norms"))
    vecs = matrix(block["vecs"], asked.vecs.shape[1])
    start, end = asked.window(ref, thetas, lengths)
    some = np.flatnonzero(start < end)
    some = some[np.argsort(start[some], kind="stable")]
    least = np.where(asked.lows <= asked.highs, asked.lows, 2**62).min(axis=1)
    out = []
    for at in range(0, len(some), 64):
        part = some[at : at + 64]
        a, z = int(start[part].min()), int(end[part].max())
        found = products(asked.vecs[part], vecs[a:z])
        i, j = np.nonzero(found >= least[part][:, None])
        s, i, j = found[i, j], part[i], j + a
        other = rows[j] != asked.rows[i]
        for w in range(asked.lows.shape[1]):
            fit = np.flatnonzero(other & (s >= asked.lows[i, w]) & (s <= asked.highs[i, w]))
            out.append((i[fit], np.full(len(fit), w), ids[j[fit]], rows[j[fit]], s[fit]))
    i, w, ids, rows, s = map(np.concatenate, zip(*out)) if out else [np.empty(0, np.int64)] * 5
    order = np.lexsort((rows, ids, -s, w, i))
    i, w, ids, rows, s = (x[order] for x in (i, w, ids, rows, s))
    new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (w[1:] != w[:-1])][: len(i)])
    kept = np.arange(len(i)) - np.repeat(new, np.diff(np.r_[new, len(i)])) < k
    return tuple(x[kept] for x in (i, w, ids, rows, s))


#: What a block of anchors carries.
CARRIED = "dims int, label long, a_rows binary, a_ids binary, a_vecs binary, a_angles binary, p_ids binary, p_rows binary, p_scores binary, lows binary, highs binary"
NAMES = [c.split()[0] for c in CARRIED.split(", ")]


def anchored(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of about ANCHORS anchors of one label; rows may have p: up to `width` positives (score, vec_id, row)."""
    counts = rows.groupBy("dims", "label").agg(F.ceil(F.count("*") / F.lit(ANCHORS)).cast("int").alias("parts"))
    numbered = rows.join(small(counts, FACTS), ["dims", "label"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    has = "p" in rows.columns

    def gather(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("row")
        p = np.full((3, len(x), width), NONE, np.int64)
        for i, own in enumerate(x["p"] if has else ()):
            for j, one in enumerate(own):
                p[:, i, j] = one["vec_id"], one["row"], one["score"]
        angles = np.array(x["angles"].tolist(), np.float64)
        values = [int(x["dims"].iloc[0]), int(x["label"].iloc[0]), x["row"].to_numpy(np.int64).tobytes(), x["vec_id"].to_numpy(np.int64).tobytes(), b"".join(x["vec"]), angles.tobytes(), *[y.tobytes() for y in p], None, None]
        return pd.DataFrame([values], columns=NAMES)

    return numbered.select("dims", "label", "part", "row", "vec_id", "vec", "angles", *(["p"] if has else [])).groupBy("dims", "label", "part").applyInPandas(gather, CARRIED).repartition(partitions(rows.sparkSession), "a_rows")


def narrowed(asked: DataFrame, seeds: DataFrame, k: int, windows) -> DataFrame:
    """asked with each window's low raised to the k-th best score that the sample has in it; windows(block) gives lows, highs and whether a seed of the same label is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = b.to_pylist()
            for r in out:
                own = Asked(r)
                lows, highs, same = windows(r)
                rows, labels = (np.frombuffer(r[c], np.int64) for c in ("s_rows", "s_labels"))
                fit = (labels == r["label"]) == same
                scores, rows = products(own.vecs, matrix(r["s_vecs"], r["dims"])[fit]), rows[fit]
                lows = lows.copy()
                for i in range(len(scores)):
                    s = scores[i][rows != own.rows[i]]
                    for w in range(lows.shape[1]):
                        inside = s[(s >= lows[i, w]) & (s <= highs[i, w])]
                        if len(inside) >= k:
                            lows[i, w] = np.partition(inside, len(inside) - k)[len(inside) - k]
                r["lows"], r["highs"] = lows.tobytes(), highs.tobytes()
            yield {c: [r[c] for r in out] for c in NAMES}

    return mapped(asked.join(small(seeds.drop("directions"), SEEDS), "dims"), run, CARRIED, 8)


def meeting(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks of anchors beside the blocks of the groups where a wanted score can be; pairs: asked joined to facts (g_label, ref, parts, short, long, near, far)."""
    kept = [c for c in NAMES if c != "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                own = Asked(r)
                some = np.flatnonzero(own.reached(r["short"], r["long"], np.array(r["near"]), np.array(r["far"])))
                if len(some):
                    for c in kept[1:]:
                        kind = np.float64 if c in ("a_vecs", "a_angles") else np.int64
                        r[c] = np.frombuffer(r[c], kind).reshape(len(own.rows), -1)[some].tobytes()
                    out.append(r)
            yield {c: [r[c] for r in out] for c in [*kept, "label", "ref", "parts"]}

    schema = ", ".join(c for c in CARRIED.split(", ") if c != "label long") + ", label long, ref int, parts int"
    near = mapped(pairs.drop("label").withColumnRenamed("g_label", "label"), run, schema, 64)
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # a few large rows: dealt out by block, as their bytes alone would leave them in one task
    n = partitions(pairs.sparkSession)
    return near.repartition(n, *GROUP, "part").join(candidates.repartition(n, *GROUP, "part"), [*GROUP, "part"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, embedding, label).

    Scores are inner products of floor(scale * x), exactly (cut to 64 bits).  An anchor (is_anchor) has as
    positives its first rows of the same label; for each, its first rows of other labels are
    returned whose score is from low % to high % of the positive's, both included.  First: higher
    score, then smaller vec_id.  Rows count one by one: a repeated row is a further row, and a repeated anchor is asked again;
    of equal rows either may come first.  Null ids, labels, vectors and components, non-finite
    components and empty vectors take no part; vectors of another number of components are no
    candidates.  A positive score below 0 has no negatives, one of 0 those of score 0.  An empty table gives none.  Other columns are not read.
    """
    home = shared_dir(vectors.sparkSession)
    rows = written(whole_vectors(vectors.select("vec_id", "embedding", "label", is_anchor.alias("anchor")), scale), f"{home}/vectors")
    seeds = written(samples(rows), f"{home}/seeds")
    rows = written(with_angles(rows, seeds), f"{home}/angles")
    facts = written(groups(rows), f"{home}/groups")
    candidates = written(blocks(rows, facts), f"{home}/blocks")
    facts = facts.withColumnRenamed("label", "g_label")
    anchors = rows.where("anchor")

    def whole(r: dict) -> tuple[np.ndarray, np.ndarray, bool]:
        n = len(r["a_rows"]) // 8
        return np.full((n, 1), NONE, np.int64), np.full((n, 1), 2**63 - 1, np.int64), True

    def shares(r: dict) -> tuple[np.ndarray, np.ndarray, bool]:
        n = len(r["a_rows"]) // 8
        there, scores = (np.frombuffer(r[c], np.int64).reshape(n, positives) for c in ("p_rows", "p_scores"))
        exact = lambda f: np.array([f(s) for s in scores.ravel().tolist()], np.int64).reshape(scores.shape)
        lows, highs = exact(lambda s: max(NONE, -(-low * s // 100))), exact(lambda s: max(NONE, min(2**63 - 1, high * s // 100)))
        return np.where(there == NONE, 1, lows), np.where(there == NONE, 0, highs), False

    def search(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                for r in b.to_pylist():
                    own = Asked(r)
                    p = [np.frombuffer(r[c], np.int64).reshape(len(own.rows), -1) for c in ("p_ids", "p_rows", "p_scores")]
                    i, w, *rest = scored(own, r["ref"], r, k)
                    yield dict(zip(FOUND, map(pa.array, (own.rows[i], own.ids[i], *(x[i, w] for x in p), *rest))))

        return run

    asked = written(narrowed(anchored(anchors, 1), seeds, positives, whole), f"{home}/anchors")
    pairs = asked.join(small(facts, FACTS), (asked["dims"] == facts["dims"]) & (asked["label"] == facts["g_label"])).drop(facts["dims"])
    found = mapped(meeting(pairs, candidates), search(positives), FOUND_SCHEMA, 8)
    w = Window.partitionBy("a_row").orderBy(F.desc("score"), "vec_id", "row")
    top = found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= positives)
    own = top.groupBy(F.col("a_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "row", "score"))).alias("p"))  # `positives` at most
    asked = written(narrowed(anchored(anchors.join(own, "row"), positives), seeds, negatives, shares), f"{home}/asked")
    pairs = asked.join(small(facts, FACTS), (asked["dims"] == facts["dims"]) & (asked["label"] != facts["g_label"])).drop(facts["dims"])
    found = mapped(meeting(pairs, candidates), search(negatives), FOUND_SCHEMA, 8)
    w = Window.partitionBy("a_row", "p_row").orderBy(F.desc("score"), "vec_id", "row")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return out.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


FOUND_SCHEMA = "a_row long, a_id long, p_id long, p_row long, p_score long, vec_id long, row long, score long"
FOUND = [c.split()[0] for c in FOUND_SCHEMA.split(", ")]


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh row's label is moved on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT a.r AS a_row, a.vec_id AS anchor_id, b.r AS r, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.w) + 1), lambda i: a.w[i] * b.w[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.w) = len(b.w) AND a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id, r) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.a_row, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank
  FROM p JOIN s ON p.a_row = s.a_row AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
