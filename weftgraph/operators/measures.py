"""Aggregates, exposures over time, patients and similarity."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The resolutions of exposure series and their lengths.
RESOLUTIONS = {"hour": "1 hour", "day": "1 day", "7day": "7 days", "14day": "14 days"}


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): all of a key's values, duplicates kept, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one of the greatest order; of equal ones the greatest row."""
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.struct(order, *rest)
    return df.groupBy(key).agg(F.max(row).alias("_r")).select(key, "_r.*")


def collect_actions(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, actions): the union of a key's arrays as a sorted set."""
    return df.select(key, F.explode(column).alias("_a")).groupBy(key).agg(F.array_sort(F.collect_set("_a")).alias("actions"))


def join_values(df: DataFrame, key: str, value: str, separator: str = ";") -> DataFrame:
    """(key, joined): a key's values, sorted and joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), separator).alias("joined"))


def coverage(names: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """One row: total names, with_hit, without_hit, ratio and hits."""
    counts = hits.groupBy(key).agg(F.count("*").alias("_n"))
    per = names.select(key).distinct().join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    with_hit = F.sum(F.when(F.col("_n") > 0, 1).otherwise(0))
    return per.agg(F.count("*").alias("total"), with_hit.alias("with_hit"), (F.count("*") - with_hit).alias("without_hit"), F.sum("_n").alias("hits")).withColumn("ratio", F.round(F.col("with_hit") / F.col("total"), 6))


def time_buckets(exposures: DataFrame, resolution: str, aggregation: str = "avg") -> DataFrame:
    """(exposure_type, bucket, value): exposures by epoch-aligned buckets, their avg or max; also for streams."""
    f = {"avg": F.avg, "max": F.max}[aggregation]
    w = F.window("ts", RESOLUTIONS[resolution])
    return exposures.groupBy("exposure_type", w.alias("w")).agg(f("value").alias("value")).select("exposure_type", F.col("w.start").alias("bucket"), "value")


def partials(exposures: DataFrame) -> DataFrame:
    """(exposure_type, hour, total, n, most): mergeable partial aggregates by hour; also for streams."""
    w = F.window("ts", RESOLUTIONS["hour"])
    return exposures.groupBy("exposure_type", w.alias("w")).agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.max("value").alias("most")).select("exposure_type", F.col("w.start").alias("hour"), "total", "n", "most")


def rolled_up(hours: DataFrame) -> DataFrame:
    """(exposure_type, resolution, bucket, avg, max) of all resolutions, from partials: exposures are read once, and what is rolled up are hours.

    Buckets are time_buckets' own, aligned to the epoch; every resolution is a whole number of hours.
    """
    length = {name: int(text.split()[0]) * (3600 if "hour" in text else 86_400) for name, text in RESOLUTIONS.items()}
    at = F.unix_seconds(F.col("hour").cast("timestamp"))
    starts = [F.struct(F.lit(name).alias("resolution"), F.timestamp_seconds(at - F.pmod(at, F.lit(n))).alias("bucket")) for name, n in length.items()]
    each = hours.select("exposure_type", "total", "n", "most", F.explode(F.array(*starts)).alias("_b"))
    out = each.groupBy("exposure_type", "_b.resolution", "_b.bucket").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("max"))
    return out.select("exposure_type", "resolution", "bucket", F.try_divide("total", "n").alias("avg"), "max")


def flatten_patients(patients: DataFrame) -> DataFrame:
    """Patients with diag as an array of (diagnosis, date, type), the first visit each, medList as (medication, date), and lat and long."""
    visits = F.transform(F.map_entries("diag"), lambda e: F.struct(e["key"].alias("diagnosis"), F.try_element_at(F.map_entries(e["value"]), F.lit(1))["key"].alias("date"), F.try_element_at(F.map_entries(e["value"]), F.lit(1))["value"].alias("type")))
    meds = F.transform(F.map_entries("medList"), lambda e: F.struct(e["key"].alias("medication"), e["value"].alias("date")))
    return patients.select("patient_id", "sex", "race", "birth_date", F.array_sort(visits).alias("diagnoses"), F.array_sort(meds).alias("medications"), F.col("geoCode.lat").alias("lat"), F.col("geoCode.long").alias("long"))


def endotype_requests(patients: DataFrame, visits: DataFrame, exposures: DataFrame) -> DataFrame:
    """(patient_id, request): a JSON request for each patient, with its visits and each visit's exposures nested.

    visits: patient_id, visit_id, time, visit_type; exposures: visit_id, exposure_type, units, value.
    """
    inner = exposures.groupBy("visit_id").agg(F.array_sort(F.collect_list(F.struct("exposure_type", "units", "value"))).alias("exposures"))
    outer = visits.join(inner, "visit_id", "left").groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("time", "visit_type", "exposures"))).alias("visits"))
    request = F.to_json(F.struct(F.date_format("birth_date", "yyyy-MM-dd").alias("date_of_birth"), "race", "sex", "visits"))
    return patients.join(outer, "patient_id", "left").select("patient_id", request.alias("request"))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def similarity(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pairs (term_a, term_b) with similarity: -1 where a term is unknown or holds a space; terms are lower-cased."""
    one = embeddings.select(F.col("term").alias("_a"), F.col("vec").alias("_va"))
    two = embeddings.select(F.col("term").alias("_b"), F.col("vec").alias("_vb"))
    rows = pairs.withColumns({"_a": F.lower("term_a"), "_b": F.lower("term_b")}).join(one, "_a", "left").join(two, "_b", "left")
    return rows.withColumn("similarity", F.round(F.coalesce(cosine(F.col("_va"), F.col("_vb")), F.lit(-1.0)), 6)).select("term_a", "term_b", "similarity")


def rounded(x: np.ndarray) -> np.ndarray:
    """Doubles to six places, halves away from zero, as SQL's round has it."""
    big = np.abs(x) * 1e6
    out = np.floor(big + 0.5)
    for i in np.flatnonzero(np.abs(big - np.floor(big) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(abs(x[i])))).quantize(Decimal("1e-6"), ROUND_HALF_UP) * 1_000_000)
    return np.copysign(out / 1e6, x) + 0.0


def block_top(asked: pa.Table, stored: pa.Table, k: int) -> pa.Table:
    """The k nearest stored vectors (partner, _v) of each asked one (term, _q) in a block; a vector that holds a null is at no distance from any, and comes last.

    Products of whole matrices find what may be among the k; those are then summed in the order of the
    components and rounded, so that they are SQL's figures.
    """
    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64")
        return flat.reshape(len(column), -1)

    out: dict[str, list] = {"term": [], "partner": [], "similarity": []}
    if asked.num_rows and stored.num_rows:
        stored = stored.take(pc.sort_indices(stored["partner"]))
        terms, partners = asked["term"].to_pylist(), np.array(stored["partner"].to_pylist(), dtype=object)
        q, v = matrix(asked["_q"]), matrix(stored["_v"])
        none = np.isnan(v).any(axis=1)
        clean = np.where(none[:, None], 0.0, v)
        for start in range(0, len(q), 256):
            some = q[start : start + 256]
            lost = np.isnan(some).any(axis=1)
            near = np.where(lost[:, None], 0.0, some) @ clean.T
            near[:, none] = -np.inf
            near[lost] = -np.inf
            for i, row in enumerate(near):
                term = terms[start + i]
                row[partners == term] = np.nan  # a term is no partner of its own
                place = np.flatnonzero(~np.isnan(row))
                if len(place) > k:
                    least = np.partition(row[place], len(place) - k)[len(place) - k]
                    place = place[row[place] >= least - 4e-6]
                real = place[np.isfinite(row[place])]
                total = np.zeros(len(real))
                for d in range(v.shape[1]):
                    total = total + some[i, d] * v[real, d]
                total = rounded(total)
                best = np.lexsort((real, -total))[:k]
                rest = place[~np.isfinite(row[place])][: k - len(best)]
                out["term"] += [term] * (len(best) + len(rest))
                out["partner"] += partners[real[best]].tolist() + partners[rest].tolist()
                out["similarity"] += total[best].tolist() + [None] * len(rest)
    return pa.table(out, pa.schema([("term", pa.string()), ("partner", pa.string()), ("similarity", pa.float64())]))


def nearest_in_blocks(asked: DataFrame, stored: DataFrame, on: list[str], k: int) -> DataFrame:
    """(term, partner, similarity, rank): the k nearest of the stored vectors (partner, _v) that an asked one (term, _q) shares a block (on) with.

    Unit vectors of one length.  A block is one task's matrix product, of which k rows a term leave it; ties go to the smaller partner.
    """
    def top(a: pa.Table, b: pa.Table) -> pa.Table:
        return block_top(a, b, k)

    rows = asked.groupBy(*on).cogroup(stored.groupBy(*on)).applyInArrow(top, "term string, partner string, similarity double")
    w = Window.partitionBy("term").orderBy(F.desc("similarity"), "partner")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit(v: Column) -> Column:
    """A vector of length one; of nulls where it has no length."""
    # the length is an array's only element, so that it is summed once
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n)))[0]


def spread(n: int, part: str, size: int) -> tuple[int, Column]:
    """How many blocks of about `size` hold n rows, and all their numbers as rows."""
    parts = max(1, -(-n // size))
    return parts, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias(part)


def even(embeddings: DataFrame) -> bool:
    """Whether all vectors are of one length and their numbers finite and of sizes whose squares are: then matrices hold them."""
    odd = F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) > 1e150))
    found = embeddings.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.max(F.coalesce(odd, F.lit(False))).alias("odd"), F.count_if(F.col("term").isNull() | F.col("vec").isNull()).alias("nulls")).first()
    return found["least"] is not None and 0 < found["least"] == found["most"] and not found["odd"] and not found["nulls"]


def most_similar(embeddings: DataFrame, terms: DataFrame, k: int = 10, block: int = 5000) -> DataFrame:
    """(term, partner, similarity, rank): each given term's k nearest others by cosine, ties to the smaller term.

    Terms and vectors meet in blocks of about `block` each, whose products are those of matrices; each
    block keeps its own k before the blocks are compared.  Vectors of several lengths, or of numbers that are not finite, meet as rows.
    """
    n = embeddings.count()
    parts, every = spread(n, "_part", block)
    stored = embeddings.select(F.col("term").alias("partner"), unit(F.col("vec")).alias("_v"), F.pmod(F.xxhash64("term"), F.lit(parts)).alias("_part"))
    chosen = embeddings.join(terms.select("term").distinct(), "term").select("term", unit(F.col("vec")).alias("_q"))
    asked = chosen.select("term", "_q", every)
    if even(embeddings):
        groups, all_groups = spread(chosen.count(), "_group", block)
        asked = asked.withColumn("_group", F.pmod(F.xxhash64("term"), F.lit(groups)))
        return nearest_in_blocks(asked, stored.select("*", all_groups), ["_part", "_group"], k)
    rows = asked.join(stored, "_part").where("term != partner").select("term", "partner", "_part", F.round(dot(F.col("_q"), F.col("_v")), 6).alias("similarity"))
    own = Window.partitionBy("term", "_part").orderBy(F.desc("similarity"), "partner")
    rows = rows.withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= k).drop("_own", "_part")
    w = Window.partitionBy("term").orderBy(F.desc("similarity"), "partner")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
