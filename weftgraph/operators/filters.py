"""Projections and filters over nodes, bindings and nested records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INLINE = 1000


def project(df: DataFrame, outputs: list[str], flat: bool = False) -> DataFrame:
    """The named outputs as columns, or as one array of texts."""
    return df.select(F.array(*[F.col(c).cast("string") for c in outputs]).alias("row")) if flat else df.select(*outputs)


def run_template(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """A SQL template with named parameters; lists become arrays."""
    return spark.sql(text, args={k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else v for k, v in parameters.items()})


def where_in(df: DataFrame, column: str, ids: list | DataFrame) -> DataFrame:
    """Rows whose column is among ids: a short list is a predicate, a longer one or a table a semi-join."""
    if isinstance(ids, list) and len(ids) <= INLINE:
        return df.where(F.col(column).isin(ids))
    if isinstance(ids, list):
        ids = df.sparkSession.createDataFrame([(x,) for x in ids], [column])
    return df.join(ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], column), column, "left_semi")


def iregex(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs, whatever the case."""
    return F.rlike(c, F.lit(f"(?i){pattern}"))


def with_prefix(c: Column, prefix: str) -> Column:
    """Whether an identifier has a vocabulary's prefix."""
    return F.startswith(c, F.lit(f"{prefix}:"))


def pick(c: Column, key: str, value: str, out: str) -> Column:
    """Field out of the structs of an array whose field key equals value."""
    return F.transform(F.filter(c, lambda x: x[key] == value), lambda x: x[out])


def filter_nodes(nodes: DataFrame, labels: list[str], properties: list[str]) -> DataFrame:
    """id and chosen properties of the nodes (id, labels, properties) that have any of the labels."""
    wanted = F.array(*[F.lit(x) for x in labels])
    return nodes.where(F.arrays_overlap("labels", wanted)).select("id", *[F.col("properties")[p].alias(p) for p in properties])


def pmids(publications: Column) -> Column:
    """The ids of an array of structs whose first four characters are PMID in any case; null arrays are empty."""
    found = F.filter(publications, lambda p: F.upper(F.substring(p["id"], 1, 4)) == "PMID")
    return F.coalesce(F.transform(found, lambda p: p["id"]), F.array().cast("array<string>"))


def patients_where(patients: DataFrame, as_of: str, age: int | None = None, sex: str | None = None, race: str | None = None, lat_long: tuple[float, float] | None = None) -> DataFrame:
    """Patients by any of age in whole years at a date, sex, race and place (geoCode)."""
    years = F.floor(F.months_between(F.lit(as_of).cast("date"), "birth_date") / 12)
    place = lat_long or (None, None)
    tests = [(age, years), (sex, F.col("sex")), (race, F.col("race")), (place[0], F.col("geoCode.lat")), (place[1], F.col("geoCode.long"))]
    for value, column in tests:
        if value is not None:
            patients = patients.where(column == F.lit(value))
    return patients


def filter_exposures(exposures: DataFrame, kind: str, start: str, end: str, lat_lon: tuple[float, float] | None = None) -> DataFrame:
    """Exposures of a kind from start to end, both days included, at a point if one is given."""
    out = exposures.where((F.col("exposure_type") == kind) & F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out if lat_lon is None else out.where((F.col("lat") == lat_lon[0]) & (F.col("lon") == lat_lon[1]))


def within_radius(df: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Rows whose lat and lon lie within radius_km of a point, with distance_km; a latitude band is filtered first."""
    band = math.degrees(radius_km / 6371.0)
    a = F.pow(F.sin(F.radians(F.col("lat") - lat) / 2), 2) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lon") - lon) / 2), 2)
    return df.where(F.col("lat").between(lat - band, lat + band)).withColumn("distance_km", 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))).where(F.col("distance_km") <= radius_km)


EARTH = 6371.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points, by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def cells_of_band(band: Column, height: float) -> Column:
    """How many cells a band of latitude has: about as wide as high at its widest, one at least."""
    low, high = band * height - 90, (band + 1) * height - 90
    widest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.greatest(F.lit(1), F.floor(360 / height * F.cos(F.radians(F.least(widest, F.lit(90.0)))))).cast("long")


def within_radius_of(points: DataFrame, places: DataFrame) -> DataFrame:
    """points (lat, lon and others) beside each of the places (place, lat, lon, radius_km) within whose radius they lie, with distance_km.

    The earth is cut into bands of latitude and these into cells, sized by the largest radius; a place
    goes to the cells that its circle meets, a point to the one that it lies in, and the two meet there.
    Longitudes wrap round at 180 degrees, and a circle round a pole meets whole bands.  Rows with a
    null, and negative radii, meet nothing; a place's circle must be smaller than the half of the earth.
    """
    radius = places.agg(F.max("radius_km")).first()[0] or 0.0
    height = min(90.0, max(math.degrees(float(radius) / EARTH), 1e-4) * 1.0000001)
    band = lambda lat: F.floor((lat + 90) / height).cast("long")
    place = places.where("radius_km >= 0 and lat is not null and lon is not null").select(F.col("place"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("radius_km").alias("_km"))
    angle = F.col("_km") / EARTH + 1e-12
    reach = F.degrees(angle)
    bands = F.sequence(band(F.greatest(F.col("_lat") - reach, F.lit(-90.0))), band(F.least(F.col("_lat") + reach, F.lit(90.0))))
    place = place.withColumn("_band", F.explode(bands)).withColumn("_cells", cells_of_band(F.col("_band"), height))
    polar = F.abs("_lat") + reach >= 90
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("_lat"))))) + 1e-9
    cell = lambda lon: F.floor(lon / (360 / F.col("_cells"))).cast("long")
    first, last = cell(F.col("_lon") - wide), cell(F.col("_lon") + wide)
    every = F.when(polar | (last - first + 1 >= F.col("_cells")), F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1))
    some = F.transform(F.sequence(F.least(first, last), last), lambda i: F.pmod(i, F.col("_cells")))
    place = place.withColumn("_cell", F.explode(F.coalesce(every, some))).drop("_cells")
    own = points.withColumn("_band", band(F.col("lat"))).withColumn("_cells", cells_of_band(F.col("_band"), height))
    own = own.withColumn("_cell", F.pmod(cell(F.col("lon")), F.col("_cells"))).drop("_cells")
    near = own.join(place, ["_band", "_cell"]).withColumn("distance_km", distance(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return near.where(F.col("distance_km") <= F.col("_km")).select(*points.columns, "place", "distance_km")


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of all columns."""
    return df.orderBy(*df.columns).limit(n)


def limit_each(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows of each key, in the order of the other columns."""
    w = Window.partitionBy(key).orderBy(*[c for c in df.columns if c != key])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column has a value."""
    return df.where(F.col(column) == F.lit(value))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in whose column a pattern occurs."""
    return df.where(F.rlike(column, F.lit(pattern)))


def enabled(transitions: DataFrame) -> DataFrame:
    """Transitions but those of the link UNKNOWN."""
    return transitions.where("link != 'UNKNOWN'")
