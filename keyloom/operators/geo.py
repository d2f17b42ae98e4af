"""Geo sets: sorted sets whose score is a cell of the earth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import geohash as g
from keyloom.keyspace import ranked
from keyloom.operators import zsets as z


def geoadd_to(zsets: DataFrame, positions: DataFrame, nx: bool = False, xx: bool = False) -> tuple[DataFrame, DataFrame]:
    """GEOADD [NX|XX] [CH] into sets that are there: the rows after it, and by key how many were added and (CH) changed."""
    return z.zadd_to(zsets, geoadd(positions), nx=nx, xx=xx)


def geoadd(positions: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """GEOADD: rows (key, member, score) from positions; one outside the valid range is an error."""
    cell = F.coalesce(g.encode(F.col(lon), F.col(lat)), F.raise_error(F.lit("ERR invalid longitude,latitude pair")).cast("bigint"))
    return positions.select("key", "member", cell.cast("double").alias("score"))


def geopos(zsets: DataFrame) -> DataFrame:
    """GEOPOS: the centre of each member's cell."""
    cell = F.col("score").cast("bigint")
    return zsets.select("key", "member", g.decode_lon(cell).alias("lon"), g.decode_lat(cell).alias("lat"))


def geohash(zsets: DataFrame) -> DataFrame:
    return zsets.select("key", "member", g.geohash_text(F.col("score").cast("bigint")).alias("geohash"))


def geodist(zsets: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """GEODIST: pairs (key, a, b) with their distance to 4 places; null where a member is missing."""
    at = geopos(zsets)
    left = at.select("key", F.col("member").alias("a"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    right = at.select("key", F.col("member").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    both = pairs.join(left, ["key", "a"], "left").join(right, ["key", "b"], "left")
    metres = g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return both.select("key", "a", "b", F.round(metres / g.UNITS[unit], 4).alias("dist"))


#: Bands that a reach is cut into, and points of a cell that its centres meet in one task.
BANDS, BLOCK = 2, 512


def _columns(band: Column, height: float, width: float) -> Column:
    """Into how many cells of at least ``width`` degrees, as seen at the equator, a band of latitude is cut."""
    edge = F.least(F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)), F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * 360 / width), F.lit(1)).cast("bigint")


def _half_width(lat: Column, angle: float, box: bool, height: float) -> Column:
    """Degrees of longitude east and west of a centre that reach can lead to; 180 where a pole is within it."""
    if box:  # the widest at the latitude of the box that is nearest to a pole
        lat = F.least(F.abs(lat) + height, F.lit(90.0))
    share = math.sin(angle / 2 if box else angle) / F.cos(F.radians(lat))
    pole = (share >= 1) | (F.lit(not box) & (F.abs(lat) + math.degrees(angle) >= 90)) | F.lit(angle >= math.pi / 2)
    return F.when(pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(share, F.lit(1.0)))) * (2 if box else 1) * 1.000001 + 1e-9)


def _centres_at(points: DataFrame, centres: DataFrame) -> DataFrame:
    """FROMMEMBER: positions of the centres (key, centre, member); none where the key is missing, an error where only the member is."""
    own = points.select("key", "member", F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat"))
    asked = centres.join(points.select("key").distinct(), "key", "left_semi").join(own, ["key", "member"], "left")
    lost = F.raise_error(F.lit("ERR could not decode requested zset member")).cast("double")
    return asked.select("key", "centre", F.coalesce("at_lon", lost).alias("lon"), F.col("at_lat").alias("lat"))


def _met(at: DataFrame, near: DataFrame) -> DataFrame:
    """Points joined with the centres of their cells, with both as vectors (px, py, pz; cx, cy, cz).

    Blocks and not cells are dealt out, to a fixed number of tasks: few bytes make many pairs here, which sizes don't tell.
    """
    cell, tasks = ["key", "band", "cell"], int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = at.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    points = at.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks"))).drop("blocks")
    centres = near.join(blocks, cell).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    points, centres = points.withColumns(_vector("p", "lon", "lat")), centres.withColumns(_vector("c", "clon", "clat"))
    meet = F.struct(*cell, "block").alias("meet")  # one column, which stays what rows are dealt out by when a key is a constant
    points = points.select("key", "member", "lon", "lat", "hash", "px", "py", "pz", meet).repartition(tasks, "meet")
    centres = centres.select("centre", "clon", "clat", "cx", "cy", "cz", meet).repartition(tasks, "meet")
    return points.join(centres, "meet")


def _vector(name: str, lon: str, lat: str) -> dict[str, Column]:
    x, y = F.radians(lon), F.radians(lat)
    return {f"{name}x": F.cos(y) * F.cos(x), f"{name}y": F.cos(y) * F.sin(x), f"{name}z": F.sin(y)}


def geosearch(points: DataFrame, centres: DataFrame, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, descending: bool = False, any_: bool = False) -> DataFrame:
    """GEOSEARCH BYRADIUS or BYBOX (width, height) round many centres at once.

    ``points`` is (key, member, score); ``centres`` is (key, centre, lon, lat), or FROMMEMBER (key, centre, member).  The
    result has a row for each centre and point within reach, with ``dist`` in the unit, position and ``hash``, its cell.
    Points and centres meet in cells of about half the reach's size, bands of latitude cut by longitude, an equi-join on
    (key, band, cell, block): a centre is compared with its neighbourhood alone, and a cell of many points is dealt over
    several tasks.  The rows themselves grow with points times centres where the reach holds a share of all points.  ``count`` keeps the nearest (or farthest) of each
    centre, ties by member; with ``any_`` the first ones in the set's order.
    """
    if (radius is None) == (box is None) or min([radius] if box is None else box) < 0:
        raise ValueError("syntax error")
    if count is not None and count <= 0:
        raise ValueError("COUNT must be > 0")
    if any_ and count is None:
        raise ValueError("the ANY argument requires COUNT argument")
    scale = g.UNITS[unit]
    reach = (radius if box is None else box[1] / 2) * scale
    angle = (radius if box is None else box[0] / 2) * scale / g.EARTH_RADIUS
    height = min(max(math.degrees(reach / g.EARTH_RADIUS), 1e-6) * 1.000001, 180.0)
    width = max(math.degrees(angle), height)
    tall, wide = height / BANDS, width / BANDS
    cells = points.where((F.col("score") == F.floor("score")) & F.col("score").between(0, (1 << 52) - 1))
    at = geopos(cells).withColumn("hash", g.encode(F.col("lon"), F.col("lat")))
    if "member" in centres.columns:
        centres = _centres_at(at, centres)
    band = F.floor((F.col("lat") + 90) / tall)
    at = at.withColumn("band", band).withColumn("n", _columns(F.col("band"), tall, wide))
    at = at.withColumn("cell", F.least(F.floor((F.col("lon") + 180) / 360 * F.col("n")), F.col("n") - 1)).drop("n")
    near = centres.select("key", "centre", F.col("lon").alias("clon"), F.col("lat").alias("clat"), _half_width(F.col("lat"), angle, box is not None, height).alias("half"), F.explode(F.array(*[band + d for d in range(-BANDS, BANDS + 1)])).alias("band"))
    near = near.withColumn("n", _columns(F.col("band"), tall, wide))
    west, east = (F.floor((F.col("clon") + way * F.col("half") + 180) / 360 * F.col("n")) for way in (-1, 1))
    round_the_earth = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    reached = F.when(east - west + 1 >= F.col("n"), round_the_earth).otherwise(F.transform(F.sequence(west, F.least(east, west + F.col("n") - 1)), lambda i: F.pmod(i, F.col("n"))))
    near = near.select("key", "centre", "clon", "clat", "band", F.explode(reached).alias("cell"))
    met = _met(at, near)
    metres = g.distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"))
    if radius is not None:
        # the chord tells all but the rim, where it could round otherwise
        chord, rim = (1 - sum(F.col(f"p{c}") * F.col(f"c{c}") for c in "xyz")) / 2, math.sin(min(reach / g.EARTH_RADIUS / 2, math.pi / 2)) ** 2
        met = met.where((chord < rim - 1e-12) | ((chord < rim + 1e-12) & (metres <= reach)))
    met = met.withColumn("metres", metres)
    if box is not None:
        # the box's width is measured at the candidate's latitude
        along = g.distance(F.col("clon"), F.col("lat"), F.col("lon"), F.col("lat"))
        across = g.distance(F.col("lon"), F.col("clat"), F.col("lon"), F.col("lat"))
        met = met.where((along <= box[0] * scale / 2) & (across <= reach))
    if count is not None:
        way = [F.col("hash")] if any_ else [F.col("metres").desc() if descending else F.col("metres")]
        met = ranked(met, ["key", "centre"], [*way, F.col("member")]).where(F.col("rn") <= count)
    return met.select("key", "centre", "member", F.round(F.col("metres") / scale, 4).alias("dist"), "lon", "lat", "hash")


def georadius(points: DataFrame, key: object, radius: float, unit: str = "m", lon: float | None = None, lat: float | None = None, member: object = None, **options: object) -> DataFrame:
    """GEORADIUS, and with ``member`` GEORADIUSBYMEMBER: a search of one key round one centre; ``store`` takes its result."""
    one = points.sparkSession.range(1).select(F.lit(key).cast(points.schema["key"].dataType).alias("key"), F.lit(0).alias("centre"))
    if member is not None:
        one = one.withColumn("member", F.lit(member).cast(points.schema["member"].dataType))
    elif lon is None or lat is None or not (abs(lon) <= g.LON_MAX and abs(lat) <= g.LAT_MAX):
        raise ValueError("invalid longitude,latitude pair or radius")
    else:
        one = one.select("*", F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
    return geosearch(points, one, radius=radius, unit=unit, **options)


def geosearch_store(zsets: DataFrame, key: object, found: DataFrame, distances: bool = False) -> DataFrame:
    """GEOSEARCHSTORE, GEORADIUS STORE: found members in place of ``key``, with their cells or, STOREDIST, their distances as scores."""
    score: Column = F.col("dist") if distances else F.col("hash").cast("double")
    return z.store(zsets, key, found.select("member", score.alias("score")))
