"""Points near other points: adaptive cell coverage, interior cells accepted by an equi-join, boundary cells tested exactly.

Each site's circle is covered by quadtree cells over latitude and longitude. Rows near the poles have fewer, wider cells. A cell wholly inside is interior: every point in
it is a match without a distance. A cell crossed by the border is split until the finest level; points in those few are
tested with the haversine formula. Cell bounds come from the triangle inequality on the sphere, so they hold at the poles and
across the antimeridian too; interior cells keep a margin that is far above rounding errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import MAX_BROADCAST_ROWS, written

EARTH_KM = 6371.0088
#: Copies of the coverage when it is too large to broadcast; points of a hot cell are dealt out among them.
SALTS = 32


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the sphere of radius 6371.0088 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def columns_at(row: int, level: int) -> int:
    """Cells along a row: 2^level, fewer (powers of two, about square cells) near the poles. Levels nest."""
    n = 1 << level
    from_pole = min(row + 1, n - row)
    return min(n, 8 << (from_pole - 1).bit_length())


def cell_key(lat: Column, lon: Column, level: int, poles: bool = True) -> Column:
    """The cell of a level (up to 24) that holds the point; the upper edges belong to the last cells.

    ``poles=False`` leaves out what only rows beyond 78.75 degrees need; keys there then match no cell of a cover.
    """
    n = 1 << level
    row = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1)).cast("long")
    wide = F.lit(n).cast("long")
    if level > 3 and poles:  # the same as columns_at; the half keeps the logarithm off whole numbers
        from_pole = F.least(row + 1, n - row)
        bits = F.greatest(F.lit(0), F.floor(F.log2(from_pole - 0.5)) + 1)
        wide = F.when(from_pole > (1 << (level - 4)), wide).otherwise(F.least(wide, (8 * F.pow(F.lit(2.0), bits)).cast("long")))
    col = F.least(F.floor((lon + 180.0) / 360.0 * wide), wide - 1).cast("long")
    return F.lit(level).cast("long") * (1 << 50) + row * (1 << 25) + col


def levels_for(radius_km: float) -> list[int]:
    """Coarsest to finest level, two apart: cells of about the radius down to about a ninth of it."""
    want = math.log2(180.0 / math.degrees(max(radius_km, 1e-3) / EARTH_KM))
    top = max(0, min(20, math.floor(want)))
    return [top, top + 2, top + 4]


def cover(lat: float, lon: float, radius_km: float, levels: list[int]) -> list[tuple[int, bool]]:
    """(cell key, interior) of one circle."""
    out: list[tuple[int, bool]] = []
    todo = [(0, 0, 0)]
    la0 = math.radians(lat)
    while todo:
        level, i, j = todo.pop()
        columns = columns_at(i, level)
        dlat, dlon = math.pi / (1 << level), 2 * math.pi / columns
        south = -math.pi / 2 + i * dlat
        mid, west = south + dlat / 2, -math.pi + j * dlon
        flattest = 1.0 if south < 0 < south + dlat else max(math.cos(south), math.cos(south + dlat))
        reach = EARTH_KM * (dlat / 2 + max(0.0, flattest) * dlon / 2)
        h = math.sin((mid - la0) / 2) ** 2 + math.cos(mid) * math.cos(la0) * math.sin((west + dlon / 2 - math.radians(lon)) / 2) ** 2
        d = 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))
        if d - reach > radius_km + 1e-6:
            continue
        inside = d + reach < radius_km - 1e-6
        if level in levels and (inside or level == levels[-1]):
            out.append(((level << 50) + (i << 25) + j, inside))
        else:
            for row in (2 * i, 2 * i + 1):
                split = columns_at(row, level + 1) // columns
                todo += [(level + 1, row, split * j + b) for b in range(split)]
    return out


def coverage(sites: DataFrame, radius_km: float, levels: list[int], key: str, lat: str, lon: str) -> DataFrame:
    """(cell, interior, site, site_lat, site_lon) of all sites with valid coordinates."""
    s = sites.filter(valid(F.col(lat), F.col(lon))).select(F.col(key).alias("site"), F.col(lat).cast("double").alias("site_lat"), F.col(lon).cast("double").alias("site_lon"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                cells = cover(r.site_lat, r.site_lon, radius_km, levels)
                yield pd.DataFrame({"cell": np.array([c for c, _ in cells], dtype=np.int64), "interior": [x for _, x in cells], "site": r.site, "site_lat": r.site_lat, "site_lon": r.site_lon})

    kind = s.schema["site"].dataType.simpleString()
    return s.mapInPandas(run, f"cell long, interior boolean, site {kind}, site_lat double, site_lon double")


def within_distance(
    points: DataFrame,
    sites: DataFrame,
    radius_km: float,
    point_cols: tuple[str, str, str] = ("msg_id", "lat", "lon"),
    site_cols: tuple[str, str, str] = ("name", "latitude", "longitude"),
) -> DataFrame:
    """(point, site): every pair at most ``radius_km`` apart; one row per point row and site row.

    Points and sites with null, NaN or impossible coordinates match nothing; repeated rows match each on its own. The
    coverage is counted: up to ``MAX_BROADCAST_ROWS`` cells it is broadcast, beyond that both sides are shuffled by cell
    with the points of a cell dealt out over ``SALTS`` copies of its coverage rows, so no cell is a hot key.
    """
    levels = levels_for(radius_km)
    pid, la, lo = point_cols
    p = points.filter(valid(F.col(la), F.col(lo))).select(F.col(pid).alias("point"), F.col(la).cast("double").alias("lat"), F.col(lo).cast("double").alias("lon"))
    c = written(coverage(sites, radius_km, levels, *site_cols), "coverage")
    # whether any circle, with the cells about it, comes near the rows that have fewer columns
    edge = 77.75 - 3 * math.degrees(radius_km / EARTH_KM)
    poles = edge <= 0 or not c.filter(F.abs("site_lat") > edge).isEmpty()
    keyed = p.withColumn("cell", F.explode(F.array(*(cell_key(F.col("lat"), F.col("lon"), v, poles) for v in levels))))
    if c.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        both = keyed.join(F.broadcast(c), "cell")
    else:
        copies = c.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = keyed.withColumn("salt", F.pmod(F.xxhash64("point", "lat", "lon"), F.lit(SALTS)).cast("int")).join(copies, ["cell", "salt"])
    exact = haversine_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon")) <= radius_km
    return both.filter(F.col("interior") | exact).select("point", "site")


def found(positions: DataFrame, ports: DataFrame) -> DataFrame:
    """(msg_id, port_name): each ping and port at most 5 km apart."""
    return within_distance(positions, ports, 5.0).select(F.col("point").alias("msg_id"), F.col("site").alias("port_name"))


def port_calls(positions: DataFrame, ports: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """(port_name, pings): pings near each port, pre-aggregated before the shuffle."""
    near = within_distance(positions, ports, radius_km)
    return near.groupBy(F.col("site").alias("port_name")).agg(F.count(F.lit(1)).alias("pings"))
