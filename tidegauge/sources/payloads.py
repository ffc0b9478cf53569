"""Answers of outside services as rows, and the requests that ask for them. Nothing is fetched here: fetching is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import events as ev

BARS = "array<struct<Date: string, Close: double, Volume: double>>"
WAYS = "struct<elements: array<struct<id: bigint, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>>>"


def price_bars(df: DataFrame, column: str, series: Column) -> DataFrame:
    """(series_id, date, value, volume, official) of daily price bars (a JSON array a row).

    The closing price is the value; ``date`` is the bar's own wall clock, whatever offset follows it; such sources are never
    official. Bars without a readable date are dropped, those without a close stay as missing.
    """
    b = df.select(series.alias("series_id"), F.inline(F.from_json(column, BARS)))
    wall = F.regexp_extract("Date", r"^(\d{4}-\d{2}-\d{2})[T ]?(\d{2}:\d{2}:\d{2})?", 0)
    at = F.coalesce(*(F.try_to_timestamp(F.replace(wall, F.lit("T"), F.lit(" ")), F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))
    d = b.select("series_id", at.cast("timestamp_ntz").alias("date"), F.when(~F.isnan("Close"), F.col("Close")).alias("value"), F.col("Volume").alias("volume"), F.lit(False).alias("official"))
    return d.filter("date is not null")


def datapoints(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``datapoints``: the lists' items and single numbers in the entries of a JSON report; null where it is no report."""
    entries = F.from_json(column, "struct<entries: array<map<string, variant>>>")["entries"]
    values = F.flatten(F.transform(F.filter(entries, lambda e: e.isNotNull()), lambda e: F.map_values(e)))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    size = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0))
    number = lambda v: kind(v).isin("BIGINT", "DOUBLE", "BOOLEAN") | kind(v).startswith("DECIMAL")
    one = lambda v: F.when(kind(v).startswith("ARRAY"), size(v)).when(number(v), 1).otherwise(0)
    return df.withColumn("datapoints", F.aggregate(F.transform(values, one), F.lit(0), lambda a, x: a + x))


def coast_lines(df: DataFrame, column: str) -> DataFrame:
    """(osm_id, kind, name, line) of the ways of a map service's answer with two points or more; ``line`` holds [lon, lat] pairs."""
    e = df.select(F.explode(F.from_json(column, WAYS)["elements"]).alias("e")).filter(F.size("e.geometry") > 1)
    tags = F.col("e.tags")
    kind = F.coalesce(F.nullif(tags["natural"], F.lit("")), F.nullif(tags["man_made"], F.lit("")), F.lit("unknown"))
    return e.select(F.col("e.id").alias("osm_id"), kind.alias("kind"), tags["name"].alias("name"), F.transform("e.geometry", lambda p: F.array(p["lon"], p["lat"])).alias("line"))


def slot_url(stamp: Column, base: str, translated: bool = False) -> Column:
    """The address of a slot's archive under ``base``; ``stamp`` is yyyyMMddHHmmss."""
    return F.concat(F.lit(base.rstrip("/") + "/"), stamp, F.lit(f".{'translation.' if translated else ''}export.CSV.zip"))


def pull(events: DataFrame, start: str, end: str, terms: list[str] | None = None) -> DataFrame:
    """The retained rows of a range of event days (``Day``, yyyyMMdd, both ends included) that are in the region's box or countries
    or mention a term; any white space stands for a term's blanks. The range is a bound on text, so it reaches the scan."""
    legs = ev.region_legs()
    text = ev.mentions(F.col("SOURCEURL"), terms) | ev.mentions(F.col("ActionGeo_FullName"), terms)
    return events.filter(F.col("Day").between(start, end) & (legs["bbox"] | legs["country"] | text))


def describe(rows: DataFrame, dimension: DataFrame, key: str = "series_id") -> DataFrame:
    """``rows`` with the columns of their dimension record; rows without one are left out. Dimensions are lists of series, so they are broadcast
    where they are as small as that, counted first."""
    from tidegauge.session import broadcast_if_small

    return rows.join(broadcast_if_small(dimension.dropDuplicates([key])), key)


# What a chip request asks the imagery service to compute for each pixel.
BANDS = ("VV", "VH")
_SCRIPT = """//VERSION=3
function setup() { return {input: [{bands: [%s]}], output: {bands: %d, sampleType: "FLOAT32"}}; }
function evaluatePixel(s) { return [%s]; }"""
EPSG_4326 = "http://www.opengis.net/def/crs/EPSG/0/4326"


def chip_request(box: Column, day: Column, side_px: int = 1024, collection: str = "sentinel-1-grd") -> Column:
    """The JSON body that asks for one square chip of both bands of a box (struct south, west, north, east) on a day (UTC)."""
    script = _SCRIPT % (", ".join(f'"{b}"' for b in BANDS), len(BANDS), ", ".join(f"s.{b}" for b in BANDS))
    at = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    period = F.struct(at(day).alias("from"), at(F.date_add(day, 1)).alias("to"))
    bounds = F.struct(F.array(box["west"], box["south"], box["east"], box["north"]).alias("bbox"), F.struct(F.lit(EPSG_4326).alias("crs")).alias("properties"))
    data = F.array(F.struct(F.lit(collection).alias("type"), F.struct(period.alias("timeRange")).alias("dataFilter")))
    tiff = F.array(F.struct(F.lit("default").alias("identifier"), F.struct(F.lit("image/tiff").alias("type")).alias("format")))
    output = F.struct(F.lit(side_px).alias("width"), F.lit(side_px).alias("height"), tiff.alias("responses"))
    return F.to_json(F.struct(F.struct(bounds.alias("bounds"), data.alias("data")).alias("input"), output.alias("output"), F.lit(script).alias("evalscript")))
