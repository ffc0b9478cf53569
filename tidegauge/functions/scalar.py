"""Column functions: URL slugs, vectors, geography, decibels, bands, JSON-safe rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path segments that are no headline, file extensions, and what a word is (Latin, Arabic or Cyrillic, three or more).
STOP_SEGMENTS = ["news", "article", "articles", "story", "stories", "index", "world", "politics", "business", "en", "ar", "amp", "www"]
EXTENSION = r"(?i)\.(html?|php|aspx?|shtml|jsp)$"
WORD = r"[A-Za-z\x{0600}-\x{06FF}\x{0400}-\x{04FF}]{3,}"


def slug_words(url: Column, least: int = 4) -> Column:
    """Headline words of a URL path in lower case, joined by blanks; empty where there are none, null for null.

    The last segment counts; if it has too few words, the longest one (the first of equals) where it has more. Percent escapes
    are decoded, a malformed one leaves the path as it is; ``+`` stays.
    """
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    segs = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, EXTENSION, ""))
    words = lambda s: F.filter(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), lambda w: ~F.lower(w).isin(STOP_SEGMENTS))
    empty = F.lit("")
    last = words(F.coalesce(F.try_element_at(segs, F.lit(-1)), empty))
    longest = words(F.aggregate(segs, empty, lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a)))
    pick = F.when((F.size(last) < least) & (F.size(longest) > F.size(last)), longest).otherwise(last)
    return F.when(url.isNotNull(), F.lower(F.array_join(pick, " ")))


def root_code(code: Column) -> Column:
    """Event root codes of two digits or more: a leading zero where there is one digit, no blanks."""
    c = F.trim(code)
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def word_count(text: Column) -> Column:
    """Blanks plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-case text holds any of the literal terms; false for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(t, F.lit(term))
    return out


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; the cosine where both have unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal_vector(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def max_similarity(v: Column, anchors: Column) -> Column:
    """Highest dot product with any vector of an array of vectors."""
    return F.array_max(F.transform(anchors, lambda a: dot(v, a)))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def mean_squared_error(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    e = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(e, F.size(a).cast("double"))


def decibel(x: Column) -> Column:
    return 10.0 * F.log10(F.greatest(x, F.lit(1e-6)))


def clip_scale(x: Column, lo: float, hi: float) -> Column:
    """(x - lo) / (hi - lo) clipped to 0..1; null and NaN as 0."""
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(y)


def box_around(lat: Column, lon: Column, half_km: Column) -> Column:
    """struct(south, west, north, east) of a square around a point, rounded to 6 decimals."""
    dlat = half_km / 111.0
    dlon = half_km / (111.0 * F.greatest(F.lit(0.2), F.abs(F.cos(F.radians(lat)))))
    r = lambda c, n: F.round(c, 6).alias(n)
    return F.struct(r(lat - dlat, "south"), r(lon - dlon, "west"), r(lat + dlat, "north"), r(lon + dlon, "east"))


def box_polygon(box: Column) -> Column:
    """GeoJSON polygon of a box, closed."""
    p = lambda x, y: F.array(box[x], box[y])
    ring = F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north"), p("west", "south"))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def pixel(coord: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Pixel of a coordinate between two edges, truncated toward zero and clipped to 0..n-1."""
    at = (F.try_divide(coord - lo, hi - lo) * n).cast("long")
    return F.greatest(F.lit(0), F.least(n - 1, at))


def coverage_status(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "EMPTY").when(c < 0.9, "PARTIAL").otherwise("FULL")


def band_exclusive(x: Column, elevated: Column, high: Column) -> Column:
    """HIGH above ``high``, ELEVATED above ``elevated``, else NORMAL; UNCALIBRATED without a value or limit."""
    bad = x.isNull() | elevated.isNull() | high.isNull()
    return F.when(bad, "UNCALIBRATED").when(x > high, "HIGH").when(x > elevated, "ELEVATED").otherwise("NORMAL")


def band_inclusive(x: Column, elevated: Column, high: Column) -> Column:
    """The same with the limits themselves included."""
    bad = x.isNull() | elevated.isNull() | high.isNull()
    return F.when(bad, "UNCALIBRATED").when(x >= high, "HIGH").when(x >= elevated, "ELEVATED").otherwise("NORMAL")


def freshness(as_of: Column, now: Column, stale_after_h: Column) -> tuple[Column, Column]:
    """(age in hours, status): NO DATA, STALE (older than the limit) or CURRENT."""
    age = F.timestamp_diff("SECOND", as_of, now) / 3600.0
    return age, F.when(as_of.isNull(), "NO DATA").when(age > stale_after_h, "STALE").otherwise("CURRENT")


def json_rows(df: DataFrame) -> DataFrame:
    """(json): one JSON object a row, dates as yyyy-MM-dd, NaN and null as null."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def redact(text: Column, keep: int = 4) -> Column:
    """All but the last ``keep`` characters masked."""
    n = F.greatest(F.lit(0), F.length(text) - keep)
    return F.concat(F.repeat(F.lit("*"), n), F.substr(text, n + 1))


def routes(text: Column) -> Column:
    """A pipe-separated list as an array without surrounding blanks; empty for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
