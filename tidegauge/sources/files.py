"""Readers and writers: event slots, JSON sidecars, port lists, series, chips, partitioned and atomic stores, message queues."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 61 columns of a raw event row, in the order of the files, and those that the store keeps.
EVENT_COLUMNS = """GlobalEventID Day MonthYear Year FractionDate
Actor1Code Actor1Name Actor1CountryCode Actor1KnownGroupCode Actor1EthnicCode Actor1Religion1Code Actor1Religion2Code Actor1Type1Code Actor1Type2Code Actor1Type3Code
Actor2Code Actor2Name Actor2CountryCode Actor2KnownGroupCode Actor2EthnicCode Actor2Religion1Code Actor2Religion2Code Actor2Type1Code Actor2Type2Code Actor2Type3Code
IsRootEvent EventCode EventBaseCode EventRootCode QuadClass GoldsteinScale NumMentions NumSources NumArticles AvgTone
Actor1Geo_Type Actor1Geo_FullName Actor1Geo_CountryCode Actor1Geo_ADM1Code Actor1Geo_ADM2Code Actor1Geo_Lat Actor1Geo_Long Actor1Geo_FeatureID
Actor2Geo_Type Actor2Geo_FullName Actor2Geo_CountryCode Actor2Geo_ADM1Code Actor2Geo_ADM2Code Actor2Geo_Lat Actor2Geo_Long Actor2Geo_FeatureID
ActionGeo_Type ActionGeo_FullName ActionGeo_CountryCode ActionGeo_ADM1Code ActionGeo_ADM2Code ActionGeo_Lat ActionGeo_Long ActionGeo_FeatureID
DATEADDED SOURCEURL""".split()
RETAINED = """GlobalEventID Day DATEADDED Actor1Name Actor1CountryCode Actor2Name Actor2CountryCode EventCode EventBaseCode EventRootCode QuadClass
GoldsteinScale NumMentions NumSources NumArticles AvgTone ActionGeo_FullName ActionGeo_CountryCode ActionGeo_Lat ActionGeo_Long SOURCEURL""".split()

RAW = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])
PORT = "name string, emirate string, coast_side string, hormuz_dependent boolean, type string, role string, primary_routes string, latitude double, longitude double, coord_precision string"


class SchemaError(RuntimeError):
    """Raw rows that don't look like event rows."""


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw event rows of tab-separated lines: too many fields drop the line, missing ones are null, quotes are ordinary."""
    d = lines.filter(F.length(column) > 0).select(F.split(column, "\t", -1).alias("f")).filter(F.size("f") <= len(EVENT_COLUMNS))
    none = lambda c: F.when(c != "", c)
    return d.select(*(none(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(EVENT_COLUMNS)))


def read_event_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw event rows of plain or gzip text files."""
    return parse_lines(spark.read.text(path))


def read_event_zips(spark: SparkSession, path: str) -> DataFrame:
    """Raw event rows of zipped slot files, one small archive a slot; unreadable archives give no rows."""
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for n in z.namelist():
                            text = z.read(n).decode("utf-8", "replace")
                            yield pd.DataFrame({"value": text.split("\n")})
                except zipfile.BadZipFile:
                    continue

    files = spark.read.format("binaryFile").load(path).select("content")
    return parse_lines(files.mapInPandas(unzip, "value string").select(F.rtrim("value", F.lit("\r")).alias("value")))


def validate(df: DataFrame, ids: float = 0.95, urls: float = 0.8) -> None:
    """Raise SchemaError unless the columns are those of event rows, ids are digits and URLs are URLs; empty tables pass."""
    if df.columns != EVENT_COLUMNS:
        raise SchemaError(f"{len(df.columns)} columns or other names than expected")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    r = df.agg(F.count(F.lit(1)).alias("n"), share(F.col("GlobalEventID").rlike(r"^\d+$")).alias("ids"), share(F.startswith(F.lower("SOURCEURL"), F.lit("http"))).alias("urls")).first()
    if r["n"] and (r["ids"] < ids or r["urls"] < urls):
        raise SchemaError(f"{r['ids']:.0%} numeric ids, {r['urls']:.0%} URLs")


def column_gaps(df: DataFrame, wanted: Iterable[str]) -> list[tuple[str, str | None]]:
    """(missing column, its name in other case if there is one)."""
    have = {c.lower(): c for c in df.columns}
    return [(w, have.get(w.lower())) for w in wanted if w not in df.columns]


def read_partitioned(spark: SparkSession, root: str, schema: str | T.StructType | None = None, start: str | None = None, end: str | None = None, part: str = "dt") -> DataFrame:
    """A store partitioned by ``dt=``, pruned to a range of days; files may lack columns."""
    r = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    d = r.parquet(root)
    if start:
        d = d.filter(F.col(part) >= F.lit(start).cast("date"))
    return d.filter(F.col(part) <= F.lit(end).cast("date")) if end else d


def newest_files(spark: SparkSession, root: str, partitions: int = 3, files: int = 8, part: str = "dt") -> DataFrame:
    """Rows of the newest files of a store: the last ``partitions`` days, ``files`` of each by name.

    Only the folders of days and the files of the chosen days are listed; no row is read to choose them. FileNotFoundError without a day.
    """
    fs, p = _fs(spark, root)
    days = sorted((s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{part}=")), reverse=True)[:partitions]
    names: list[str] = []
    for day in days:
        own = sorted((s.getPath().toString() for s in fs.listStatus(_fs(spark, day)[1]) if s.getPath().getName()[0] not in "._"), reverse=True)
        names += own[:files]
    if not names:
        raise FileNotFoundError(root)
    return spark.read.option("basePath", root).parquet(*names)


def read_json_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Files that each hold a JSON array or object, nested; unreadable ones are skipped."""
    r = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r).json(path)


def read_ports(spark: SparkSession, *paths: str) -> DataFrame:
    """The first port list (CSV with header) that exists, routes as an array; FileNotFoundError if none does."""
    from tidegauge.functions.scalar import routes

    for p in paths:
        if exists(spark, p):
            d = spark.read.schema(PORT).option("header", "true").csv(p)
            return d.withColumn("routes", routes(F.col("primary_routes")))
    raise FileNotFoundError(paths)


def parse_observations(df: DataFrame, column: str, series: Column) -> DataFrame:
    """(series_id, date, value) of a series service's JSON answers; ``.`` and empty mean no value and are dropped."""
    kind = "struct<observations: array<struct<date: string, value: string>>>"
    o = df.select(series.alias("series_id"), F.explode(F.from_json(column, kind)["observations"]).alias("o"))
    v = F.trim("o.value")
    return o.filter(~v.isin(".", "")).select("series_id", F.to_date(F.try_to_timestamp("o.date", F.lit("yyyy-MM-dd"))).alias("date"), v.try_cast("double").alias("value")).filter("value is not null and date is not null")


AIS = """MessageType string, MetaData struct<MMSI: string, ShipName: string, latitude: double, longitude: double, time_utc: string>,
Message struct<PositionReport: struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: double, NavigationalStatus: bigint>,
ShipStaticData: struct<Name: string, Type: bigint, Destination: string, CallSign: string, MaximumStaticDraught: double, ImoNumber: bigint>>"""


def parse_ais(df: DataFrame, column: str, received: Column) -> DataFrame:
    """Position and static messages as rows of one shape; other messages and those without an id are dropped."""
    m = df.withColumn("__m", F.from_json(F.col(column), AIS)).withColumn("ts_utc", received)
    p, s = "__m.Message.PositionReport.", "__m.Message.ShipStaticData."
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return m.filter(F.col("__m.MetaData.MMSI").isNotNull() & F.col("__m.MessageType").isin("PositionReport", "ShipStaticData")).select(
        F.col("__m.MetaData.MMSI").alias("mmsi"), "ts_utc", F.coalesce(p + "Latitude", "__m.MetaData.latitude").alias("lat"), F.coalesce(p + "Longitude", "__m.MetaData.longitude").alias("lon"),
        F.col(p + "Sog").alias("sog"), F.col(p + "Cog").alias("cog"), F.col(p + "TrueHeading").alias("heading"), F.col(p + "NavigationalStatus").alias("nav_status"),
        F.coalesce(text(F.col(s + "Name")), text(F.col("__m.MetaData.ShipName"))).alias("name"), F.col(s + "Type").alias("ship_type"), text(F.col(s + "Destination")).alias("destination"),
        F.when(F.col(s + "MaximumStaticDraught") > 0, F.col(s + "MaximumStaticDraught")).alias("draught"), F.col(s + "ImoNumber").alias("imo"),
    )


def read_pixels(spark: SparkSession, path: str, decode) -> DataFrame:
    """Chips of binary raster files: ``decode(bytes) -> (vv, vh)`` arrays, as (path, row, col, vv, vh). One file at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                vv, vh = decode(raw)
                r, c = np.indices(vv.shape)
                yield pa.RecordBatch.from_arrays([pa.array([name] * vv.size), pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(vv.ravel(), pa.float64()), pa.array(vh.ravel(), pa.float64())], names=["path", "row", "col", "vv", "vh"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, col int, vv double, vh double")


# ------------------------------------------------------------------ the file system


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def volumes(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    """(name, files, bytes, oldest, newest) of the files that match each glob; listed by the executors."""
    out = None
    for name, glob in patterns.items():
        fs, p = _fs(spark, glob)
        hits = fs.globStatus(p)
        if hits is None or len(hits) == 0:
            one = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("timestamp").alias("oldest"), F.lit(None).cast("timestamp").alias("newest"))
        else:
            f = spark.read.format("binaryFile").load(glob).select("length", "modificationTime")
            one = f.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min("modificationTime").alias("oldest"), F.max("modificationTime").alias("newest"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ writers


def publish(spark: SparkSession, path: str, what: dict) -> None:
    """Write a pointer file as one object, over the one before: the single step by which readers come to see new tables."""
    fs, target = _fs(spark, path)
    out = fs.create(target, True)  # an object appears whole when it is closed
    out.write(bytearray(json.dumps(what, default=str).encode()))
    out.close()


def published(spark: SparkSession, path: str) -> dict:
    """What the pointer file says; FileNotFoundError if nothing was published."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    held = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
    finally:
        held.close()


def write_slots(df: DataFrame, root: str, part: str = "dt") -> None:
    """Write day partitions, replacing only those in ``df``; the commit is the writer's, so a reader never sees half a slot."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(part).parquet(root)


def not_stored(df: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """Rows whose keys the store doesn't have; all if there is no store."""
    spark = df.sparkSession
    if not exists(spark, root):
        return df
    return df.join(spark.read.parquet(root).select(*keys).distinct(), keys, "left_anti")


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def consolidate(df: DataFrame, path: str, order: list[str], files: int | None = None, target: int = 128 << 20) -> None:
    """A few sorted files, cut by range; as many as the planned size needs for files of ``target`` bytes (the session's
    shuffle partitions where the size is unknown), unless ``files`` says."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unknown = size >= int(spark.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    n = files or (int(spark.conf.get("spark.sql.shuffle.partitions")) if unknown else max(1, -(-size // target)))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def report(row: dict, spark: SparkSession, path: str) -> None:
    """A one-row JSON report."""
    spark.createDataFrame([(json.dumps(row, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def queue_source(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """A topic from its earliest message; needs Spark's Kafka connector on the class path."""
    r = (spark.readStream if stream else spark.read).format("kafka")
    return r.option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def queue_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, value): rows as messages keyed by a column."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
