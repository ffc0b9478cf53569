"""Irregular readings onto a regular daily grid, missing days marked and never filled.

Method: the readings of each source are cut into time shards (months), each summed up by its first and last reading; the last
reading before each shard is carried in by a prefix scan over these few summaries; every shard is then filled alone: it lays out
the days after the carried one up to its own last one. No shard needs the rows of another, and a hot source is as many
shards as it has months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def readings(df: DataFrame, source: str = "series_id", ts: str = "date", value: str = "value", order: str = "obs_id") -> DataFrame:
    """(source, day, value, n): one row per source and day with a reading; of several the latest in order of arrival.

    A reading is a row whose value is neither null nor NaN and whose source and time are not null. The first aggregation
    combines before the shuffle, so copies and hot sources cost nothing after it.
    """
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & F.col(source).isNotNull() & F.col(ts).isNotNull()
    d = df.filter(ok).select(F.col(source).alias("source"), F.to_date(ts).alias("day"), v.alias("v"), F.col(order).alias("o"))
    # of rows with equal order the largest value; max over (order, value) keeps the state of fixed size
    best = F.max(F.struct("o", "v"))
    return d.groupBy("source", "day").agg(best["v"].alias("value"), F.count(F.lit(1)).alias("n"))


def daily_grid(df: DataFrame, source: str = "series_id", ts: str = "date", value: str = "value", order: str = "obs_id", shard: str = "MONTH") -> DataFrame:
    """(source, day, value, n_readings, missing, last_day, gap_days): one row per calendar day of each source's life.

    ``value`` is null and ``missing`` true on days without a reading. ``last_day`` is the latest day up to this one with a
    reading and ``gap_days`` the days since then. A source without any reading gives no rows; several readings of a day
    give the latest to arrive. Extra columns are ignored.
    """
    r = readings(df, source, ts, value, order).withColumn("shard", F.trunc("day", shard))
    # shard summaries, then the carry: the last reading's day before the shard
    summary = r.groupBy("source", "shard").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    scan = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("carry", F.max("last_day").over(scan))
    # each shard alone: its own days from the one after the carried reading to its last reading
    start = F.coalesce(F.date_add("carry", 1), F.col("first_day"))
    days = carried.select("source", "shard", "carry", F.explode(F.sequence(start, F.col("last_day"))).alias("day"))
    grid = days.join(r.select("source", "day", "value", "n"), ["source", "day"], "left")
    in_shard = Window.partitionBy("source", "shard").orderBy("day")
    seen = F.max(F.when(F.col("n").isNotNull(), F.col("day"))).over(in_shard)
    last: Column = F.coalesce(seen, F.col("carry"))
    return grid.select(
        F.col("source").alias(source),
        "day",
        "value",
        F.coalesce("n", F.lit(0)).alias("n_readings"),
        F.col("n").isNull().alias("missing"),
        last.alias("last_day"),
        F.datediff(F.col("day"), last).alias("gap_days"),
    )


def found(df: DataFrame) -> DataFrame:
    """(series_id, day): the days of a series' life without a reading, off the grid."""
    return daily_grid(df).filter("missing").select("series_id", F.date_format("day", "yyyy-MM-dd").alias("day"))
