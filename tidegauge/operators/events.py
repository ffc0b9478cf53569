"""Event rows: typing, the three-legged regional filter, article-level aggregates by publication time, slots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns with numbers, the region and its country codes (FIPS), terms of the chokepoint, conflict root codes.
NUMERIC = ["ActionGeo_Lat", "ActionGeo_Long", "GoldsteinScale", "AvgTone", "NumMentions", "NumSources", "NumArticles"]
REGION_LAT, REGION_LON = (22.0, 31.0), (46.0, 60.0)
REGION_COUNTRIES = ["IR", "AE", "MU", "SA", "QA", "KU", "BA", "IZ"]
TERMS = ["hormuz", "strait", "fujairah", "jebel ali", "khor fakkan", "tanker", "persian gulf", "arabian gulf", "gulf of oman"]
CONFLICT = ["13", "14", "15", "16", "17", "18", "19", "20"]

SLOT = "15 minutes"


def coerce_numeric(df: DataFrame) -> DataFrame:
    """The numeric columns as doubles; what can't be read, and NaN, as null."""
    cols = {c: F.col(c).try_cast("double") for c in NUMERIC if c in df.columns}
    return df.withColumns({c: F.when(~F.isnan(x), x) for c, x in cols.items()})


def published(df_col: str = "DATEADDED") -> Column:
    """Publication time of a stamp yyyyMMddHHmmss (UTC, without zone); null if unreadable."""
    return F.try_to_timestamp(F.col(df_col), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def day(df_col: str = "DATEADDED") -> Column:
    return F.to_date(published(df_col))


def terms_pattern(terms: list[str] | None = None) -> str:
    """The terms as one regular expression in which any white space stands for a blank."""
    return "(?i)" + "|".join(r"\s+".join(re.escape(w) for w in t.split()) for t in terms or TERMS)


def mentions(text: Column, terms: list[str] | None = None) -> Column:
    """Whether a text holds a term by :func:`terms_pattern`; false for null."""
    return F.coalesce(text.rlike(terms_pattern(terms)), F.lit(False))


def region_legs() -> dict[str, Column]:
    """The legs of the filter: position in the box, country code, term in place name or URL. False where unknown."""
    name, url = F.lower(F.coalesce("ActionGeo_FullName", F.lit(""))), F.lower(F.coalesce("SOURCEURL", F.lit("")))
    word = F.lit(False)
    for t in TERMS:
        word = word | F.contains(name, F.lit(t)) | F.contains(url, F.lit(t))
    box = F.col("ActionGeo_Lat").between(*REGION_LAT) & F.col("ActionGeo_Long").between(*REGION_LON)
    return {"bbox": F.coalesce(box, F.lit(False)), "country": F.coalesce(F.col("ActionGeo_CountryCode").isin(REGION_COUNTRIES), F.lit(False)), "keyword": word}


def tag_region(df: DataFrame, out: str = "region_match") -> DataFrame:
    """``df`` with the names of the legs that hold, joined by ``+``; empty where none does."""
    return df.withColumn(out, F.concat_ws("+", *(F.when(c, F.lit(n)) for n, c in region_legs().items())))


def filter_region(df: DataFrame, out: str = "region_match") -> DataFrame:
    return tag_region(df, out).filter(F.col(out) != "")


def is_conflict() -> Column:
    return F.coalesce(F.col("EventRootCode").isin(CONFLICT), F.lit(False))


def leg_counts(df: DataFrame) -> DataFrame:
    """One row: rows in all, per leg, and by the term alone."""
    legs = region_legs()
    d = df.select(*(c.alias(n) for n, c in legs.items()))
    alone = F.col("keyword") & ~F.col("bbox") & ~F.col("country")
    return d.agg(F.count(F.lit(1)).alias("rows_total"), *(F.count_if(F.col(n)).alias(f"leg_{n}") for n in legs), F.count_if(alone).alias("leg_keyword_only"))


def daily_aggregate(df: DataFrame) -> DataFrame:
    """Rows, distinct articles and means per publication day, and the same of conflict rows; 0 on days without these."""
    c = is_conflict()
    d = df.withColumns({"date": day(), "AvgTone": F.col("AvgTone").try_cast("double"), "GoldsteinScale": F.col("GoldsteinScale").try_cast("double")})
    return d.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("SOURCEURL").alias("articles"), F.avg("AvgTone").alias("tone_mean"),
        F.avg("GoldsteinScale").alias("goldstein_mean"), F.count_if(c).alias("conflict_rows"),
        F.count_distinct(F.when(c, F.col("SOURCEURL"))).alias("conflict_articles"),
    )


def daily_features(df: DataFrame) -> DataFrame:
    """Nine features per readable publication day; conflict features are null, not 0, on days without conflict rows."""
    c = is_conflict()
    d = coerce_numeric(df).withColumn("date", day()).filter("date is not null")
    on = lambda x: F.when(c, F.col(x))
    g = d.groupBy("date").agg(
        F.count(F.lit(1)).alias("events_rows"), F.count_distinct("SOURCEURL").alias("events_articles"), F.avg("AvgTone").alias("tone"),
        F.avg("GoldsteinScale").alias("goldstein"), F.nullif(F.count_if(c), F.lit(0)).alias("conflict_rows"), F.count_distinct(on("SOURCEURL")).alias("ca"),
        F.avg(on("AvgTone")).alias("conflict_tone"), F.avg(on("GoldsteinScale")).alias("conflict_goldstein"),
    )
    ca = F.when(F.col("conflict_rows").isNotNull(), F.col("ca"))
    share = F.try_divide(ca.cast("double"), F.nullif(F.col("events_articles"), F.lit(0)).cast("double"))
    return g.withColumns({"conflict_articles": ca, "conflict_share": share}).drop("ca")


def best_per_article(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per article (and key): the most reported one, ties by the lower event id. Null URLs are one article."""
    w = Window.partitionBy(*keys, "SOURCEURL").orderBy(F.col("NumArticles").desc_nulls_last(), F.col("GlobalEventID").asc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def tension(df: DataFrame, key: str) -> DataFrame:
    """(key, events, articles, reports, goldstein, tone, score): a score 0..100 of the conflict rows of each key.

    Volume counts distinct articles, means are over the best row of each. Missing means add nothing.
    """
    c = coerce_numeric(df).filter(is_conflict())
    rows = c.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("NumArticles", F.lit(0.0))).alias("reports"))
    best = best_per_article(c.select(key, "SOURCEURL", "NumArticles", "GlobalEventID", "GoldsteinScale", "AvgTone"), (key,))
    means = best.groupBy(key).agg(F.count(F.lit(1)).alias("articles"), F.avg("GoldsteinScale").alias("goldstein"), F.avg("AvgTone").alias("tone"))
    j = rows.join(means, rows[key].eqNullSafe(means[key])).drop(means[key])
    volume = F.least(F.col("articles") / 50.0, F.lit(1.0)) * 40.0
    part = lambda x, k: F.greatest(F.lit(0.0), F.coalesce(-F.col(x), F.lit(0.0)) / 10.0) * k
    score = F.least(volume + part("goldstein", 35.0) + part("tone", 25.0), F.lit(100.0))
    return j.select(key, "events", "articles", "reports", "goldstein", "tone", score.alias("score"))


def slots(df: DataFrame) -> DataFrame:
    """``df`` with the start of the 15-minute slot of its publication time."""
    return df.withColumn("slot", F.window(published().cast("timestamp"), SLOT)["start"].cast("timestamp_ntz"))


def missing_slots(df: DataFrame, cap: int | None = None) -> DataFrame:
    """(slot): slots without rows between the first and the last with rows, oldest first up to ``cap`` a gap.

    Only the distinct slots are looked at, and each gap is laid out on its own.
    """
    have = slots(df).filter("slot is not null").select("slot").distinct()
    part = F.date_trunc("MONTH", "slot")
    # gaps within a month by a window of the month; over month borders by the months' first and last slots (few rows)
    d = have.withColumn("m", part)
    inner = d.withColumn("prev", F.lag("slot").over(Window.partitionBy("m").orderBy("slot"))).filter("prev is not null").select("prev", "slot")
    ends = d.groupBy("m").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    across = ends.select(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("m")).alias("prev"), F.col("lo").alias("slot")).filter("prev is not null")
    step = F.expr("interval 15 minutes")
    gap = inner.unionAll(across).filter(F.col("slot") > F.col("prev") + step)
    lost = F.sequence(F.col("prev") + step, F.col("slot") - step, step)
    return gap.select(F.explode(F.slice(lost, 1, cap) if cap else lost).alias("slot"))


def all_slots(start: str, end: str, spark) -> DataFrame:
    """(slot): every slot from the start of one day to the end of another, both inclusive."""
    lo, hi = f"timestamp_ntz'{start} 00:00:00'", f"timestamp_ntz'{end} 23:45:00'"
    return spark.range(1).select(F.explode(F.expr(f"sequence({lo}, {hi}, interval 15 minutes)")).alias("slot"))
