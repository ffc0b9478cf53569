"""The engine's functions: what the service answers, as DataFrames over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import scalar as fn
from tidegauge.operators import aggregates, fusion, intervals, market_model, text_features
from tidegauge.operators import events as ev
from tidegauge.plans import dag, semantic
from tidegauge.session import table
from tidegauge.sources import files

# Hours after which each arm counts as stale.
STALE_AFTER_H = {"events": 1, "market": 96, "positions": 336}


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def between(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows of a range of days, both bounds included and optional."""
    if start:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    return df.filter(F.col(date) <= F.lit(end).cast("date")) if end else df


def freshness(spark: SparkSession, d: str, now: str) -> DataFrame:
    """(arm, as_of, age_hours, status) at a given time."""
    latest = {
        "events": table(spark, d, "event_rows").agg(F.max(ev.published()).alias("as_of")),
        "market": table(spark, d, "market_daily").agg(F.max(F.col("date").cast("timestamp_ntz")).alias("as_of")),
        "positions": table(spark, d, "positions").agg(F.max(F.col("ts_utc").cast("timestamp_ntz")).alias("as_of")),
    }
    out = None
    for arm, df in latest.items():
        age, status = fn.freshness(F.col("as_of"), F.lit(now).cast("timestamp_ntz"), F.lit(STALE_AFTER_H[arm]))
        one = df.select(F.lit(arm).alias("arm"), "as_of", F.round(age, 2).alias("age_hours"), status.alias("status"))
        out = one if out is None else out.unionAll(one)
    return out


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Provenance of every series."""
    m = table(spark, d, "market_daily")
    return m.groupBy("series_id", "label", "source", "official").agg(F.min(F.to_date("date")).alias("first_day"), F.max(F.to_date("date")).alias("last_day"), F.count("value").alias("n"))


def semantic_metrics(spark: SparkSession, arm: str | None = None) -> DataFrame:
    return semantic.metrics(spark, arm)


def semantic_metric(spark: SparkSession, name: str) -> DataFrame:
    return semantic.metric(spark, name)


def semantic_forbidden(spark: SparkSession) -> DataFrame:
    return semantic.forbidden(spark)


def panel(spark: SparkSession, d: str) -> DataFrame:
    """The daily panel: events and market on one calendar. A radar arm joins by ``fusion.panel`` where chips are dated."""
    from tidegauge.plans import core_queries as q

    return fusion.panel(fusion.market_features(q.wide(spark, d)), ev.daily_features(table(spark, d, "event_rows")))


def semantic_audit(spark: SparkSession, d: str) -> DataFrame:
    return semantic.audit(spark, [c for c in panel(spark, d).columns if c != "date"])


def features(spark: SparkSession, d: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A slice of the panel; unknown columns raise ValueError."""
    p = panel(spark, d)
    if columns is not None:
        bad = set(columns) - set(p.columns)
        if bad:
            raise ValueError(f"unknown columns: {sorted(bad)}")
        p = p.select("date", *(c for c in columns if c != "date"))
    return between(p, start, end).orderBy("date")


def arm_events(spark: SparkSession, d: str, start: str | None = None, end: str | None = None, default_days: int = 30) -> DataFrame:
    """Daily event aggregates; without a range the last ``default_days`` up to the latest day."""
    e = table(spark, d, "event_rows")
    if not start and not end:
        last = e.agg(F.max(ev.day())).first()[0]
        if last is not None:
            e = e.filter(ev.day().between(F.date_sub(F.lit(last), default_days), F.lit(last)))
    return between(ev.daily_aggregate(e), start, end).orderBy("date")


def arm_market(spark: SparkSession, d: str, start: str | None = None, end: str | None = None) -> DataFrame:
    from tidegauge.plans import core_queries as q

    return between(q.wide(spark, d), start, end).orderBy("date")


def arm_radar(spark: SparkSession, d: str) -> DataFrame:
    """Detections per chip with the usable flag."""
    from tidegauge.plans import core_queries as q

    c = q.chip_report(spark, d)
    return c.withColumn("usable", F.col("coverage") >= 0.9).orderBy("chip")


def market_anomaly(spark: SparkSession, d: str, start: str | None = None, end: str | None = None) -> DataFrame:
    from tidegauge.plans import core_queries as q

    return between(market_model.scores(q.spread(spark, d), ["brent", "wti", "spread"], q.CAL, q.OTHER, buffer=20), start, end).orderBy("date")


def predict_market(spark: SparkSession, d: str, as_of: str | None = None) -> DataFrame:
    """The score of the last window that ends on or before a day, with its band."""
    s = between(market_anomaly(spark, d), None, as_of)
    return s.orderBy(F.col("date").desc()).limit(1).withColumn("band", fn.band_exclusive(F.col("recon_error"), F.col("p95"), F.col("p99")))


def predict_text(spark: SparkSession, vectors: list[list[float]], disruption: list[list[float]], calm: list[list[float]], p90: float | None = None, p99: float | None = None) -> DataFrame:
    """(n, score, band) of 1 to 64 text vectors of unit length against the anchors."""
    if not 1 <= len(vectors) <= 64:
        raise ValueError("between 1 and 64 texts")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "n int, v array<double>")
    many = lambda a: F.array(*(fn.literal_vector(x) for x in a))
    score = fn.max_similarity(F.col("v"), many(disruption)) - fn.max_similarity(F.col("v"), many(calm))
    return df.select("n", score.alias("score")).withColumn("band", fn.band_inclusive(F.col("score"), F.lit(p90).cast("double"), F.lit(p99).cast("double")))


def recent_titles(spark: SparkSession, d: str, limit: int = 25) -> DataFrame:
    """The newest distinct URL texts of at least four words."""
    e = table(spark, d, "event_rows").select("SOURCEURL", ev.published().alias("at")).filter("at is not null and SOURCEURL is not null")
    t = e.withColumn("text", fn.slug_words(F.col("SOURCEURL"))).filter((F.col("text") != "") & (fn.word_count(F.col("text")) >= 4))
    return t.groupBy("text").agg(F.max("at").alias("at")).orderBy(F.col("at").desc(), "text").limit(limit)


def predict_live(spark: SparkSession, d: str) -> DataFrame:
    """The market's latest band, and of the 25 newest texts the five with the highest scores against the anchors, as (kind, text, value)."""
    m = predict_market(spark, d).select(F.lit("market").alias("kind"), F.col("band").alias("text"), F.col("recon_error").alias("value"))
    t = text_features.contrast(recent_titles(spark, d), "text").orderBy(F.col("chokepoint_score").desc_nulls_last(), "text").limit(5)
    return m.unionAll(t.select(F.lit("title").alias("kind"), "text", F.col("chokepoint_score").alias("value")))


def models(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation of the market model."""
    from tidegauge.plans import core_queries as q

    return market_model.evaluation(market_model.scores(q.spread(spark, d), ["brent", "wti", "spread"], q.CAL, q.OTHER, buffer=20))


def ports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "uae_ports").withColumn("routes", fn.routes(F.col("primary_routes")))


def port_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: ports, those behind the strait, and the names of those that bypass it."""
    p = table(spark, d, "uae_ports")
    return p.agg(F.count(F.lit(1)).alias("ports"), F.count_if("hormuz_dependent").alias("dependent"), F.sort_array(F.collect_list(F.when(~F.col("hormuz_dependent"), F.col("name")))).alias("bypass"), F.count_if(F.col("coord_precision") == "approximate").alias("approximate"))


def chips(spark: SparkSession, d: str, chip: int | None = None, limit: int = 100) -> DataFrame:
    """The chip catalogue; at most 500 rows."""
    if not 1 <= limit <= 500:
        raise ValueError("limit between 1 and 500")
    c = arm_radar(spark, d)
    return (c.filter(F.col("chip") == chip) if chip is not None else c).limit(limit)


def pipeline(spark: SparkSession) -> DataFrame:
    """(position, stage, needs, manual, gate) in running order."""
    by = {s.name: s for s in dag.STAGES}
    rows = [(i, n, list(by[n].needs), by[n].manual, by[n].gate) for i, n in enumerate(dag.order(dag.STAGES))]
    return spark.createDataFrame(rows, "position int, stage string, needs array<string>, manual boolean, gate boolean")


def pipeline_volumes(spark: SparkSession, d: str) -> DataFrame:
    return files.volumes(spark, {n: f"{d}/{n}.parquet" for n in ("event_rows", "market_daily", "positions", "documents")})


def event_calendar(spark: SparkSession) -> DataFrame:
    from tidegauge.plans import core_queries as q

    return intervals.frame(spark, q.CAL)


def risk(spark: SparkSession, d: str, start: str | None = None, end: str | None = None) -> DataFrame:
    from tidegauge.plans import core_queries as q

    return between(fusion.risk_index(q.arms(spark, d)), start, end).orderBy("date")


def brief(spark: SparkSession, d: str) -> DataFrame:
    """One row of facts for a written brief: the latest value and what share of its history lies below, and its change over
    seven rows. No text is generated."""
    from tidegauge.plans import core_queries as q

    x = q.spread(spark, d).filter("spread is not null")
    last = x.agg(F.max("date").alias("d"), F.max_by("spread", "date").alias("v")).first()
    if last["d"] is None:
        return spark.createDataFrame([], "as_of date, value double, percentile double, change_7 double")
    from tidegauge.operators import timeseries as ts

    c = x.withColumn("c", ts.diff(F.col("spread"), 7, ts.ordered()))
    return c.agg(F.max("date").alias("as_of"), F.max_by("spread", "date").alias("value"), (F.avg((F.col("spread") < F.lit(last["v"])).cast("double")) * 100).alias("percentile"), F.max_by("c", "date").alias("change_7"))


def streaming_facts(spark: SparkSession, rows_per_slot: int = 925, slots_per_day: int = 96) -> DataFrame:
    """The volume arithmetic of the feed."""
    n = rows_per_slot * slots_per_day
    return spark.createDataFrame([(rows_per_slot, slots_per_day, n, n / 86_400)], "rows_per_slot int, slots_per_day int, rows_per_day int, rows_per_s double")


def vessels(spark: SparkSession, d: str) -> DataFrame:
    """Live vessel positions are not offered: no free source covers the region."""
    raise NotImplementedError("no live vessel positions; see latest_state_per_key for stored ones")


def store_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files, rows and bytes per dataset of the small-file store."""
    s = table(spark, d, "slot_files")
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.count_if(F.col("n_rows") == 0).alias("empty"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return aggregates.confusion(df, truth, predicted)
