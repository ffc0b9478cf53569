"""Daily market features, the panel, its leakage checks, and the fusion of arms into one index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import timeseries as ts

WEIGHTS = {"arm_b": 0.5, "arm_c": 0.5, "arm_a": 0.0}
#: Derived market columns and the column each may not outlive.
SOURCES = {
    "brent_ret_1d": "brent", "brent_ret_7d": "brent", "brent_vol_7d": "brent", "spread_chg_7d": "brent_wti_spread", "spread_z": "brent_wti_spread",
    "spread_smooth_10d": "brent_wti_spread", "spread_days_gt15_30d": "brent_wti_spread",
}


def market_wide(market: DataFrame, labels: list[str]) -> DataFrame:
    """(date, one column per label): the last valid value of each day, in order of time and arrival."""
    d = market.withColumn("day", F.to_date("date"))
    return ts.pivot_last(d, "day", "label", "value", labels, ["date", "obs_id"]).withColumnRenamed("day", "date")


def market_features(wide: DataFrame, brent: str = "brent", wti: str = "wti", gas: str | None = "gas", limit: float = 15.0) -> DataFrame:
    """The market columns over the panel's own rows (trading days, not calendar days); see ``SOURCES``."""
    w = ts.ordered()
    d = wide.select("date", F.col(brent).alias("brent"), F.col(wti).alias("wti"), *([F.col(gas).alias("gas")] if gas else []))
    d = d.withColumn("brent_wti_spread", F.col("brent") - F.col("wti"))
    b, s = F.col("brent"), F.col("brent_wti_spread")
    d = d.withColumns({
        "brent_ret_1d": ts.pct_change(b, 1, w),
        "brent_ret_7d": ts.pct_change(b, 7, w),
        "spread_chg_7d": ts.only_where(ts.diff(s, 7, w), s),
        "spread_z": ts.only_where(ts.rolling_z(s, 252, 60, w), s),
        "spread_smooth_10d": ts.only_where(ts.rolling(F.avg, s, 10, 5, w), s),
        "spread_days_gt15_30d": ts.only_where(ts.count_above(s, limit, 30, 10, w), s),
    })
    r = F.col("brent_ret_1d")
    return d.withColumn("brent_vol_7d", ts.only_where(ts.rolling(F.stddev_samp, r, 7, 3, w), r))


def port_features(detections: DataFrame, ports: list[str], least: float = 0.9) -> DataFrame:
    """(date, vessels_<port>...): mean vessels of fully covered chips; partial ones are dropped, not scaled."""
    n = F.coalesce(F.col("n_on_water"), F.col("n_detections"))
    d = detections.filter(F.coalesce(F.col("coverage"), F.lit(0.0)) >= least).withColumn("v", n)
    p = d.groupBy("date").pivot("port", ports).agg(F.avg("v"))
    return p.withColumnsRenamed({c: f"sar_vessels_{c}" for c in ports})


def panel(*arms: DataFrame) -> DataFrame:
    """The daily panel: tables keyed by date (market, events, radar, ...) on one calendar without gaps. Empty arms are left out; what an arm doesn't
    say of a day is missing. ValueError if no arm has rows."""
    have = [a for a in arms if not a.isEmpty()]
    if not have:
        raise ValueError("no arm has rows")
    return ts.densify(have)


def leakage(panel: DataFrame, sources: dict[str, str] = SOURCES) -> DataFrame:
    """(column, problem): derived columns that outlive, outnumber or precede their source, or equal their own next value.

    The panel is read twice at most: one aggregation for all columns' counts and ends, one window for all correlations.
    """
    cols = [c for c in panel.columns if c != "date"]
    own = {c: p for c, p in sources.items() if c in cols and p in cols}
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col("date"))
    stats: list[Column] = []
    for c in sorted({*own, *own.values()}):
        stats += [F.count(c).alias(f"{c}__n"), F.min(seen(c)).alias(f"{c}__lo"), F.max(seen(c)).alias(f"{c}__hi")]
    one = panel.agg(*stats, F.count(F.lit(1)).alias("rows__"), F.count_distinct("date").alias("days__"))
    checks = []
    say = lambda c, cond, what: F.when(cond, F.struct(F.lit(c).alias("column"), F.lit(what).alias("problem")))
    for c, p in own.items():
        checks.append(say(c, F.col(f"{c}__hi") > F.col(f"{p}__hi"), "outlives its source"))
        checks.append(say(c, F.col(f"{c}__n") > F.col(f"{p}__n"), "has more values than its source"))
        checks.append(say(c, F.col(f"{c}__lo") < F.col(f"{p}__lo"), "starts before its source"))
    checks.append(say("date", F.col("rows__") > F.col("days__"), "repeated dates"))
    a = one.select(F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))
    long = panel.select("date", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))))
    b = ts.lag1_autocorrelation(long, "v", 60, ["column"]).filter("suspect")
    return a.unionByName(b.select("column", F.lit("equals its own next value").alias("problem")))


def risk_index(arms: DataFrame, weights: dict[str, float] = WEIGHTS, least: int = 120) -> DataFrame:
    """(date, rank_<arm>..., arms_available, weight_available, risk_index): causal percentile ranks of the arms, weighted.

    Weights are renormalised over the arms present on a day: a missing arm is not a zero arm. Null unless the arms present
    carry at least half the declared weight. Arms are ranked in long form, each a series of its own.
    """
    names = [c for c in arms.columns if c != "date"]
    long = arms.select("date", F.inline(F.array(*(F.struct(F.lit(c).alias("arm"), F.col(c).cast("double").alias("v")) for c in names))))
    r = ts.causal_rank(long, "v", least, ["arm"]).groupBy("date").pivot("arm", names).agg(F.first("rank", ignorenulls=True))
    r = r.withColumnsRenamed({c: f"rank_{c}" for c in names})
    w = {c: float(weights.get(c, 0.0)) for c in names}
    rank = {c: F.col(f"rank_{c}") for c in names}
    total = lambda xs: sum(xs, F.lit(0.0))
    present = total(F.when(rank[c].isNotNull(), w[c]).otherwise(0.0) for c in names)
    idx = F.try_divide(total(F.coalesce(rank[c] * w[c], F.lit(0.0)) for c in names), F.nullif(present, F.lit(0.0))) * 100.0
    out = r.withColumns({"arms_available": sum((rank[c].isNotNull().cast("int") for c in names), F.lit(0)), "weight_available": present})
    return out.withColumn("risk_index", F.when(present >= 0.5 * sum(w.values()), idx))
