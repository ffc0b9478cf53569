"""The metric registry: what every published column means, and what may not be said of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    arm: str
    definition: str
    unit: str
    source: str
    cadence: str
    official: bool = True
    caveats: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


_EV, _MK, _SAR, _TX, _FU = "events", "market", "sar", "text", "fusion"
_ROWS = "rows overcount articles; compare distinct articles"

METRICS = (
    Metric("events_rows", _EV, "Event rows published on the day", "rows", "event feed", "15 minutes", caveats=(_ROWS,), forbidden=("number of incidents",)),
    Metric("events_articles", _EV, "Distinct article URLs published on the day", "articles", "event feed", "15 minutes"),
    Metric("tone", _EV, "Mean tone of the day's rows", "-100..100", "event feed", "15 minutes", forbidden=("public opinion",)),
    Metric("goldstein", _EV, "Mean Goldstein score of the day's rows", "-10..10", "event feed", "15 minutes"),
    Metric("conflict_rows", _EV, "Rows with a conflict root code; null on days without", "rows", "event feed", "15 minutes", caveats=(_ROWS,)),
    Metric("conflict_articles", _EV, "Distinct articles with a conflict root code", "articles", "event feed", "15 minutes", forbidden=("number of attacks",)),
    Metric("conflict_tone", _EV, "Mean tone of conflict rows", "-100..100", "event feed", "15 minutes"),
    Metric("conflict_goldstein", _EV, "Mean Goldstein score of conflict rows", "-10..10", "event feed", "15 minutes"),
    Metric("conflict_share", _EV, "Conflict articles over all articles", "share", "event feed", "15 minutes"),
    Metric("brent", _MK, "Brent spot, last value of the day", "USD/bbl", "official series", "daily"),
    Metric("wti", _MK, "WTI spot, last value of the day", "USD/bbl", "official series", "daily"),
    Metric("gas", _MK, "Gas spot, last value of the day", "USD/MMBtu", "official series", "daily"),
    Metric("brent_wti_spread", _MK, "Brent less WTI on the same day", "USD/bbl", "derived", "daily", caveats=("a contract expiry moves it too",), forbidden=("closure probability",)),
    Metric("brent_ret_1d", _MK, "Change of Brent over one panel row", "%", "derived", "daily"),
    Metric("brent_ret_7d", _MK, "Change of Brent over seven panel rows", "%", "derived", "daily", caveats=("rows are trading days",)),
    Metric("brent_vol_7d", _MK, "Standard deviation of the last seven one-row changes", "%", "derived", "daily"),
    Metric("spread_chg_7d", _MK, "Change of the spread over seven panel rows", "USD/bbl", "derived", "daily"),
    Metric("spread_z", _MK, "Spread against its trailing 252 rows", "standard deviations", "derived", "daily"),
    Metric("spread_smooth_10d", _MK, "Mean spread of the last ten rows", "USD/bbl", "derived", "daily"),
    Metric("spread_days_gt15_30d", _MK, "Rows of the last thirty with a spread above 15", "rows", "derived", "daily"),
    Metric("sar_vessels_<port>", _SAR, "Mean objects on water of fully covered chips of the port", "objects", "radar chips", "1-6 days", caveats=("partial chips are dropped",), forbidden=("number of ships",)),
    Metric("text_chokepoint_top10", _TX, "Mean contrastive score of the day's ten most disruption-like texts", "cosine difference", "headlines", "daily", forbidden=("probability",)),
    Metric("text_share_above_0", _TX, "Share of texts more like disruption than like calm", "share", "headlines", "daily"),
    Metric("slug_chokepoint_top10", _TX, "The same over URL words", "cosine difference", "event feed", "daily"),
    Metric("rank_<arm>", _FU, "Causal percentile rank of the arm's score", "share", "derived", "daily"),
    Metric("arms_available", _FU, "Arms with a rank on the day", "arms", "derived", "daily"),
    Metric("weight_available", _FU, "Declared weight of these arms", "weight", "derived", "daily"),
    Metric("risk_index", _FU, "Weighted mean of the arms' ranks, times 100", "0..100", "derived", "daily", caveats=("null below half the declared weight",), forbidden=("probability of closure", "forecast price")),
)

_SCHEMA = "name string, arm string, definition string, unit string, source string, cadence string, official boolean, caveats array<string>, forbidden array<string>"


def metrics(spark: SparkSession, arm: str | None = None) -> DataFrame:
    """The registry, of one arm or all."""
    rows = [(m.name, m.arm, m.definition, m.unit, m.source, m.cadence, m.official, list(m.caveats), list(m.forbidden)) for m in METRICS if arm in (None, m.arm)]
    return spark.createDataFrame(rows, _SCHEMA)


def metric(spark: SparkSession, name: str) -> DataFrame:
    """The metric of a column, templates included; KeyError if none."""
    key = resolve(name)
    if key is None:
        raise KeyError(name)
    return metrics(spark).filter(F.col("name") == key)


def resolve(name: str) -> str | None:
    """The registry name of a column: itself, or the template whose fixed part it starts with."""
    for m in METRICS:
        if m.name == name:
            return name
    for m in METRICS:
        stem, mark, _ = m.name.partition("<")
        if mark and name.startswith(stem) and len(name) > len(stem):
            return m.name
    return None


def resolved(column: Column) -> Column:
    """The same as an expression."""
    exact = F.when(column.isin([m.name for m in METRICS if "<" not in m.name]), column)
    stems = [F.when(F.startswith(column, F.lit(m.name.partition("<")[0])) & (F.length(column) > len(m.name.partition("<")[0])), F.lit(m.name)) for m in METRICS if "<" in m.name]
    return F.coalesce(exact, *stems)


def forbidden(spark: SparkSession) -> DataFrame:
    """(name, statement) of all prohibitions."""
    return metrics(spark).select("name", F.explode("forbidden").alias("statement"))


def audit(spark: SparkSession, columns: list[str]) -> DataFrame:
    """(column, metric, defined) of published columns."""
    c = spark.createDataFrame([(x,) for x in columns], "column string")
    return c.withColumn("metric", resolved(F.col("column"))).withColumn("defined", F.col("metric").isNotNull())


def describe(spark: SparkSession) -> DataFrame:
    """(name, text): one line of each metric."""
    m = metrics(spark)
    return m.select("name", F.concat(F.concat_ws(": ", "name", "definition"), F.lit(" ["), F.col("unit"), F.lit("]")).alias("text"))
