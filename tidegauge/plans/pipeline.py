"""The stages of :mod:`tidegauge.plans.dag` bound to the operators that write their tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import events as ev
from tidegauge.operators import fusion, intervals, market_model, raster, text_features
from tidegauge.plans import core_queries as q
from tidegauge.plans import dag
from tidegauge.session import table
from tidegauge.sources import files


class Gate(RuntimeError):
    """A check that must hold before later stages run."""


def _must_be_empty(df: DataFrame, what: str) -> DataFrame:
    bad = df.count()
    if bad:
        raise Gate(f"{bad} rows of {what}")
    return df


def bound(spark: SparkSession, d: str, out: str) -> tuple[dag.Stage, ...]:
    """The stages over the tables in ``d``; each writes the table of its name under ``out``, replacing it as a whole.

    Gates raise :class:`Gate` where the panel leaks or a fold trains on its event; what depends on them then doesn't run.
    """
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    spread = lambda: read("panel").select("date", "brent", "wti", F.col("brent_wti_spread").alias("spread"))

    def risk() -> DataFrame:
        b = read("market_scores").select("date", F.col("recon_error").alias("arm_b"))
        c = read("slugs").select("date", F.col("top10").alias("arm_c"))
        return fusion.risk_index(b.join(c, "date", "full").withColumn("arm_a", F.lit(None).cast("double")))

    tables: dict[str, Callable[[], DataFrame]] = {
        "events": lambda: ev.daily_features(table(spark, d, "event_rows")),
        "market": lambda: q.wide(spark, d),
        "chips": lambda: q.chips(spark, d),
        "detections": lambda: raster.detect(read("chips"), k=2.0),
        "slugs": lambda: text_features.slug_features(table(spark, d, "event_rows")),
        "panel": lambda: fusion.panel(fusion.market_features(read("market")), read("events")),
        "leakage": lambda: _must_be_empty(fusion.leakage(read("panel")), "leakage"),
        "market_scores": lambda: market_model.scores(spread(), ["brent", "wti", "spread"], q.CAL, q.OTHER, buffer=20),
        "evaluation": lambda: market_model.evaluation(read("market_scores")),
        "folds": lambda: _must_be_empty(intervals.audit_loeo(intervals.leave_one_event_out(read("panel"), q.CAL, least=120), q.CAL), "training on events"),
        "risk": risk,
        "backtest": lambda: intervals.backtest(read("risk"), q.CAL, "risk_index"),
    }

    def writer(name: str) -> Callable[[], None]:
        return lambda: tables[name]().write.mode("overwrite").parquet(f"{out}/{name}")

    return tuple(replace(s, outputs=s.outputs or (s.name,), run=writer(s.name)) for s in dag.STAGES)


def age(spark: SparkSession, out: str) -> Callable[[str], float | None]:
    """When the table of a name was written; None if it wasn't."""

    def written_at(name: str) -> float | None:
        fs, p = files._fs(spark, f"{out}/{name}/_SUCCESS")
        return fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None

    return written_at


def run(spark: SparkSession, d: str, out: str, only: list[str] | None = None, force: bool = False) -> list[tuple[str, str]]:
    """Run what is missing or stale, in order; (stage, what happened). Without ``only`` all stages are named, the manual ones too."""
    stages, at = bound(spark, d, out), age(spark, out)
    return dag.run(stages, at, at, only or [s.name for s in stages], force)
