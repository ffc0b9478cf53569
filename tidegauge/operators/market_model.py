"""A sequence anomaly score for the market panel: reconstruction error of windows, trained on windows without declared events.

The contract is that of a variational sequence model: windows of 20 complete rows labelled by their last day; a window is
contaminated if any of its days is near an event or in a declared shock; scaler, model and thresholds come from clean windows only;
scores are deterministic; without clean windows they are null. The default scorer is a linear autoencoder (principal components); any function of windows may take
its place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import aggregates, intervals
from tidegauge.operators import timeseries as ts
from tidegauge.session import written


def windows(df: DataFrame, columns: list[str], cal: intervals.Calendar, buffer: int = 60, other: intervals.Calendar = (), n: int = 20) -> DataFrame:
    """(date, window, near_event, declared_other, clean) of complete rows."""
    d = df.dropna(subset=columns)
    day = F.col("date")
    d = d.withColumns({"__e": intervals.inside(day, cal, buffer), "__o": intervals.inside(day, other)})
    f = ts.ordered().rowsBetween(-(n - 1), 0)
    w = d.withColumns({
        "window": F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(f),
        "near_event": F.max("__e").over(f), "declared_other": F.max("__o").over(f), "__n": F.count(F.lit(1)).over(f),
    }).filter(F.col("__n") == n)
    return w.select("date", "window", "near_event", "declared_other", (~F.col("near_event") & ~F.col("declared_other")).alias("clean"))


def training_rows(df: DataFrame, columns: list[str], cal: intervals.Calendar, buffer: int = 60, other: intervals.Calendar = (), n: int = 20) -> DataFrame:
    """The rows of the clean windows; a row of several windows counts in each."""
    w = windows(df, columns, cal, buffer, other, n).filter("clean")
    x = w.select(F.explode("window").alias("x"))
    return x.select(*(F.col("x")[i].alias(c) for i, c in enumerate(columns)))


def scores(
    df: DataFrame, columns: list[str], cal: intervals.Calendar, other: intervals.Calendar = (), buffer: int = 60, n: int = 20, k: int = 8,
    scorer: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(date, recon_error, near_event, declared_other, clean, p95, p99): error of every window, thresholds from clean ones.

    ``scorer(windows, clean)`` may replace the linear model: arrays (m, n, columns) of all windows and flags to errors.
    """
    w = windows(df, columns, cal, buffer, other, n)
    if w.filter("clean").isEmpty():  # nothing to learn what is normal from
        none = F.lit(None).cast("double")
        return w.select("date", none.alias("recon_error"), "near_event", "declared_other", "clean", none.alias("p95"), none.alias("p99"))
    if scorer is not None:
        pdf = w.toPandas()  # one row a trading day of one panel
        e = scorer(np.array(pdf["window"].tolist()), pdf["clean"].to_numpy())
        out = w.sparkSession.createDataFrame(pd.DataFrame({"date": pdf["date"], "recon_error": e}), "date date, recon_error double").join(w.drop("window"), "date")
    else:
        stats = training_rows(df, columns, cal, buffer, other, n).agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).first()
        mean = [stats[c]["m"] or 0.0 for c in columns]
        std = [s if (s := stats[c]["s"] or 0.0) >= 1e-8 else 1.0 for c in columns]
        row = lambda x: F.array(*((x[i] - mean[i]) / std[i] for i in range(len(columns))))
        z = w.withColumn("z", F.flatten(F.transform("window", row))).withColumn("v", array_to_vector("z"))
        model = PCA(k=min(k, n * len(columns)), inputCol="v", outputCol="c").fit(z.filter("clean"))
        comp = model.pc.toArray()  # (n * columns, k)
        parts = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in comp))
        z = model.transform(z).withColumn("c", vector_to_array("c"))
        back = F.transform(parts, lambda r: F.aggregate(F.zip_with(r, F.col("c"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        err = F.aggregate(F.zip_with("z", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("z")
        out = z.select("date", err.alias("recon_error"), "near_event", "declared_other", "clean")
    # written: a window's length is checked before the model sees it, which a plan of one piece doesn't promise
    return with_thresholds(written(out, "scores"))


def with_thresholds(s: DataFrame) -> DataFrame:
    """``s`` with ``p95`` and ``p99`` of the errors of its clean windows."""
    t = s.filter("clean").agg(F.percentile("recon_error", F.lit(0.95)).alias("p95"), F.percentile("recon_error", F.lit(0.99)).alias("p99")).first()
    return s.withColumns({"p95": F.lit(t["p95"]).cast("double"), "p99": F.lit(t["p99"]).cast("double")})


def evaluation(s: DataFrame) -> DataFrame:
    """One row: how a score tells event windows from calm ones (medians, shares above p95, the area under the curve of event against calm),
    whether declared other shocks fire, and the windows above p99 that are neither (false positives)."""
    e = F.col("recon_error")
    m = lambda c: F.median(F.when(c, e))
    share = lambda c: F.avg(F.when(c, (e > F.col("p95")).cast("double"))) * 100
    clean, near, other = F.col("clean"), F.col("near_event"), F.col("declared_other")
    false = (e > F.col("p99")) & ~near & ~other
    both = s.filter(clean | near)
    area = aggregates.auc(both, "recon_error", F.col("near_event")).select(F.col("auc").alias("auc_event_vs_calm"))
    one = s.agg(
        m(clean).alias("calm_median"), m(near).alias("event_median"), m(other).alias("other_median"), share(clean).alias("calm_pct_above_p95"), share(near).alias("event_pct_above_p95"), share(other).alias("other_pct_above_p95"),
        F.count_if(false).alias("false_positives"), (100 * F.try_divide(F.count_if(false).cast("double"), F.count(F.lit(1)).cast("double"))).alias("false_positive_pct"),
        F.coalesce(F.bool_or(F.when(other, e > F.col("p99"))), F.lit(False)).alias("other_fires"),
    )
    return one.withColumn("__k", F.lit(0)).join(area.withColumn("__k", F.lit(0)), "__k", "left").drop("__k")


def lead_report(s: DataFrame, cal: intervals.Calendar, days: int = 60) -> DataFrame:
    """(event, onset, threshold, n_days, peak, first_cross, lead_days, detected) for ``p95`` and ``p99``: the first crossing in the ``days`` before an onset.

    A crossing after the onset is no warning. An event without scores in its look-back has ``n_days`` 0 and is neither detected nor missed.
    """
    limits = F.array(*(F.struct(F.lit(k).alias("threshold"), F.col(k).alias("limit")) for k in ("p95", "p99")))
    pre = intervals.lookback(s, cal, days).withColumn("t", F.explode(limits)).select("event", "date", "recon_error", "t.*")
    hit = F.when(F.col("recon_error") > F.col("limit"), F.col("date"))
    g = pre.groupBy("event", "threshold").agg(F.count("recon_error").alias("n_days"), F.max("recon_error").alias("peak"), F.min(hit).alias("first_cross"))
    every = intervals.frame(s.sparkSession, cal).select(F.col("name").alias("event"), F.col("start").alias("onset"), F.explode(F.array(F.lit("p95"), F.lit("p99"))).alias("threshold"))
    out = every.join(g, ["event", "threshold"], "left").withColumn("n_days", F.coalesce("n_days", F.lit(0)))
    return out.select("event", "onset", "threshold", "n_days", "peak", "first_cross", F.datediff("onset", "first_cross").alias("lead_days"), F.when(F.col("n_days") > 0, F.col("first_cross").isNotNull()).alias("detected"))
