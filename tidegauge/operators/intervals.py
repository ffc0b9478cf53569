"""Interval calendars, buffered membership, look-back joins, embargoed splits and the event backtest.

Calendars are short lists of declared periods. Membership of a day is a predicate over their literals, so no join is planned at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    name: str
    start: date
    end: date


Calendar = tuple[Period, ...]


def period(name: str, start: str, end: str | None = None) -> Period:
    return Period(name, date.fromisoformat(start), date.fromisoformat(end or start))


def frame(spark: SparkSession, cal: Calendar) -> DataFrame:
    """(name, start, end) of a calendar."""
    return spark.createDataFrame([(p.name, p.start, p.end) for p in cal], "name string, start date, end date")


def inside(day: Column, cal: Calendar, buffer: int = 0) -> Column:
    """Whether the day is within ``buffer`` days of any period, ends included."""
    d = timedelta(days=buffer)
    return reduce(lambda a, p: a | day.between(F.lit(p.start - d), F.lit(p.end + d)), cal, F.lit(False))


def overlapping(cal: Calendar, start: date, end: date) -> list[str]:
    return [p.name for p in cal if p.end >= start and p.start <= end]


def lookback(df: DataFrame, cal: Calendar, days: int, day: str = "date") -> DataFrame:
    """``df`` rows of the ``days`` before each period's start (that day included), with ``event`` and ``onset``.

    Each row is tagged with the events whose look-back holds it: a literal array and a generator, not a join.
    """
    one = lambda p: F.when(F.col(day).between(F.lit(p.start - timedelta(days=days)), F.lit(p.start)), F.struct(F.lit(p.name).alias("event"), F.lit(p.start).alias("onset")))
    tags = F.filter(F.array(*(one(p) for p in cal)), lambda x: x.isNotNull())
    d = df.withColumn("__t", F.explode(tags))
    return d.select(*df.columns, "__t.event", "__t.onset")


def lead_times(df: DataFrame, cal: Calendar, value: str, threshold: Column, days: int = 60, day: str = "date") -> DataFrame:
    """(event, onset, n_days, peak, first_cross, lead_days, detected) of a daily score before each event."""
    d = lookback(df.filter(F.col(value).isNotNull()), cal, days, day)
    hit = F.when(F.col(value) > threshold, F.col(day))
    g = d.groupBy("event", "onset").agg(F.count(F.lit(1)).alias("n_days"), F.max(value).alias("peak"), F.min(hit).alias("first_cross"))
    return g.withColumns({"lead_days": F.datediff("onset", "first_cross"), "detected": F.col("first_cross").isNotNull()})


def contaminated(df: DataFrame, cal: Calendar, n: int = 20, buffer: int = 60, day: str = "date") -> DataFrame:
    """(date, contaminated): for windows of n rows, whether any of their days is near a period."""
    w = Window.partitionBy(F.lit(0)).orderBy(day).rowsBetween(-(n - 1), 0)
    d = df.select(day, inside(F.col(day), cal, buffer).alias("f"))
    d = d.select(day, F.max("f").over(w).alias("contaminated"), F.count(F.lit(1)).over(w).alias("k"))
    return d.filter(F.col("k") == n).drop("k")


def expanding_folds(df: DataFrame, n_splits: int = 5, embargo: int = 10, least: int = 180, day: str = "date") -> DataFrame:
    """(fold, train_start, train_end, train_days, embargo_end, test_start, test_end, test_days): expanding windows.

    Fold i trains on the first ``least + i * size`` days with size = (n - least) // n_splits; days beyond the last whole fold are not
    used. Test days within the embargo after the training end are left out, folds without test days are dropped. Raises
    ValueError when there are too few days.
    """
    d = df.select(day).distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)))
    n = d.count()  # days of one panel
    if n < least + n_splits:
        raise ValueError(f"{n} days are too few for {n_splits} splits")
    size = (n - least) // n_splits
    folds = F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(least + i * size).alias("cut")) for i in range(n_splits)))
    j = d.select(day, "pos", F.inline(folds))
    train = F.col("pos") <= F.col("cut")
    ends = j.groupBy("fold", "cut").agg(F.min(day).alias("train_start"), F.max(F.when(train, F.col(day))).alias("train_end"), F.count_if(train).alias("train_days"))
    ends = ends.withColumn("embargo_end", F.date_add("train_end", embargo))
    t = j.join(F.broadcast(ends.select("fold", "embargo_end")), "fold").filter((F.col(day) > F.col("embargo_end")) & (F.col("pos") <= F.col("cut") + size))
    t = t.groupBy("fold").agg(F.min(day).alias("test_start"), F.max(day).alias("test_end"), F.count(F.lit(1)).alias("test_days"))
    return ends.drop("cut").join(t, "fold")


def leave_one_event_out(df: DataFrame, cal: Calendar, embargo: int = 10, lead: int = 60, causal: bool = True, least: int = 365, day: str = "date") -> DataFrame:
    """(event, onset, train_start, train_end, train_days, test_start, test_end, test_days, scoreable, reason) of each event.

    The test window runs from ``lead`` days before the onset to the event's end. Training days lie more than ``embargo`` days
    before it; with ``causal=False`` also more than that after it. One aggregation over the days, whatever the number of events.
    """
    d = df.select(day).distinct()
    aggs = []
    for i, p in enumerate(cal):
        lo, hi = p.start - timedelta(days=lead), p.end
        test = F.col(day).between(F.lit(lo), F.lit(hi))
        train = F.col(day) < F.lit(lo - timedelta(days=embargo))
        if not causal:
            train = train | (F.col(day) > F.lit(hi + timedelta(days=embargo)))
        on = lambda c, x=day: F.when(c, F.col(x))
        aggs += [F.struct(
            F.lit(p.name).alias("event"), F.lit(p.start).alias("onset"), F.min(on(train)).alias("train_start"), F.max(on(train)).alias("train_end"),
            F.count_if(train).alias("train_days"), F.min(on(test)).alias("test_start"), F.max(on(test)).alias("test_end"), F.count_if(test).alias("test_days"),
        ).alias(f"e{i}")]
    one = d.agg(*aggs)
    out = one.select(F.explode(F.array(*(F.col(f"e{i}") for i in range(len(cal))))).alias("e")).select("e.*")
    reason = F.when(F.col("test_days") == 0, "no coverage").when(F.col("train_days") < least, "too little history")
    return out.withColumn("reason", reason).withColumn("scoreable", F.col("reason").isNull())


def audit_loeo(folds: DataFrame, cal: Calendar, embargo: int = 10) -> DataFrame:
    """(event, problem): scoreable folds whose event is in their training period or whose embargo is not kept."""
    f = folds.filter("scoreable")
    ends = F.create_map(*(x for p in cal for x in (F.lit(p.name), F.struct(F.lit(p.start).alias("s"), F.lit(p.end).alias("e")))))
    own = ends[F.col("event")]
    leak = F.when((own["e"] >= F.col("train_start")) & (own["s"] <= F.col("train_end")), "event in training")
    gap = F.when(F.datediff("test_start", "train_end") < embargo, "embargo broken")
    late = F.when(F.col("train_end") >= F.col("test_start"), "training after the test")
    return f.select("event", F.explode(F.filter(F.array(leak, gap, late), lambda x: x.isNotNull())).alias("problem"))


def audit_folds(folds: DataFrame, cal: Calendar, embargo: int = 10) -> DataFrame:
    """(fold, train_events, test_events, straddling, problems) of expanding folds."""
    def within(lo: str, hi: str) -> Column:
        every = F.array(*(F.when((F.lit(p.end) >= F.col(lo)) & (F.lit(p.start) <= F.col(hi)), F.lit(p.name)) for p in cal))
        return F.filter(every, lambda x: x.isNotNull())

    d = folds.withColumns({"train_events": within("train_start", "train_end"), "test_events": within("test_start", "test_end")})
    d = d.withColumn("straddling", F.array_intersect("train_events", "test_events"))
    problems = F.array(
        F.when(F.size("straddling") > 0, "event spans the border"),
        F.when(F.col("train_end") >= F.col("test_start"), "train overlaps test"),
        F.when(F.datediff("test_start", "train_end") < embargo, "embargo broken"),
        F.when(F.size("test_events") == 0, "no event in test"),
    )
    return d.select("fold", "train_events", "test_events", "straddling", F.filter(problems, lambda x: x.isNotNull()).alias("problems"))


def quiet_threshold(df: DataFrame, cal: Calendar, value: str, share: float = 0.9, buffer: int = 30, day: str = "date") -> DataFrame:
    """(threshold, n_quiet): exact percentile of the value on days away from every period. One row."""
    q = df.filter(F.col(value).isNotNull() & ~inside(F.col(day), cal, buffer))
    return q.agg(F.percentile(value, F.lit(share)).alias("threshold"), F.count(F.lit(1)).alias("n_quiet"))


def backtest(df: DataFrame, cal: Calendar, value: str, share: float = 0.9, lead: int = 60, least: int = 120, quiet_least: int = 50, scope: str = "all", day: str = "date") -> DataFrame:
    """(event, onset, status, threshold, peak, n_days, first_cross, lead_days, detected): causal leave-one-event-out.

    The threshold is the percentile of quiet days: ``scope='all'`` over the whole series, ``scope='past'`` only days before each
    event's look-back. Events without enough earlier days are unscoreable, not missed.
    """
    d = df.filter(F.col(value).isNotNull()).select(day, value)
    folds = leave_one_event_out(d, cal, lead=lead, least=least, day=day).select("event", "onset", "scoreable", "reason")
    if scope == "all":
        one = quiet_threshold(d, cal, value, share, day=day)
        thr = one.select(F.explode(F.array(*(F.lit(p.name) for p in cal))).alias("event"), "threshold", "n_quiet")
    else:
        quiet = ~inside(F.col(day), cal, 30)
        each = []
        for i, p in enumerate(cal):
            v = F.when(quiet & (F.col(day) < F.lit(p.start - timedelta(days=lead))), F.col(value))
            each.append(F.struct(F.lit(p.name).alias("event"), F.percentile(v, F.lit(share)).alias("threshold"), F.count(v).alias("n_quiet")).alias(f"t{i}"))
        one = d.agg(*each)
        thr = one.select(F.explode(F.array(*(F.col(f"t{i}") for i in range(len(cal))))).alias("t")).select("t.*")
    pre = lookback(d, cal, lead, day).drop("onset").join(F.broadcast(thr.select("event", "threshold")), "event")
    hit = F.when(F.col(value) > F.col("threshold"), F.col(day))
    got = pre.groupBy("event").agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n_days"), F.min(hit).alias("first_cross"))
    j = folds.join(thr, "event").join(got, "event", "left")
    status = (
        F.when(~F.col("scoreable"), F.lit("unscoreable")).when(F.col("n_quiet") < quiet_least, "too few quiet days")
        .when(F.col("n_days").isNull(), "no coverage").when(F.col("first_cross").isNotNull(), "detected").otherwise("missed")
    )
    ok = status.isin("detected", "missed")
    show = lambda c: F.when(ok, F.col(c)).alias(c)
    return j.select(
        "event", "onset", status.alias("status"), show("threshold"), show("peak"), show("n_days"), show("first_cross"),
        F.when(ok, F.datediff("onset", "first_cross")).alias("lead_days"), F.when(ok, F.col("first_cross").isNotNull()).alias("detected"),
    )
