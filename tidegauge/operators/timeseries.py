"""Time-series columns over ordered rows; missing stays missing and nothing looks ahead.

Windows count rows, not days, as the panels they serve hold one row per observation day. Every function takes ``keys``: series of one
table are windows of their own and spread over the cluster; only a single panel (already one row a day) has no key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidegauge.operators.blocks import whole_groups


def ordered(keys: Sequence[str] = (), by: str = "date") -> WindowSpec:
    """The rows of each series in order; without keys the whole table is one series (daily panels only)."""
    return Window.partitionBy(*keys).orderBy(by) if keys else Window.partitionBy(F.lit(0)).orderBy(by)


def only_where(derived: Column, source: Column) -> Column:
    """``derived`` where ``source`` was observed, else null."""
    return F.when(source.isNotNull(), derived)


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def pct_change(x: Column, n: int, w: WindowSpec) -> Column:
    """Change over n rows in percent; null without both values or over zero."""
    return (F.try_divide(x, F.lag(x, n).over(w)) - 1) * 100


def diff(x: Column, n: int, w: WindowSpec) -> Column:
    return x - F.lag(x, n).over(w)


def rolling(stat, x: Column, n: int, least: int, w: WindowSpec) -> Column:
    """``stat`` of the last n rows, null with fewer than ``least`` values among them."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(f) >= least, stat(x).over(f))


def rolling_z(x: Column, n: int, least: int, w: WindowSpec) -> Column:
    """Deviation from the trailing mean in trailing standard deviations; null where these vanish.

    Sums of the last n rows are differences of running sums, so a row costs the same whatever n is. A variance below what rounding leaves of
    them is none: pass values less a constant near them where they are large against their changes.
    """
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -n)
    trailing = lambda c: F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    count = F.count(x).over(upto) - F.count(x).over(before)
    total, squares = trailing(x), trailing(x * x)
    mean = total / count
    var = (squares - total * mean) / (count - 1)
    noise = F.lit(1e-13) * F.sum(x * x).over(upto)
    return F.when((count >= least) & (count > 1) & (var * (count - 1) > noise), (x - mean) / F.sqrt(var))


def count_above(x: Column, limit: float, n: int, least: int, w: WindowSpec) -> Column:
    """Rows of the last n with x above the limit; a missing x counts as a row that isn't."""
    return rolling(F.sum, F.when(x > limit, 1.0).otherwise(0.0), n, least, w)


def expanding_z(x: Column, least: int, w: WindowSpec) -> Column:
    """Deviation from the mean of all rows so far, in their standard deviations."""
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    enough = F.count(x).over(f) >= least
    return F.when(enough, F.try_divide(x - F.avg(x).over(f), F.stddev_samp(x).over(f)))


def forward_fill(x: Column, limit: int, w: WindowSpec) -> Column:
    """The last value at most ``limit`` rows back."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Every day from the first to the last date of ``df``; none for an empty table."""
    ends = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).filter("lo is not null")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias(date))


def densify(parts: list[DataFrame], date: str = "date") -> DataFrame:
    """Tables keyed by date side by side on one full calendar; a day that a table lacks is null there."""
    dates = parts[0].select(date)
    for p in parts[1:]:
        dates = dates.union(p.select(date))
    out = calendar(dates, date)
    for p in parts:
        out = out.join(p, date, "left")
    return out


def causal_rank(df: DataFrame, value: str, least: int = 120, keys: Sequence[str] = (), by: str = "date", out: str = "rank") -> DataFrame:
    """``df`` with ``out``: the share of a series' values so far (its own included) that are below the value.

    Null without a value and until ``least`` values were seen. One sorted list a series, n log n comparisons; series are
    streams over sorted partitions. Rows of equal ``by`` are taken in the order of their value.
    """
    own = list(keys) or ["__one"]
    d = df if keys else df.withColumn("__one", F.lit(0))
    schema = d.schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, off in whole_groups(batches, own):
            v = t.column(value).to_pylist()
            ranks: list[float | None] = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                past: list[float] = []
                for x in v[a:b]:
                    if x is None or x != x:
                        ranks.append(None)
                        continue
                    bisect.insort(past, x)
                    ranks.append(bisect.bisect_left(past, x) / len(past) if len(past) >= least else None)
            yield from t.append_column(out, pa.array(ranks, pa.float64())).combine_chunks().to_batches()

    got = d.repartition(*own).sortWithinPartitions(*own, by, value).mapInArrow(run, schema)
    return got if keys else got.drop("__one")


def sequence_windows(df: DataFrame, columns: list[str], n: int = 20, keys: Sequence[str] = (), by: str = "date") -> DataFrame:
    """(keys, by, window): the last n complete rows as an array of arrays, labelled by their last row."""
    d = df.dropna(subset=columns)
    f = ordered(keys, by).rowsBetween(-(n - 1), 0)
    d = d.withColumn("__n", F.count(F.lit(1)).over(f))
    d = d.withColumn("window", F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(f))
    return d.filter(F.col("__n") == n).select(*keys, by, "window")


def lag1_autocorrelation(df: DataFrame, value: str, least: int = 60, keys: Sequence[str] = (), by: str = "date") -> DataFrame:
    """(keys, n, autocorr, suspect): correlation of successive observed values; suspect above 0.9999. Null with fewer than
    ``least`` values or where undefined (never suspect)."""
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    d = d.withColumn("__next", F.lead(value, 1).over(ordered(keys, by)))
    both = lambda c: F.when(F.col("__next").isNotNull(), F.col(c))
    # corr itself divides by zero for constant series
    c = F.try_divide(F.covar_pop(both(value), "__next"), F.stddev_pop(both(value)) * F.stddev_pop("__next"))
    agg = [F.count(F.lit(1)).alias("n"), c.alias("c")]
    g = d.groupBy(*keys).agg(*agg)
    c = F.when(F.col("n") >= least, clean(F.col("c")))
    return g.select(*keys, "n", c.alias("autocorr"), F.coalesce(F.abs(c) > 0.9999, F.lit(False)).alias("suspect"))


def pivot_last(df: DataFrame, index: str, label: str, value: str, labels: list[str], order: list[str]) -> DataFrame:
    """One column per label: the last non-null value of each index and label in the given order."""
    good = F.col(value).isNotNull() & ~F.isnan(value)
    best = F.max_by(value, F.struct(*order))
    return df.filter(good & F.col(label).isin(labels)).groupBy(index).pivot(label, labels).agg(best)


def pandas_rank(s: pd.Series) -> pd.Series:
    """Average-tie ranks, for tests."""
    return s.rank()
