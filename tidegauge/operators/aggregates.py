"""Aggregates beyond the built-in ones; all combine before the shuffle or rank within keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n_pos, n_neg, auc): Mann-Whitney AUC with average ranks for ties; null without both classes.

    Equal scores are counted first, so ranks run over distinct scores only. Rows without a score or class are left out.
    """
    own = list(keys) or ["__one"]
    d = df.select(*keys, F.col(score).alias("s"), positive.alias("p")).filter(F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double")) & F.col("p").isNotNull())
    if not keys:
        d = d.withColumn("__one", F.lit(0))
    g = d.groupBy(*own, "s").agg(F.count_if("p").alias("np"), F.count_if(~F.col("p")).alias("nn"))
    below = F.sum("nn").over(Window.partitionBy(*own).orderBy("s")) - F.col("nn")
    u = F.col("np") * (below + F.col("nn") / 2.0)
    g = g.withColumn("u", u)
    out = g.groupBy(*own).agg(F.sum("np").alias("n_pos"), F.sum("nn").alias("n_neg"), F.sum("u").alias("u"))
    out = out.withColumn("auc", F.try_divide("u", F.col("n_pos").cast("double") * F.col("n_neg")))
    return out.select(*keys, "n_pos", "n_neg", "auc")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(cls, support, predicted, hits, precision, recall) per class of either column; null rates over nothing."""
    g = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    one = lambda c, s, p: F.struct(F.col(c).alias("cls"), s.alias("support"), p.alias("predicted"), F.lit(0).cast("long").alias("hits"))
    zero = F.lit(0).cast("long")
    first = F.struct(F.col(truth).alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("long").alias("hits"))
    d = g.select(F.explode(F.array(first, one(predicted, zero, F.col("n")))).alias("x")).select("x.*")
    out = d.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    rate = lambda c: F.try_divide(F.col("hits").cast("double"), F.col(c).cast("double"))
    return out.withColumns({"precision": rate("predicted"), "recall": rate("support")})


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """(cls, n, weight): balanced weights n / (k * n_cls)."""
    g = df.filter(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    return g.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.greatest("n", F.lit(1))).cast("double"))


def top_k_mean(df: DataFrame, keys: Sequence[str], value: str, k: int = 10, tie: str | None = None) -> DataFrame:
    """(keys, top_mean): mean of the k highest values of each key, of all where there are fewer."""
    order = [F.col(value).desc(), *([F.col(tie)] if tie else [])]
    d = df.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return d.filter(F.col("__r") <= k).groupBy(*keys).agg(F.avg(value).alias("top_mean"))


def per_group_cap(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, by: str) -> DataFrame:
    """Up to n rows of each key, chosen by the MD5 of ``by``: the same in every run and engine."""
    return per_group_cap(df.filter(F.col(by).isNotNull()), keys, n, [F.md5(F.col(by).cast("string")), F.col(by)])


def budgeted_prefix(df: DataFrame, keys: Sequence[str], cost: str, budget: float, order: Sequence[Column]) -> DataFrame:
    """The first rows of each key, in order, whose summed cost stays within the budget, with the sum so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, lo, hi, bin, n): counts in equal bins from minimum to maximum, the last one closed; one bin if all are equal."""
    own = list(keys) or ["__one"]
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    d = d if keys else d.withColumn("__one", F.lit(0))
    d = d.join(d.groupBy(*own).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), own)
    share = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    at = F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
    out = d.groupBy(*own, "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out if keys else out.drop("__one")


def otsu(hist: DataFrame, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """(keys, threshold, bin): the centre of the first bin that splits the histogram with the largest variance between classes."""
    w = Window.partitionBy(*keys)
    h = hist.withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    h = h.withColumn("p", F.col("n") / F.sum("n").over(w))
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"om": F.sum("p").over(run), "mu": F.sum(F.col("p") * F.col("c")).over(run), "mt": F.sum(F.col("p") * F.col("c")).over(w)})
    spread = F.col("om") * (1 - F.col("om"))
    h = h.withColumn("s", F.pow(F.col("mt") * F.col("om") - F.col("mu"), 2) / F.when(spread <= 1e-12, 1e-12).otherwise(spread))
    best = F.max_by(F.struct("c", "bin"), F.struct("s", -F.col("bin")))
    return h.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.c").alias("threshold"), F.col("b.bin").alias("bin"))


def coverage_report(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """(column, n, share, first_day, last_day) of the observed values of each column, in one pass."""
    one = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.try_divide(F.count(c).cast("double"), F.count(F.lit(1)).cast("double")).alias("share"), F.min(F.when(F.col(c).isNotNull(), F.col(date))).alias("first_day"), F.max(F.when(F.col(c).isNotNull(), F.col(date))).alias("last_day")).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.agg(*one).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(columns))))).alias("x")).select("x.*")


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the columns of a row that are not null."""
    have = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.size(have).cast("double"))
