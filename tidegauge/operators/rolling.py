"""Rolling totals over trailing calendar days, days without rows included.

Method: readings are first summed up per entity and day (before the shuffle, so an entity with a third of all rows costs no more
than its days); each entity's days then pass, in order, through a two-stack queue of monoid elements. The queue pushes a day at
the back, drops days that left the window at the front and always knows the combination of all it holds, with at most two
combinations a step and no inverse: minimum and maximum work like sums, and sums never drift by subtraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import root_code
from tidegauge.operators.blocks import whole_groups


class TwoStackQueue:
    """Sliding aggregate of an associative operation: push at the back, drop at the front, read the whole."""

    def __init__(self, combine: Callable[[Any, Any], Any], empty: Any):
        self.combine, self.empty = combine, empty
        self.front: list[tuple[int, Any]] = []  # (day, combination of this and all later ones of the front)
        self.back: list[tuple[int, Any]] = []
        self.back_sum = empty

    def push(self, day: int, x: Any) -> None:
        self.back.append((day, x))
        self.back_sum = self.combine(self.back_sum, x)

    def drop_before(self, day: int) -> None:
        while True:
            if not self.front:
                if not self.back or self.back[0][0] >= day:
                    return
                total = self.empty
                for d, x in reversed(self.back):
                    total = self.combine(x, total)
                    self.front.append((d, total))
                self.back, self.back_sum = [], self.empty
            if self.front[-1][0] >= day:
                return
            self.front.pop()

    def whole(self) -> Any:
        return self.combine(self.front[-1][1], self.back_sum) if self.front else self.back_sum


#: (sum, readings, minimum, maximum) and how two of them combine.
EMPTY = (0.0, 0, np.inf, -np.inf)


def combine(a: tuple, b: tuple) -> tuple:
    return (a[0] + b[0], a[1] + b[1], a[2] if a[2] < b[2] else b[2], a[3] if a[3] > b[3] else b[3])


def trailing(df: DataFrame, entity: list[str], day: Column, value: Column, days: tuple[int, ...] = (7, 30), run_out: bool = False) -> DataFrame:
    """(entity, day, n_D, sum_D, avg_D, min_D, max_D for each D of ``days``): one row per entity and calendar day, from its
    first to its last day with a reading; the window of D days ends with the day itself. With ``run_out`` an entity that falls silent
    goes on while its last reading is in a window, at most to the last day of all entities.

    A reading is a row with a day and a value that is neither null nor NaN; several of a day all count. Windows without
    a reading have n 0, sum 0 and null average, minimum and maximum. Sums are rounded to 4 decimals, averages are sum / n.
    Rows with a null entity form an entity of their own. Empty input gives no rows; extra columns are ignored.
    """
    v = value.cast("double")
    d = df.select(*entity, day.alias("day"), v.alias("v")).filter(F.col("day").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    d = d.groupBy(*entity, "day").agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    after, final = 0, None
    if run_out:
        after, final = max(days) - 1, d.agg(F.datediff(F.max("day"), F.lit("1970-01-01"))).first()[0]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*entity).schema)
    cols = "".join(f", n_{w} long, sum_{w} double, avg_{w} double, min_{w} double, max_{w} double" for w in days)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, off in whole_groups(batches, entity):
            at = t.column("day").combine_chunks().cast(pa.int32()).to_pylist()
            elements = list(zip(*(t.column(c).to_pylist() for c in ("s", "n", "lo", "hi"))))
            src: list[int] = []
            out_day: list[int] = []
            out: list[list[tuple]] = [[] for _ in days]
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                queues = [TwoStackQueue(combine, EMPTY) for _ in days]
                nxt = a
                end = at[b - 1] if final is None else min(at[b - 1] + after, final)
                for x in range(at[a], end + 1):
                    here = nxt < b and at[nxt] == x
                    for w, q, o in zip(days, queues, out):
                        q.drop_before(x - w + 1)
                        if here:
                            q.push(x, elements[nxt])
                        o.append(q.whole())
                    nxt += here
                    src.append(a)
                    out_day.append(x)
            arrays = [t.column(c).take(pa.array(src, pa.int64())).combine_chunks() for c in entity] + [pa.array(out_day, pa.int32()).cast(pa.date32())]
            for o in out:
                m = np.array(o, dtype=float).reshape(-1, 4)
                none = m[:, 1] == 0
                total = np.round(m[:, 0], 4) + 0.0
                arrays += [pa.array(m[:, 1].astype(np.int64)), pa.array(total)]
                arrays += [pa.array(x, mask=none) for x in (total / np.where(none, 1, m[:, 1]), m[:, 2], m[:, 3])]
            names = [*entity, "day", *(f"{k}_{w}" for w in days for k in ("n", "sum", "avg", "min", "max"))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return d.repartition(*entity).sortWithinPartitions(*entity, "day").mapInArrow(run, f"{kinds}, day date{cols}")


def market(df: DataFrame, run_out: bool = False) -> DataFrame:
    """Trailing 7 and 30 days of ``value`` per series."""
    return trailing(df, ["series_id"], F.to_date("date"), F.col("value"), run_out=run_out)


def events(df: DataFrame, run_out: bool = False) -> DataFrame:
    """Trailing 7 and 30 days of GoldsteinScale and AvgTone per event group: (kind, entity, measure) with kind ``root`` (codes of
    two digits) or ``country``, by day of DATEADDED. Rows without a readable day or the group's key are in no group."""
    day = F.to_date(F.try_to_timestamp("DATEADDED", F.lit("yyyyMMddHHmmss")))
    group = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("entity"))
    measure = lambda c: F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
    groups = F.array(group("root", root_code(F.col("EventRootCode"))), group("country", F.col("ActionGeo_CountryCode")))
    d = df.select(day.alias("d"), F.explode(groups).alias("g"), "GoldsteinScale", "AvgTone").filter("d is not null and g.entity is not null")
    d = d.select("d", "g", F.explode(F.array(measure("GoldsteinScale"), measure("AvgTone"))).alias("m")).select("d", "g.*", "m.*")
    return trailing(d, ["kind", "entity", "measure"], F.col("d"), F.col("value"), run_out=run_out)
