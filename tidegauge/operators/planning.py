"""Planning of acquisitions: catalogues, pass days, cost, budgets, resuming, and checks of declared boxes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.intervals import Calendar


def catalogue(scenes: DataFrame, key: str = "id", at: str = "acquired") -> DataFrame:
    """Scenes of overlapping searches, each once (the latest listing), newest first."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*scenes.columns))
    return scenes.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").orderBy(F.col(at).desc(), key)


def search_chunks(cal: Calendar, days: int = 45) -> list[tuple[str, Any, Any]]:
    """(name, from, to): declared windows cut into searches of at most ``days``."""
    out = []
    for p in cal:
        a = p.start
        while a <= p.end:
            b = min(p.end, a + timedelta(days=days - 1))
            out.append((p.name, a, b))
            a = b + timedelta(days=1)
    return out


def pass_days(scenes: DataFrame, port: str = "port", at: str = "acquired") -> DataFrame:
    """(port, day) of the passes, distinct."""
    return scenes.filter(F.col(at).isNotNull()).select(port, F.to_date(at).alias("day")).distinct()


def plan(scenes: DataFrame, cal: Calendar, port: str = "port", at: str = "acquired", key: str = "id") -> DataFrame:
    """(window, port, day, id, acquired): the first pass of each port and day within each window."""
    day = F.to_date(at)
    every = F.array(*(F.when(day.between(F.lit(p.start), F.lit(p.end)), F.lit(p.name)) for p in cal))
    d = scenes.withColumns({"day": day, "window": F.explode(F.filter(every, lambda x: x.isNotNull()))})
    w = Window.partitionBy("window", port, "day").orderBy(at, key)
    return d.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("window", port, "day", key, at)


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def cost(planned: DataFrame, stored: DataFrame, keys: Sequence[str], unit: float) -> DataFrame:
    """One row (planned, missing, cost): units for what isn't stored yet."""
    left = resume(planned, stored, keys).agg(F.count(F.lit(1)).alias("missing"))
    n = planned.agg(F.count(F.lit(1)).alias("planned"))
    return n.withColumn("k", F.lit(0)).join(left.withColumn("k", F.lit(0)), "k").select("planned", "missing", (F.col("missing") * unit).alias("cost"))


def chip_cost(side_px: int) -> float:
    """Processing units of a square chip of two bands: one unit covers 512 by 512 pixels of three 16-bit bands; floats count twice."""
    return side_px * side_px / (512 * 512) * (2 / 3) * 2 * 2.5


def with_detections(chips: DataFrame, detections: DataFrame, order: str, keys: Sequence[str] = ("port", "date")) -> DataFrame:
    """Chips with their detection record; of several records of a chip the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    last = detections.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return chips.join(last, list(keys), "left")


def window_coverage(panel: DataFrame, cal: Calendar, columns: Sequence[str], date: str = "date") -> DataFrame:
    """(window, days, covered): calendar days of each window and those on which any of the columns has a value."""
    seen = F.coalesce(*(F.col(c).cast("double") for c in columns)).isNotNull()
    aggs = [F.struct(F.lit(p.name).alias("window"), F.lit((p.end - p.start).days + 1).alias("days"), F.count_if(seen & F.col(date).between(F.lit(p.start), F.lit(p.end))).alias("covered")).alias(f"w{i}") for i, p in enumerate(cal)]
    one = panel.agg(*aggs)
    return one.select(F.explode(F.array(*(F.col(f"w{i}") for i in range(len(cal))))).alias("w")).select("w.*")


def checked_boxes(value: Any) -> list[list[list[float]]]:
    """Boxes [[[lat, lon], [lat, lon]], ...] as a subscription wants them. One box without the outer list is wrapped; other
    depths, wrong lengths and coordinates out of range raise ValueError."""

    def depth(x: Any) -> int:
        return 1 + depth(x[0]) if isinstance(x, (list, tuple)) and x else 0

    boxes = [value] if depth(value) == 2 else value
    if depth(boxes) != 3:
        raise ValueError("boxes are lists of two corners [lat, lon]")
    for b in boxes:
        if len(b) != 2 or any(len(c) != 2 for c in b):
            raise ValueError("a box has two corners of two coordinates")
        for lat, lon in b:
            if not (-90 <= lat <= 90 and -180 <= lon <= 180):
                raise ValueError(f"({lat}, {lon}) is no position")
    return [[list(map(float, c)) for c in b] for b in boxes]
