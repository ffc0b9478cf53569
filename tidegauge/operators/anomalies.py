"""Implausible readings: spikes, stuck values and physically impossible readings, per source.

Method: a local-level Kalman filter runs over the readings of each source. Where its standardised innovations exceed a threshold a
spike may begin or end; such updates are withheld so that a spike doesn't become the new normal; after ``hold`` withheld
readings in a row the level is taken anew (a real change of level). Where the variance of the innovations vanishes over half the
length of a stuck run, the sensor may be stuck. An exact check follows, of the places that the filter tells, nowhere else: blocks that begin at a
flagged reading, or at the one after it, must be a spike by the rule of their field; a stuck run must hold equal readings, and enough of them.

No case is missed: the first reading of a true spike lies further from the reading before it than the threshold. If that one was accepted the
filter's level is within 1 % of it and the innovation stands out; if it was withheld it is flagged itself. In a stuck run the level is
taken anew after ``hold`` readings at most and then comes within a millionth of the readings in three steps.

The bounds of possible readings and of a source's own range are limits and not forecasts; they are tested directly.

Readings of all fields run through one long table. Hot sources are cut into time blocks with a halo longer than any rule
looks (operators.blocks): 64 readings, and for spikes counted in days so many whole days, however many readings those hold.
Results so don't depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.blocks import BLOCK, CORE, by_block, time_blocks, whole_groups
from tidegauge.session import broadcast_if_small, written

HALO = 64
DAY_US = 86_400_000_000
STILL = 1e-6  # innovations below it, in standard deviations, have no variance


@dataclass(frozen=True)
class Rule:
    """What is implausible for a field. ``low`` and ``high`` bound possible readings (``low_open``: low itself is impossible)."""

    tbl: str
    low: float
    high: float
    low_open: bool
    stuck: int  # successive equal readings that are too many; 0: no such rule
    stuck_from: float
    spike: int  # longest spike in readings or days; 0: no such rule
    ratio: float  # spikes differ by more than this share of their neighbours; 0: by ``times`` the source's usual change
    times: float
    by_day: bool  # spikes are counted in days with readings
    over: float  # above this multiple of the source's own 95th percentile; 0: no such rule


RULES = {
    "sog": Rule("positions", 0.0, 60.0, False, 15, 2.0, 0, 0.0, 0.0, False, 2.0),
    "draught": Rule("positions", 0.0, 25.0, True, 0, 0.0, 5, 0.4, 0.0, False, 0.0),
    "value": Rule("market_daily", 0.0, np.inf, True, 10, -np.inf, 3, 0.0, 8.0, True, 0.0),
}
FIELDS = list(RULES)


def kalman(v: np.ndarray, threshold: float, hold: int, q: float = 1.0, r: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """The standardised innovations of the readings ``v`` (in units of the usual change), and flags of those above the threshold.

    Local level: level(t) = level(t-1) + w, reading = level + e with variances q and r. Flagged updates are withheld, at most
    ``hold`` in a row; then the level starts anew at the reading (which stays flagged).
    """
    out, nus = np.zeros(len(v), dtype=bool), np.zeros(len(v))
    if not len(v):
        return nus, out
    xs = v.tolist()
    got = [0.0] * len(xs)
    level, p, held, t2 = xs[0], r, 0, threshold * threshold
    for i in range(1, len(xs)):
        p += q
        s = p + r
        nu = xs[i] - level
        got[i] = nu * nu / s
        if nu * nu > t2 * s:
            out[i] = True
            if held < hold:
                held += 1
                continue
            level, p, held = xs[i], r, 0
            continue
        k = p / s
        level += k * nu
        p *= 1 - k
        held = 0
    return np.sqrt(np.array(got)), out


def stuck_runs(v: np.ndarray, nu: np.ndarray, least: int) -> np.ndarray:
    """Readings of runs of at least ``least`` equal ones in which the variance of ``least // 2`` successive innovations vanishes."""
    out = np.zeros(len(v), dtype=bool)
    w = least // 2
    if len(v) < least:
        return out
    level = (nu > STILL).astype(np.int64)
    moved = np.r_[0, np.cumsum(level)]
    still = np.flatnonzero(moved[w:] - moved[:-w] == 0) + w - 1  # the last reading of each window without variance
    if not len(still):
        return out
    cut = np.r_[0, np.flatnonzero(np.diff(v) != 0) + 1, len(v)]
    own = np.unique(np.searchsorted(cut, still, side="right") - 1)
    for a, b in zip(cut[own].tolist(), cut[own + 1].tolist()):
        if b - a >= least:
            out[a:b] = True
    return out


def spikes(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, longest: int, up, down) -> np.ndarray:
    """Steps (readings or days) in blocks of at most ``longest``, beginning at one of the steps ``at``, that lie to one side of the step before and after.

    ``lo`` and ``hi`` are the extremes of a step, ``first`` and ``last`` its first and last reading. ``up(x, ref)`` tells
    whether x is implausibly above ref, ``down`` below.
    """
    n = len(lo)
    out = np.zeros(n, dtype=bool)
    for k in range(1, longest + 1):
        a = at[(at > 0) & (at + k < n)]
        if not len(a):
            break
        low = np.min(np.stack([lo[a + j] for j in range(k)]), axis=0)
        high = np.max(np.stack([hi[a + j] for j in range(k)]), axis=0)
        before, after = last[a - 1], first[a + k]
        hit = a[(up(low, before) & up(low, after)) | (down(high, before) & down(high, after))]
        for j in range(k):
            out[hit + j] = True
    return out


def implausible(rule: Rule, ts: np.ndarray, v: np.ndarray, limit: float) -> np.ndarray:
    """Reason codes (0: plausible, 1: impossible, 2: above the source's own, 3: stuck, 4: spike) of ordered readings."""
    code = np.zeros(len(v), dtype=np.int8)
    if rule.spike and len(v):
        if rule.by_day:
            step = ts // DAY_US
        else:  # copies of a ping count once
            step = np.r_[0, np.cumsum((np.diff(ts) != 0) | (np.diff(v) != 0))]
        cut = np.r_[0, np.flatnonzero(np.diff(step)) + 1]
        end = np.r_[cut[1:], len(v)]
        lo, hi, first, last = np.minimum.reduceat(v, cut), np.maximum.reduceat(v, cut), v[cut], v[end - 1]
        if rule.ratio:
            unit = np.log(np.maximum(last, 1e-3)) / np.log1p(rule.ratio)
            up, down = (lambda x, r: (x - r) > rule.ratio * np.abs(r)), (lambda x, r: (r - x) > rule.ratio * np.abs(r))
        else:
            far = rule.times * limit
            unit = last / max(far, 1e-12)
            up, down = (lambda x, r: x - r > far), (lambda x, r: r - x > far)
        if rule.ratio or np.isfinite(limit):
            _, flagged = kalman(unit, 0.8, rule.spike)
            starts = np.flatnonzero(flagged | np.r_[False, flagged[:-1]])
            if len(starts):
                code[np.repeat(spikes(starts, lo, hi, first, last, rule.spike, up, down), end - cut)] = 4
    if rule.stuck and len(v):
        nu, _ = kalman(v / (np.median(np.abs(v)) or 1.0), 0.8, 0)
        code[stuck_runs(v, nu, rule.stuck) & (v >= rule.stuck_from)] = 3
    if rule.over and np.isfinite(limit):
        code[v > rule.over * limit] = 2
    code[(v < rule.low) | (v > rule.high) | ((v == rule.low) & rule.low_open)] = 1
    return code


def readings(positions: DataFrame, market: DataFrame) -> DataFrame:
    """(field, src, ts, id, v) of all readings: ``field`` numbers ``FIELDS``; null and NaN values are no readings."""
    f = lambda n, c: F.struct(F.lit(n).cast("byte").alias("field"), F.col(c).cast("double").alias("v"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp"))
    p = positions.select(F.col("mmsi").alias("src"), micros("ts_utc").alias("ts"), F.col("msg_id").alias("id"), F.explode(F.array(f(0, "sog"), f(1, "draught"))).alias("r"))
    m = market.select(F.col("series_id").alias("src"), micros("date").alias("ts"), F.col("obs_id").alias("id"), f(2, "value").alias("r"))
    d = p.unionAll(m).select("r.field", "src", "ts", "id", "r.v")
    return d.filter(F.col("v").isNotNull() & ~F.isnan("v") & F.col("src").isNotNull() & F.col("ts").isNotNull())


def limits(positions: DataFrame, market: DataFrame) -> DataFrame:
    """(field, src, lim): what is normal for a source, over all its readings. sog: the 95th percentile of those from 2 to 60;
    value: the median absolute change between successive days with readings. Both from pre-aggregated tables."""
    speed = positions.filter("mmsi is not null and sog between 2 and 60").groupBy("mmsi", "sog").agg(F.count(F.lit(1)).alias("n"))
    s = speed.groupBy(F.col("mmsi").alias("src")).agg(F.percentile("sog", F.lit(0.95), F.col("n")).alias("lim"))
    ok = market.filter("series_id is not null and date is not null and value is not null and not isnan(value)")
    best = F.max(F.struct("date", "obs_id", "value"))
    day = ok.groupBy(F.col("series_id").alias("src"), F.to_date("date").alias("day")).agg(best["value"].alias("v"))
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("src").orderBy("day")))
    c = day.withColumn("step", step).groupBy("src").agg(F.percentile("step", F.lit(0.5)).alias("lim"))
    return s.select(F.lit(0).cast("byte").alias("field"), "src", "lim").unionAll(c.select(F.lit(2).cast("byte").alias("field"), "src", "lim"))


REASONS = {1: "impossible", 2: "above_own_range", 3: "stuck", 4: "spike"}


def flag(positions: DataFrame, market: DataFrame, rows_per_block: int = 50_000) -> DataFrame:
    """(tbl, field, row_id, reason): every implausible reading, copies included, with the first reason that holds.

    Order is by time, then id. Null and NaN are no readings; sources or times that are null have no order and are never
    flagged. A source with fewer than two days of readings has no usual change and no spikes of ``value``. Empty tables
    give no rows; extra columns are ignored.
    """
    lim = broadcast_if_small(written(limits(positions, market), "limits"))
    d = readings(positions, market).join(lim, ["field", "src"], "left")
    keys = ["field", "src"]
    days = [r.spike + 2 if r.by_day else 0 for r in RULES.values()]
    halo_days = F.element_at(F.array(*map(F.lit, days)), F.col("field") + 1)
    blocks = time_blocks(d, keys, F.floor(F.col("ts") / DAY_US), rows_per_block, HALO, halo_days, max(days))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, off in whole_groups(batches, [*keys, BLOCK]):
            field, ts, ids, v = (t.column(c).to_numpy() for c in ("field", "ts", "id", "v"))
            lim_, core = t.column("lim").to_numpy(zero_copy_only=False).astype(float), t.column(CORE).to_numpy(zero_copy_only=False)
            code = np.zeros(len(v), dtype=np.int8)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                code[a:b] = implausible(RULES[FIELDS[field[a]]], ts[a:b], v[a:b], lim_[a])
            at = np.flatnonzero((code > 0) & core)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(field[at], pa.int8()), pa.array(ids[at], pa.int64()), pa.array(code[at], pa.int8())], names=["f", "row_id", "code"])

    out = by_block(blocks, keys, ["ts", "id"]).mapInArrow(run, "f byte, row_id long, code byte")
    name = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), F.col("f") + 1)
    reason = F.element_at(F.array(*(F.lit(REASONS[i]) for i in sorted(REASONS))), F.col("code").cast("int"))
    return out.select(name([RULES[f].tbl for f in FIELDS]).alias("tbl"), name(FIELDS).alias("field"), "row_id", reason.alias("reason"))


def found(positions: DataFrame, market: DataFrame) -> DataFrame:
    """(tbl, field, row_id): every implausible reading."""
    return flag(positions, market).select("tbl", "field", "row_id")
