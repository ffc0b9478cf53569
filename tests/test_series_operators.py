"""Grid, rolling totals and implausible readings."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import anomalies, grid, rolling

MARKET = "obs_id long, date timestamp_ntz, value double, series_id string, day string"  # "day": a clashing extra column


def market(spark, rows):
    return spark.createDataFrame([(i, d, v, s, "x") for i, (s, d, v) in enumerate(rows)], MARKET)


def at(day, hour=0):
    return dt.datetime(2015, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_grid_marks_missing_days_and_invents_nothing(spark):
    rows = [("a", at(0, 5), 1.0), ("a", at(3), 2.0), ("a", at(3, 9), 3.0), ("a", at(40), None), ("a", at(70), 4.0), ("a", at(71), float("nan")), ("b", at(1), None), (None, at(1), 1.0), ("c", None, 1.0)]
    g = grid.daily_grid(market(spark, rows)).orderBy("day").toPandas()
    assert set(g.series_id) == {"a"} and len(g) == 71
    assert g.value.notna().sum() == 3 and g.value[3] == 3.0 and g.n_readings[3] == 2
    assert g.gap_days[69] == 66 and str(g.last_day[69]) == "2015-01-04" and not g.missing[70]
    found = {r["day"] for r in grid.found(market(spark, rows)).collect()}
    assert len(found) == 68 and "2015-02-10" in found and "2015-03-12" not in found
    assert grid.daily_grid(market(spark, rows).limit(0)).count() == 0


def test_grid_of_many_series_equals_pandas(spark):
    rnd = random.Random(1)
    rows = [(f"s{k}", at(rnd.randrange(400)), rnd.choice([1.0, 2.0, None])) for k in range(5) for _ in range(60)]
    got = {(r["series_id"], r["day"]) for r in grid.found(market(spark, rows)).collect()}
    p = pd.DataFrame(rows, columns=["s", "d", "v"]).dropna()
    want = {(s, d.strftime("%Y-%m-%d")) for s, g in p.groupby("s") for d in pd.date_range(g.d.min(), g.d.max()) if d not in set(g.d)}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.floats(-100, 100)), min_size=1, max_size=40), st.integers(1, 30))
def test_two_stack_queue(items, width):
    days: dict[int, list[float]] = {}
    for d, v in items:
        days.setdefault(d, []).append(v)
    q = rolling.TwoStackQueue(rolling.combine, rolling.EMPTY)
    for x in range(min(days), max(days) + 1):
        q.drop_before(x - width + 1)
        for v in days.get(x, []):
            q.push(x, (v, 1, v, v))
        own = [v for d, vs in days.items() if x - width < d <= x for v in vs]
        s, n, lo, hi = q.whole()
        assert n == len(own) and s == pytest.approx(sum(own), abs=1e-6)
        assert (lo, hi) == ((min(own), max(own)) if own else (np.inf, -np.inf))


def test_trailing_windows(spark):
    rows = [("a", at(0), 1.0), ("a", at(0), 3.0), ("a", at(2), None), ("a", at(10), 5.0), ("b", at(4), float("nan")), (None, at(1), 2.0)]
    r = rolling.market(market(spark, rows)).orderBy("series_id", "day").toPandas()
    a = r[r.series_id == "a"].reset_index(drop=True)
    assert len(a) == 11 and len(r) == 12
    assert (a.n_7[6], a.sum_7[6], a.avg_7[6], a.min_7[6], a.max_7[6]) == (2, 4.0, 2.0, 1.0, 3.0)
    assert a.n_7[7] == 0 and a.sum_7[7] == 0 and np.isnan(a.avg_7[7]) and np.isnan(a.min_7[7])
    assert (a.n_30[10], a.sum_30[10]) == (3, 9.0)
    assert rolling.market(market(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------ implausible readings


def plain(tbl, field, rule, ts, v, lim):
    """The rules word by word, without filter, blocks or arrays."""
    n, out = len(v), set()
    for i in range(n):
        if v[i] < rule.low or v[i] > rule.high or (rule.low_open and v[i] == rule.low):
            out.add(i)
        if rule.over and lim == lim and v[i] > rule.over * lim:
            out.add(i)
    i = 0
    while rule.stuck and i < n:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if j - i + 1 >= rule.stuck and v[i] >= rule.stuck_from:
            out.update(range(i, j + 1))
        i = j + 1
    if rule.spike:
        steps: list[list[int]] = []
        for i in range(n):
            new = (ts[i] // anomalies.DAY_US != ts[i - 1] // anomalies.DAY_US) if rule.by_day else (ts[i], v[i]) != (ts[i - 1], v[i - 1])
            if i == 0 or new:
                steps.append([])
            steps[-1].append(i)
        for a in range(1, len(steps) - 1):
            for b in range(a, min(a + rule.spike, len(steps) - 1)):
                if b + 1 >= len(steps):
                    break
                before, after = v[steps[a - 1][-1]], v[steps[b + 1][0]]
                own = [v[i] for s in steps[a : b + 1] for i in s]
                far = (lambda r: rule.ratio * abs(r)) if rule.ratio else (lambda r: rule.times * lim)
                if all(x - before > far(before) and x - after > far(after) for x in own) or all(before - x > far(before) and after - x > far(after) for x in own):
                    out.update(i for s in steps[a : b + 1] for i in s)
    return out


@pytest.mark.parametrize("field", list(anomalies.RULES))
def test_flags_equal_the_plain_rules(field):
    rule = anomalies.RULES[field]
    rnd = random.Random(field)
    for trial in range(150):
        n = rnd.randrange(0, 60)
        level = 10.0
        ts, v = [], []
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 1, 1, 1, 2]) * (anomalies.DAY_US if rule.by_day else 1_000_000)
            level = rnd.choice([level] * 6 + [level * 1.05, level * 0.95, level * 2, 10.0])
            x = rnd.choice([level] * 12 + [level * 3, level * 0.4, -1.0, 0.0, 99.0])
            if rnd.random() < 0.05 and v:
                t, x = ts[-1], v[-1]
            ts.append(t)
            v.append(round(x, 2))
        if field == "value":
            last = {}
            for a, b in zip(ts, v):
                last[a // anomalies.DAY_US] = b
            d = np.abs(np.diff(list(last.values())))
            lim = float(np.median(d)) if len(d) else float("nan")
        else:
            own = [x for x in v if 2 <= x <= 60]
            lim = float(np.percentile(own, 95)) if field == "sog" and own else float("nan")
        code = anomalies.implausible(rule, np.array(ts, dtype=np.int64), np.array(v, dtype=float), lim)
        if field == "value" and lim != lim:
            continue
        assert set(np.flatnonzero(code).tolist()) == plain("", field, rule, ts, v, lim), (trial, ts, v)


def test_totals_of_silent_entities_run_out(spark):
    day = lambda i: dt.datetime(2015, 1, 1) + dt.timedelta(days=i)
    m = spark.createDataFrame([(day(0), 2.0, "a"), (day(2), 3.0, "a"), (day(90), 1.0, "b"), (day(80), 5.0, "c")], "date timestamp_ntz, value double, series_id string")
    got = {(r["series_id"], (r["day"] - day(0).date()).days): r for r in rolling.market(m, run_out=True).collect()}
    assert sorted(got) == [("a", i) for i in range(32)] + [("b", 90)] + [("c", i) for i in range(80, 91)]
    assert [got["a", i]["sum_30"] for i in (2, 29, 30, 31)] == [5.0, 5.0, 3.0, 3.0] and [got["a", i]["sum_7"] for i in (6, 7, 8, 9)] == [5.0, 3.0, 3.0, 0.0]
    short = {tuple(r) for r in rolling.market(m).collect()}
    assert len(short) == 5 and short <= set(map(tuple, got.values())) and rolling.market(m.limit(0), run_out=True).count() == 0


def test_kalman_withholds_spikes_and_takes_new_levels():
    v = np.array([10.0] * 5 + [30.0] * 2 + [10.0] * 3 + [20.0] * 8)
    nu, f = anomalies.kalman(v, 5.0, 3)
    assert (nu[f] > 5.0).all() and (nu[~f] <= 5.0).all()
    assert f[5:7].all() and not f[:5].any() and not f[7:10].any()
    assert f[10:13].all() and not f[13:].any()  # by then the level is uncertain enough


def test_the_filter_decides(monkeypatch):
    """Without flags there is no spike, with innovations that keep a variance nothing is stuck."""
    rule, v = anomalies.RULES["value"], np.array([10.0, 11, 10, 90, 10, 11, 10] + [12.0] * 12 + [10.0])
    ts = np.arange(len(v)) * anomalies.DAY_US
    codes = lambda: set(anomalies.implausible(rule, ts, v, 1.0).tolist())
    assert codes() == {0, 3, 4}
    real = anomalies.kalman
    monkeypatch.setattr(anomalies, "kalman", lambda *a: (real(*a)[0], np.zeros(len(a[0]), dtype=bool)))
    assert codes() == {0, 3}
    monkeypatch.setattr(anomalies, "kalman", lambda *a: (np.ones(len(a[0])), real(*a)[1]))
    assert codes() == {0, 4}


def test_blocks_of_a_hot_source_change_nothing(spark, sf):
    p, m = spark.read.parquet(f"{sf}/positions.parquet"), spark.read.parquet(f"{sf}/market_daily.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(anomalies.flag(p, m))
    assert whole and key(anomalies.flag(p, m, rows_per_block=150)) == whole
    assert len(whole) == len(set(whole))
    assert key(anomalies.flag(p.limit(0), m.limit(0))) == []


@pytest.mark.parametrize("per_block", [70, 150, 250])
def test_spikes_of_days_across_cuts_of_dense_days(spark, per_block):
    rows = []
    for series, length in (("two", 2), ("three", 3)):
        for day in range(40):
            high = day % 8 in range(5, 5 + length)  # 5 and 6; 5 to 7: any cut between days falls into some
            rows += [(len(rows) + i, dt.datetime(2015, 1, 1) + dt.timedelta(days=day, minutes=i), 10.0 + day % 2 + i / 1000 + 90 * high, series) for i in range(70)]
    m = spark.createDataFrame(rows, "obs_id long, date timestamp_ntz, value double, series_id string")
    p = spark.createDataFrame([], "msg_id long, mmsi string, ts_utc timestamp_ntz, sog double, draught double")
    ids = lambda n: {r["row_id"] for r in anomalies.flag(p, m, rows_per_block=n).collect() if r["reason"] == "spike"}
    want = {i for i, _, v, _ in rows if v > 90} - {i for i, d, _, s in rows if s == "three" and d >= dt.datetime(2015, 2, 7)}  # nothing follows the last
    assert want and ids(10**9) == want and ids(per_block) == want


def test_copies_are_flagged_and_nulls_are_not(spark):
    rows = [(i, "a", dt.datetime(2015, 1, 1, i), s, d) for i, (s, d) in enumerate([(5.0, 8.0), (70.0, 8.0), (70.0, None), (None, 20.0), (float("nan"), 8.0), (-0.5, 0.0), (6.0, 8.0)])]
    rows += [(9, "a", dt.datetime(2015, 1, 1, 1), 70.0, 8.0), (10, None, dt.datetime(2015, 1, 1), 999.0, 999.0)]
    p = spark.createDataFrame(rows, "msg_id long, mmsi string, ts_utc timestamp_ntz, sog double, draught double")
    m = spark.createDataFrame([], "obs_id long, date timestamp_ntz, value double, series_id string")
    got = {(r["field"], r["row_id"]) for r in anomalies.found(p, m).collect()}
    assert got == {("sog", 1), ("sog", 2), ("sog", 9), ("sog", 5), ("draught", 5), ("draught", 3)}
