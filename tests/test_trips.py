import datetime as dt
import math
import random

import numpy as np
import pytest

from tidegauge.operators import trips

SCHEMA = "msg_id long, mmsi string, ts_utc timestamp_ntz, lat double, lon double, extra string"
T0 = dt.datetime(2015, 3, 1)


def track(mmsi, plan, seed=0, start=T0):
    """Rows of a vessel: plan of ('stop', lat, lon, minutes), ('move', lat, lon, minutes) and ('gap', hours)."""
    rnd, t, rows, at = random.Random(seed), start, [], None
    for kind, *p in plan:
        if kind == "gap":
            t += dt.timedelta(hours=p[0])
            continue
        lat, lon, minutes = p
        n = int(minutes // 5)
        for k in range(n):
            if kind == "stop":
                y, x = lat + rnd.gauss(0, 3e-4), lon + rnd.gauss(0, 3e-4)
            else:
                f = (k + 1) / (n + 1)
                y, x = at[0] + (lat - at[0]) * f, at[1] + (lon - at[1]) * f
            rows.append([0, mmsi, t, y, x, "e"])
            t += dt.timedelta(minutes=5)
        at = (lat, lon)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([[i, *r[1:]] for i, r in enumerate(rows)], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select("mmsi", "kind", "start_ts", "end_ts").collect())


PLAN = [("stop", 25.0, 55.0, 120), ("move", 25.5, 55.5, 180), ("stop", 25.5, 55.5, 300), ("move", 25.0, 55.0, 180), ("stop", 25.0, 55.0, 90)]


def test_planted_stops_and_trips(spark):
    rows = track("a", PLAN)
    v = trips.stops_and_trips(frame(spark, rows)).toPandas()
    stops, moves = v[v.kind == "stop"].sort_values("start_ts"), v[v.kind == "trip"].sort_values("start_ts")
    assert len(stops) == 3 and len(moves) == 2
    assert list(stops.start_ts) == [rows[0][2], rows[24 + 36][2], rows[24 + 36 + 60 + 36][2]]
    assert list(stops.end_ts) == [rows[23][2], rows[24 + 36 + 59][2], rows[-1][2]]
    assert stops.place.iloc[0] == stops.place.iloc[2] != stops.place.iloc[1]  # the first place recurs
    direct = 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(0.25)) ** 2 + math.cos(math.radians(25)) * math.cos(math.radians(25.5)) * math.sin(math.radians(0.25)) ** 2))
    assert moves.distance_m.iloc[0] / 1000 == pytest.approx(direct, rel=0.03)
    assert list(moves.duration_s) == [(b - a).total_seconds() for a, b in zip(stops.end_ts[:-1], list(stops.start_ts)[1:])]


def test_lone_fix_elsewhere_and_two_of_them(spark):
    rows = track("a", [("stop", 25.0, 55.0, 240)])
    rows[20][3] += 0.5  # alone: the stop goes on
    assert len(got(trips.stops_and_trips(frame(spark, rows)))) == 1
    rows[21][3] += 0.5  # two in a row: it ends
    assert [k for _, k, *_ in got(trips.stops_and_trips(frame(spark, rows)))] == ["stop", "stop", "trip"]


def test_communities_decide(spark, monkeypatch):
    """Where every median is a place of its own, or all are one, the stops are others."""
    rows = track("a", PLAN)
    want = got(trips.stops_and_trips(frame(spark, rows)))
    t = np.array([r[2].timestamp() for r in rows]).astype(np.int64) * 1_000_000
    own = lambda: trips._History(t, *trips._unit(*np.array([r[3:5] for r in rows], dtype=float).T), 500.0, 1_800_000_000).settled()
    assert len(own()) == sum(k == "stop" for _, k, *_ in want) == 3
    monkeypatch.setattr(trips, "communities", lambda p, w, r: np.arange(len(p)))
    assert own() == []


def test_communities_of_a_proximity_graph():
    rnd = np.random.default_rng(5)
    centres = np.array([[0.0, 0, 0], [5_000.0, 0, 0], [0.0, 9_000, 0]])
    p = np.concatenate([c + rnd.normal(0, 60, (40, 3)) for c in centres])
    label = trips.communities(p, np.ones(len(p)), 500.0)
    assert [len(set(label[a : a + 40].tolist())) for a in (0, 40, 80)] == [1, 1, 1] and len(set(label.tolist())) == 3
    assert trips.communities(p[:2] * [[1, 1, 1], [1, 1, 1]], np.array([3.0, 3.0]), 500.0).tolist() == [0, 0]  # two equal ones near each other are one place


def test_silence(spark):
    for hours, kinds in ((23, ["stop"]), (25, ["stop", "stop"])):
        rows = track("a", [("stop", 25.0, 55.0, 60), ("gap", hours), ("stop", 25.0, 55.0, 60)])
        assert [k for _, k, *_ in got(trips.stops_and_trips(frame(spark, rows)))] == kinds
    rows = track("a", [("stop", 25.0, 55.0, 60), ("move", 25.5, 55.0, 60), ("gap", 30), ("move", 26, 55.0, 60), ("stop", 26.0, 55.0, 60)])
    assert [k for _, k, *_ in got(trips.stops_and_trips(frame(spark, rows)))] == ["stop", "stop"]


def test_short_stays_are_no_stops_and_speed_does_not_matter(spark):
    assert got(trips.stops_and_trips(frame(spark, track("a", [("stop", 25.0, 55.0, 25)])))) == []
    assert got(trips.stops_and_trips(frame(spark, track("a", [("stop", 25.0, 55.0, 5), ("move", 26.0, 56.0, 600)])))) == []


def test_bad_rows_copies_and_empty(spark):
    rows = track("a", PLAN)
    want = got(trips.stops_and_trips(frame(spark, rows)))
    bad = [[0, "a", rows[5][2] + dt.timedelta(seconds=9), *x, None] for x in ((None, 55.0), (25.0, None), (91.0, 55.0), (25.0, 181.0), (float("nan"), 55.0))]
    bad += [[0, None, rows[5][2], 25.0, 55.0, None], [0, "a", None, 25.0, 55.0, None]]
    assert got(trips.stops_and_trips(frame(spark, rows + rows[::3] + bad))) == want
    assert got(trips.stops_and_trips(frame(spark, []).limit(0))) == []
    assert trips.found(frame(spark, rows)).columns == ["mmsi", "kind", "start_hour", "end_hour"]


def test_poles_and_antimeridian(spark):
    for lat, lon in ((0.0, 179.9999), (89.99, 10.0)):
        rows = track("a", [("stop", lat, lon, 120)], seed=3)
        for r in rows:
            r[4] = r[4] - 360 if r[4] > 180 else r[4]
            r[3] = min(r[3], 90.0)
        assert len(got(trips.stops_and_trips(frame(spark, rows)))) == 1


def test_blocks_change_nothing(spark):
    rows = []
    for k in range(4):
        plan = []
        rnd = random.Random(k)
        for _ in range(12):
            y, x = 24 + rnd.random() * 2, 54 + rnd.random() * 2
            plan += [("move", y, x, rnd.choice([60, 200, 400])), ("stop", y, x, rnd.choice([20, 45, 400, 3000]))]
        rows += track(f"v{k}", [("stop", 24.0, 54.0, 60), *plan], seed=k)
    df = frame(spark, rows)
    whole = got(trips.stops_and_trips(df))
    assert len(whole) > 60
    assert got(trips.stops_and_trips(df, rows_per_block=300)) == whole


def test_stops_of_the_tables_hold_the_definition(spark, sf):
    p = spark.read.parquet(f"{sf}/positions.parquet")
    v = trips.stops_and_trips(p).filter("kind = 'stop'").toPandas()
    f = trips.fixes(p).orderBy("mmsi", "ts_utc", "msg_id").toPandas().drop_duplicates(["mmsi", "ts_utc"])
    assert len(v)
    for s in v.itertuples():
        g = f[f.mmsi == s.mmsi].reset_index(drop=True)
        x = np.stack(trips._unit(g.lat.to_numpy(), g.lon.to_numpy()), axis=1)
        inner = ((g.ts_utc >= s.start_ts) & (g.ts_utc <= s.end_ts)).to_numpy()
        c = np.median(x[inner], axis=0)
        near = np.linalg.norm(x - c, axis=1) <= 520
        i, j = np.flatnonzero(inner)[[0, -1]]
        out = ~near[i : j + 1]
        assert not (out[1:] & out[:-1]).any()  # only lone fixes lie elsewhere
        assert s.end_ts - s.start_ts >= dt.timedelta(minutes=30)
        far = np.linalg.norm(x - c, axis=1) > 480
        assert i == 0 or far[i - 1] or (g.ts_utc[i] - g.ts_utc[i - 1]) > dt.timedelta(hours=24)
        assert j == len(g) - 1 or far[j + 1] or (g.ts_utc[j + 1] - g.ts_utc[j]) > dt.timedelta(hours=24)
