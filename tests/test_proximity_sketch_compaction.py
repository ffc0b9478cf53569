import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import compaction, proximity, sketches


def hav(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


@pytest.mark.parametrize("radius", [0.5, 5.0, 300.0])
def test_within_distance_equals_brute_force(spark, radius, monkeypatch):
    rnd = random.Random(radius)
    sites = [("s", 25.0, 55.0), ("near", 25.01, 55.01), ("pole", 89.99, 10.0), ("date", -10.0, 179.99), ("corner", -90.0, -180.0), ("none", None, 1.0), ("bad", 95.0, 1.0), ("s", 25.0, 55.0)]
    pts = []
    for _, a, b in sites[:5]:
        for _ in range(120):
            r, w = radius / 111 * 1.6 * rnd.random(), rnd.random() * 2 * math.pi
            y = max(-90.0, min(90.0, a + r * math.sin(w)))
            x = b + r * math.cos(w) / max(0.02, math.cos(math.radians(y)))
            pts.append((y, (x + 180) % 360 - 180))
    pts += [(None, 55.0), (25.0, None), (91.0, 55.0), (25.0, 200.0), (90.0, 180.0), (float("nan"), 0.0)]
    p = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(pts)], "msg_id long, lat double, lon double, site string")
    s = spark.createDataFrame(sites, "name string, latitude double, longitude double")
    ok = lambda a, b: a is not None and b is not None and abs(a) <= 90 and abs(b) <= 180
    want = sorted((i, n) for i, (a, b) in enumerate(pts) for n, c, d in sites if ok(a, b) and ok(c, d) and hav(a, b, c, d) <= radius)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(proximity.within_distance(p, s, radius)) == want
    monkeypatch.setattr(proximity, "MAX_BROADCAST_ROWS", 3)  # the way for large coverages
    assert key(proximity.within_distance(p, s, radius)) == want
    inner = s.filter("name in ('s', 'near')")  # without the poles' cells
    assert key(proximity.within_distance(p, inner, radius)) == sorted(x for x in want if x[1] in ("s", "near"))
    assert proximity.within_distance(p.limit(0), s, radius).count() == 0 == proximity.within_distance(p, s.limit(0), radius).count()


def test_sketch_bounds_and_merging(spark):
    rng = np.random.default_rng(5)
    errors = []
    for n in (3, 50, 2_000):
        for _ in range(20):
            s = sketches.registers_of(rng.integers(0, 1 << 63, n, dtype=np.int64), sketches.M).sum()
            lo, hi = sketches.gamma_quantile(sketches.M, 0.005) / s, sketches.gamma_quantile(sketches.M, 0.995) / s
            errors.append((((sketches.M - 1) / s / n - 1), lo <= n <= hi))
    e = np.array([x for x, _ in errors])
    assert abs(e.mean()) < 0.02 and e.std() < 0.06
    assert np.mean([x for _, x in errors]) >= 0.93


def test_registers_are_minima_of_exponentials_of_each_item():
    """Against drawing every arrival until each register has had one, item by item."""
    m, rng = 32, np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 50, dtype=np.int64).view(np.uint64)
    want = np.full(m, np.inf)
    for x in h:
        first, t, k = np.full(m, np.inf), 0.0, 0
        while np.isinf(first).any():
            wait, at = sketches.arrivals(np.array([x]), k, 1, m)
            t, k = t + wait[0, 0], k + 1
            first[at[0, 0]] = min(first[at[0, 0]], t)
        want = np.minimum(want, first)
    np.testing.assert_allclose(sketches.registers_of(h, m), want, rtol=1e-12)
    halves = np.minimum(sketches.registers_of(h[:20], m), sketches.registers_of(h[10:], m))
    assert (halves == sketches.registers_of(h, m)).all()  # to the last bit, overlaps and all
    one = np.concatenate([sketches.registers_of(np.array([x]), 512) for x in h])
    assert abs(one.mean() - 1) < 0.03 and abs((one > 1).mean() - np.exp(-1)) < 0.02  # Exp(1)


def test_sketch_cube_counts_and_cases(spark):
    rows = [("20150301000000", "4", f"u{i % 300}") for i in range(3000)] + [("20150302000000", "04", f"u{i}") for i in range(100)]
    rows += [("bad", "19", "v"), (None, None, "w"), ("20150302000000", None, "x"), ("20150302000000", "19", None)]
    e = spark.createDataFrame([(*r, "clash", 1) for r in rows], "DATEADDED string, EventRootCode string, SOURCEURL string, day string, level int")
    got = {(r["level"], r["day"], r["root"]): (r["low"], r["high"], r["estimate"]) for r in sketches.estimates(sketches.distinct_cube(e)).collect()}
    want = {("total", None, None): 303, ("day", "2015-03-01", None): 300, ("day", "2015-03-02", None): 101, ("root", None, "04"): 300, ("root", None, "19"): 1, ("day_root", "2015-03-01", "04"): 300, ("day_root", "2015-03-02", "04"): 100}
    assert set(got) == set(want)
    for k, n in want.items():
        assert abs(got[k][2] / n - 1) < 0.2, k
    assert sketches.distinct_cube(e.limit(0)).count() == 0
    # partials of any cut give the same registers
    a = sketches.distinct_cube(e.repartition(7)).collect()
    b = sketches.distinct_cube(e.coalesce(1)).collect()
    key = lambda rs: sorted((r["level"], r["day"] or "", r["root"] or "", bytes(r["registers"])) for r in rs)
    assert key(a) == key(b)


def test_first_fit_decreasing():
    rnd = random.Random(2)
    for _ in range(50):
        target = 100
        sizes = [rnd.randrange(0, 130) for _ in range(rnd.randrange(0, 60))]
        got = compaction.first_fit_decreasing(sizes, target)
        room: list[int] = []
        want = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            s = min(sizes[i], target)
            at = next((k for k, r in enumerate(room) if r >= s), len(room))
            if at == len(room):
                room.append(target)
            room[at] -= s
            want[i] = at
        assert got == want


def tables(spark):
    ev = [(g, f, x) for g, f, x in [("1", "e/dt=2015-03-01/a", 1.0), ("1", "e/dt=2015-03-01/b", 2.0), ("1", "e/dt=2015-03-02/c", 3.0), ("2", "e/dt=2015-03-01/a", 1.0), ("2", "e/dt=2015-03-01/a", 1.0), (None, "e/dt=2015-03-01/a", 5.0), (None, "e/dt=2015-03-01/b", 5.0), ("3", "e/dt=2015-03-01/b", None)]]
    t = dt.datetime(2015, 3, 1)
    po = [("m", t, "p/dt=2015-03-01/x", 1), ("m", t, "p/dt=2015-03-01/y", 2), ("n", t, "p/dt=2015-03-01/x", 3), (None, t, "p/dt=2015-03-01/x", 4), ("m", None, "p/dt=2015-03-01/y", 5)]
    names = [("e/dt=2015-03-01/a", "events"), ("e/dt=2015-03-01/b", "events"), ("e/dt=2015-03-02/c", "events"), ("e/dt=2015-03-02/empty", "events"), ("p/dt=2015-03-01/x", "positions"), ("p/dt=2015-03-01/y", "positions")]
    sl = [(n, d, 3, 1000, t + dt.timedelta(hours=i)) for i, (n, d) in enumerate(names)]
    return (
        spark.createDataFrame([(*r, "clash", "clash") for r in ev], "GlobalEventID string, src_file string, AvgTone double, bin string, written_at string"),
        spark.createDataFrame(po, "mmsi string, ts_utc timestamp_ntz, src_file string, msg_id long"),
        spark.createDataFrame(sl, "file_name string, dataset string, n_rows long, n_bytes long, written_at timestamp_ntz"),
    )


def test_ledger_and_compaction(spark, tmp_path):
    e, p, s = tables(spark)
    got = sorted(map(tuple, compaction.found(e, p, s).collect()))
    assert got == [("e/dt=2015-03-01/a", "e/dt=2015-03-01/b"), ("e/dt=2015-03-01/a", "e/dt=2015-03-02/c"), ("e/dt=2015-03-01/b", "e/dt=2015-03-02/c"), ("p/dt=2015-03-01/x", "p/dt=2015-03-01/y")]
    bins = compaction.plan(compaction.manifest(s), target=2500)
    assert bins.count() == 6 and bins.groupBy("bin").agg(F.sum("n_bytes").alias("b")).filter("b > 2500").count() == 0
    r = compaction.compact(e, "events", ["GlobalEventID"], bins, f"file://{tmp_path}/out").toPandas()
    with pytest.raises(FileNotFoundError):  # nothing is seen before it is published
        compaction.compacted(spark, f"file://{tmp_path}/out", "events")
    for _ in range(2):  # a second run is published over the first
        report = compaction.compact(e, "events", ["GlobalEventID"], bins, f"file://{tmp_path}/out")
        compaction.commit(spark, f"file://{tmp_path}/out", report)
    back = compaction.compacted(spark, f"file://{tmp_path}/out", "events").toPandas()
    assert sorted(back.GlobalEventID.dropna()) == ["1", "2", "3"] and back.GlobalEventID.isna().sum() == 2
    assert back[back.GlobalEventID == "1"].AvgTone.tolist() == [3.0]  # the copy written last
    assert r.rows_out.sum() == 5
    only = e.filter("GlobalEventID = '3'").first()["src_file"]  # rows of files outside the plan are not lost unseen
    some = bins.filter(F.col("file_name") != only)
    with pytest.raises(RuntimeError, match="rows"):
        compaction.compact(e, "events", ["GlobalEventID"], some, f"file://{tmp_path}/out")
    assert compaction.found(e.limit(0), p.limit(0), s.limit(0)).count() == 0


def test_rows_outside_the_list_of_files_are_compacted(spark):
    e, p, s = tables(spark)
    want = sorted(map(tuple, compaction.found(e, p, s).collect()))
    lost = F.col("file_name").isin("e/dt=2015-03-01/b", "p/dt=2015-03-01/y")
    other = s.filter(~lost).withColumn("dataset", F.when(F.col("file_name") != "e/dt=2015-03-01/a", F.col("dataset")))
    e2 = e.unionByName(e.filter("GlobalEventID = '3'").withColumn("GlobalEventID", F.lit("4")).withColumn("src_file", F.lit(None).cast("string")))
    assert sorted(map(tuple, compaction.found(e2, p, other).collect())) == want
    r = {x["dataset"]: x for x in compaction.compact_all(e2, p, other).groupBy("dataset").agg(F.sum("rows_out").alias("n"), F.sum("files").alias("files")).collect()}
    assert (r["events"]["n"], r["events"]["files"], r["positions"]["n"], r["positions"]["files"]) == (6, 4, 4, 2)


def test_damage_is_not_committed(spark, tmp_path, monkeypatch):
    e, p, s = tables(spark)
    bins = compaction.plan(compaction.manifest(s))
    real = compaction._sums
    calls = []

    def lossy(df, cols):
        calls.append(1)
        return real(df if len(calls) % 2 else df.filter("GlobalEventID <> '2'"), cols)

    monkeypatch.setattr(compaction, "_sums", lossy)
    with pytest.raises(RuntimeError):
        compaction.compact(e, "events", ["GlobalEventID"], bins, f"file://{tmp_path}/out")
    assert not (tmp_path / "out" / compaction.POINTER).exists()


def test_every_row_survives_on_the_tables(spark, sf):
    e, p, s = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("event_rows", "positions", "slot_files"))
    r = compaction.compact_all(e, p, s).groupBy("dataset").agg(F.sum("rows_out").alias("n")).collect()
    assert {x["dataset"]: x["n"] for x in r} == {"events": e.select("GlobalEventID").distinct().count(), "positions": p.select("mmsi", "ts_utc").distinct().count()}


@pytest.mark.parametrize("level", [0, 2, 3, 4, 9, 13])
def test_cells_of_points_and_cover_agree(spark, level):
    n = 1 << level
    rows = sorted({0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, n // 2, n - 2, n - 1} & set(range(n)))
    lats = [-90 + 180 * (r + 0.5) / n for r in rows]
    d = spark.createDataFrame([(r, a, lon) for r, a in zip(rows, lats) for lon in (-180.0, -0.1, 77.7, 180.0)], "r long, lat double, lon double")
    for x in d.withColumn("k", proximity.cell_key(F.col("lat"), F.col("lon"), level)).collect():
        c = proximity.columns_at(x["r"], level)
        assert x["k"] == (level << 50) + (x["r"] << 25) + min(c - 1, math.floor((x["lon"] + 180) / 360 * c))
