import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import api
from tidegauge.operators import fusion, intervals, market_model, raster
from tidegauge.sources import payloads


def test_price_bars_keep_their_wall_clock(spark):
    bars = [{"Date": "2015-03-02T00:00:00-05:00", "Close": 10.5, "Volume": 7}, {"Date": "2015-03-03 23:30:00+09:00", "Close": None, "Volume": None}, {"Date": "2015-03-04", "Close": 11.0}, {"Date": "bad", "Close": 1.0}]
    d = spark.createDataFrame([("x", json.dumps(bars)), ("y", "no json"), ("z", None)], "s string, j string")
    got = payloads.price_bars(d, "j", F.col("s")).orderBy("date").collect()
    assert [(r["series_id"], r["date"], r["value"], r["volume"], r["official"]) for r in got] == [
        ("x", dt.datetime(2015, 3, 2), 10.5, 7.0, False), ("x", dt.datetime(2015, 3, 3, 23, 30), None, None, False), ("x", dt.datetime(2015, 3, 4), 11.0, None, False),
    ]


def test_datapoints_of_reports(spark):
    report = {"entries": [{"a": [1, 2, 3], "b": 4, "c": "text"}, {"d": [], "e": 1.5, "f": None, "g": {"x": [1]}}]}
    d = spark.createDataFrame([(1, json.dumps(report)), (2, '{"entries": []}'), (3, "oops"), (4, None)], "k int, j string")
    assert {r["k"]: r["datapoints"] for r in payloads.datapoints(d, "j").collect()} == {1: 5, 2: 0, 3: None, 4: None}


def test_coast_lines(spark):
    at = lambda *xy: [{"lat": a, "lon": b} for a, b in xy]
    e = [{"id": 1, "tags": {"natural": "coastline", "name": "n"}, "geometry": at((1.0, 2.0), (3.0, 4.0))}, {"id": 2, "geometry": at((1.0, 2.0))}, {"id": 3, "tags": {"man_made": "pier"}, "geometry": at((0.0, 0.0), (0.0, 1.0))}, {"id": 4, "geometry": at((0.0, 0.0), (1.0, 1.0))}, {"id": 5}]
    d = spark.createDataFrame([(json.dumps({"elements": e}),), (None,)], "j string")
    got = {r["osm_id"]: (r["kind"], r["name"], r["line"]) for r in payloads.coast_lines(d, "j").collect()}
    assert got == {1: ("coastline", "n", [[2.0, 1.0], [4.0, 3.0]]), 3: ("pier", None, [[0.0, 0.0], [1.0, 0.0]]), 4: ("unknown", None, [[0.0, 0.0], [1.0, 1.0]])}


def test_slot_urls_and_dimensions(spark):
    d = spark.createDataFrame([("20150302001500", "s1"), ("20150302003000", "s2")], "stamp string, series_id string")
    assert [r[0] for r in d.select(payloads.slot_url(F.col("stamp"), "http://x/y/")).collect()] == ["http://x/y/20150302001500.export.CSV.zip", "http://x/y/20150302003000.export.CSV.zip"]
    assert d.select(payloads.slot_url(F.col("stamp"), "http://x/y", True)).first()[0] == "http://x/y/20150302001500.translation.export.CSV.zip"
    dim = spark.createDataFrame([("s1", "one"), ("s1", "one")], "series_id string, role string")
    assert [(r["series_id"], r["role"]) for r in payloads.describe(d, dim).collect()] == [("s1", "one")]


def test_panel_of_three_arms(spark):
    day = lambda k: dt.date(2015, 1, k)
    a = spark.createDataFrame([(day(1), 1.0), (day(4), 2.0)], "date date, brent double")
    chips = [("p", day(2), 0.95, 4, 9), ("p", day(2), 0.9, None, 6), ("p", day(3), 0.5, 50, 50), ("q", day(2), None, 3, 3)]
    r = fusion.port_features(spark.createDataFrame(chips, "port string, date date, coverage double, n_on_water int, n_detections int"), ["p", "q"])
    got = {x["date"].day: (x["brent"], x["sar_vessels_p"], x["sar_vessels_q"]) for x in fusion.panel(a, r, a.limit(0)).collect()}
    assert got == {1: (1.0, None, None), 2: (None, 5.0, None), 3: (None, None, None), 4: (2.0, None, None)}
    with pytest.raises(ValueError):
        fusion.panel(a.limit(0))


def test_evaluation_and_lead_times(spark):
    cal = (intervals.period("e", "2015-03-01"), intervals.period("none", "2019-01-01"))
    days = [dt.date(2014, 10, 1) + dt.timedelta(days=k) for k in range(200)]
    rng = np.random.default_rng(1)
    rows = []
    for d in days:
        near, other = abs((d - dt.date(2015, 3, 1)).days) <= 20, d < dt.date(2014, 10, 6)
        rows.append((d, float(rng.random() + (5 if near and d >= dt.date(2015, 2, 19) else 0) + 9 * other), near, other, not near and not other))
    s = market_model.with_thresholds(spark.createDataFrame(rows, "date date, recon_error double, near_event boolean, declared_other boolean, clean boolean"))
    e = market_model.evaluation(s).first()
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if r[4]]
    assert e["auc_event_vs_calm"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) and e["other_fires"] and e["other_pct_above_p95"] == 100.0
    assert e["false_positives"] == sum(v > np.percentile(neg, 99) for v in neg) and e["false_positive_pct"] == pytest.approx(e["false_positives"] / 2)
    lead = {(r["event"], r["threshold"]): r for r in market_model.lead_report(s, cal).collect()}
    onset = dt.date(2015, 3, 1)
    for k, share in (("p95", 95), ("p99", 99)):
        first = min(d for d, v, *_ in rows if onset - dt.timedelta(days=60) <= d <= onset and v > np.percentile(neg, share))
        assert lead["e", k]["first_cross"] == first and lead["e", k]["lead_days"] == (onset - first).days >= 10 and lead["e", k]["detected"]
    assert lead["none", "p95"]["n_days"] == 0 and lead["none", "p95"]["detected"] is None and len(lead) == 4


def test_live_titles_are_scored(spark, sf01):
    t = [r for r in api.predict_live(spark, sf01).collect() if r["kind"] == "title"]
    assert len(t) == 5 and [r["value"] for r in t] == sorted((r["value"] for r in t), reverse=True) and all(r["value"] is not None for r in t)


def test_chip_requests(spark):
    d = spark.createDataFrame([((1.0, 2.0, 3.0, 4.0), dt.date(2015, 2, 28))], "box struct<south: double, west: double, north: double, east: double>, day date")
    body = json.loads(d.select(payloads.chip_request(F.col("box"), F.col("day"), 256)).first()[0])
    assert body["input"]["bounds"]["bbox"] == [2.0, 1.0, 4.0, 3.0] and body["output"]["width"] == body["output"]["height"] == 256
    assert body["input"]["data"][0]["dataFilter"]["timeRange"] == {"from": "2015-02-28T00:00:00Z", "to": "2015-03-01T00:00:00Z"} and '["VV", "VH"]'.strip("[]") in body["evalscript"]


def test_flood_stops_at_the_coast(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0), (2, 0.0, 0.0, 20.0, 20.0)], "chip long, south double, west double, north double, east double")
    ring = [[5.0, 5.0], [15.0, 5.0], [15.0, 15.0], [5.0, 15.0], [5.0, 5.0]]
    lines = spark.createDataFrame([(1, ring), (2, [[10.0, -5.0], [10.0, 25.0]]), (2, [[1.0, 1.0]])], "chip long, line array<array<double>>")
    b = raster.coast_pixels(lines, box, 21, 21)
    w = {(r["chip"], r["row"], r["col"]): r["water"] for r in raster.flooded(b, 21, 21).collect()}
    assert len(w) == 2 * 441 and not w[1, 10, 10] and not w[1, 5, 10] and not w[1, 4, 10] and w[1, 2, 10] and w[1, 20, 20]
    assert w[2, 10, 0] and w[2, 10, 20] and not w[2, 10, 10] and not w[2, 10, 11] and w[2, 10, 12]


def test_patch_models_and_pictures(spark):
    import io
    import struct
    import zlib

    px = spark.createDataFrame([(1, r, c, 0.01 + (r == 8 and c == 8), 0.02) for r in range(16) for c in range(16)], "chip long, row int, col int, vv double, vh double")
    at = spark.createDataFrame([(1, 7, 8.0, 8.0, 3)], "chip long, label int, row double, col double, size_px long")
    got = raster.score_patches(raster.patches(px, at, 4, 16, 16), 4, lambda x: x[:, :, :, 0].max(axis=(1, 2))).collect()
    assert [(r["chip"], r["label"]) for r in got] == [(1, 7)] and got[0]["score"] == pytest.approx((10 * np.log10(1.01) + 35) / 40)
    assert raster.score_patches(raster.patches(px, at.limit(0), 4, 16, 16), 4, lambda x: x[:, 0, 0, 0]).count() == 0
    for marks, colours in ((None, 1), (at, 2)):
        raw = io.BytesIO(raster.pictures(px, marks).first()["png"])
        assert raw.read(8) == b"\x89PNG\r\n\x1a\n"
        parts = {}
        while head := raw.read(8):
            n, kind = struct.unpack(">I4s", head)
            parts[kind] = raw.read(n)
            assert struct.unpack(">I", raw.read(4))[0] == zlib.crc32(kind + parts[kind])
        lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(16, 49)[:, 1:].reshape(16, 16, 3)
        assert (lines == raster.RING).all(axis=2).any() == (colours == 2) and lines[8, 8].tolist() == [round(255 * (25 + 10 * np.log10(1.01)) / 30 - 0.5)] * 3
