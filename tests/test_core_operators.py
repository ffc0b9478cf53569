"""Time series, intervals, aggregates, events, rasters, scalar functions against pandas and numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalar as fn
from tidegauge.operators import aggregates as agg
from tidegauge.operators import events as ev
from tidegauge.operators import fusion, intervals, market_model, raster
from tidegauge.operators import timeseries as ts

DAY = dt.date(2014, 1, 1)


def series(n=400, seed=0, gaps=0.15):
    r = np.random.default_rng(seed)
    x = np.round(50 + np.cumsum(r.normal(0, 1, n)), 2)
    x[r.random(n) < gaps] = np.nan
    return pd.Series(x, index=pd.date_range(DAY, periods=n))


def frame(spark, s: pd.Series, name="x"):
    return spark.createDataFrame([(d.date(), None if np.isnan(v) else float(v)) for d, v in s.items()], f"date date, {name} double")


def column(df, c):
    return pd.Series([np.nan if r[c] is None else r[c] for r in df.orderBy("date").select(c).collect()], dtype=float)


def same(a, b, tol=1e-7):
    np.testing.assert_allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float), rtol=tol, atol=tol)


def test_windows_equal_pandas(spark):
    s = series()
    x, w = F.col("x"), ts.ordered()
    d = frame(spark, s).withColumns({
        "p1": ts.pct_change(x, 1, w), "p7": ts.pct_change(x, 7, w), "d7": ts.diff(x, 7, w), "v": ts.rolling(F.stddev_samp, x, 7, 3, w), "m": ts.rolling(F.avg, x, 10, 5, w),
        "z": ts.rolling_z(x, 252, 60, w), "c": ts.count_above(x, 52.0, 30, 10, w), "e": ts.expanding_z(x, 20, w), "f": ts.forward_fill(x, 5, w),
    })
    same(column(d, "p1"), s.pct_change(fill_method=None) * 100)
    same(column(d, "p7"), s.pct_change(7, fill_method=None) * 100)
    same(column(d, "d7"), s.diff(7))
    same(column(d, "v"), s.rolling(7, min_periods=3).std())
    same(column(d, "m"), s.rolling(10, min_periods=5).mean())
    same(column(d, "z"), (s - s.rolling(252, min_periods=60).mean()) / s.rolling(252, min_periods=60).std(), 1e-6)
    same(column(d, "c"), (s > 52).astype(float).rolling(30, min_periods=10).sum())
    same(column(d, "e"), (s - s.expanding(20).mean()) / s.expanding(20).std())
    same(column(d, "f"), s.ffill(limit=5))


def test_causal_rank_and_prefix_invariance(spark):
    s = series(300, 2)
    v = s.to_numpy()
    want = np.full(len(v), np.nan)
    for i in range(len(v)):
        past = v[: i + 1][~np.isnan(v[: i + 1])]
        if not np.isnan(v[i]) and len(past) >= 50:
            want[i] = (past < v[i]).mean()
    got = column(ts.causal_rank(frame(spark, s), "x", 50), "rank")
    same(got, pd.Series(want))
    part = column(ts.causal_rank(frame(spark, s.iloc[:200]), "x", 50), "rank")
    same(part, got.iloc[:200])
    flat = ts.causal_rank(frame(spark, pd.Series([1.0] * 5, index=pd.date_range(DAY, periods=5))), "x", 2)
    assert column(flat, "rank").tolist()[1:] == [0.0] * 4
    assert ts.causal_rank(frame(spark, s).limit(0), "x").count() == 0


def test_market_features_are_causal_and_unfilled(spark):
    a, b = series(330, 4), series(330, 5)
    d = spark.createDataFrame([(x.date(), *(None if np.isnan(v) else float(v) for v in (p, q)), 1.0) for x, p, q in zip(a.index, a, b)], "date date, brent double, wti double, gas double")
    f = fusion.market_features(d)
    part = fusion.market_features(d.filter(F.col("date") < F.lit(a.index[250].date())))
    for c in fusion.SOURCES:
        same(column(f, c).iloc[:250], column(part, c))
    assert fusion.leakage(f).count() == 0
    bad = f.withColumn("spread_z", F.coalesce("spread_z", F.lit(0.0)))
    assert {r["column"] for r in fusion.leakage(bad).collect()} == {"spread_z"}


def test_risk_index_renormalises(spark):
    s = series(200, 6, 0)
    d = frame(spark, s, "arm_b").withColumns({"arm_c": F.when(F.dayofmonth("date") > 15, F.col("arm_b")), "arm_a": F.lit(None).cast("double")})
    r = fusion.risk_index(d, least=20).orderBy("date").toPandas()
    last = r.iloc[-1]
    assert last.arms_available in (1, 2) and r.risk_index.iloc[:19].isna().all()
    one = r[(r.arms_available == 1) & r.rank_arm_b.notna()]
    assert len(one) and np.allclose(one.risk_index, one.rank_arm_b * 100)  # a missing arm is not a zero arm


CAL = (intervals.period("a", "2014-06-01"), intervals.period("b", "2014-09-01", "2014-09-10"), intervals.period("c", "2020-01-01"))


def test_intervals(spark):
    s = series(400, 7, 0)
    d = frame(spark, s)
    m = d.select("date", intervals.inside(F.col("date"), CAL, 10).alias("m")).orderBy("date").toPandas()
    want = [any(p.start - dt.timedelta(10) <= x.date() <= p.end + dt.timedelta(10) for p in CAL) for x in s.index]
    assert m.m.tolist() == want
    look = intervals.lookback(d, CAL, 60).groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in look} == {"a": 61, "b": 61}
    f = {r["event"]: r for r in intervals.leave_one_event_out(d, CAL, least=100).collect()}
    assert f["c"]["reason"] == "no coverage" and f["a"]["reason"] == "too little history" and f["b"]["scoreable"]
    assert f["b"]["train_days"] == (dt.date(2014, 9, 1) - dt.timedelta(70) - DAY).days
    assert intervals.audit_loeo(intervals.leave_one_event_out(d, CAL, least=100), CAL).count() == 0
    pooled = intervals.leave_one_event_out(d, CAL, least=100, causal=False)
    assert {r["problem"] for r in intervals.audit_loeo(pooled, CAL).collect()} >= {"training after the test"}
    folds = intervals.expanding_folds(d, 5, 10, 180).orderBy("fold").collect()
    assert [r["train_days"] for r in folds] == [180 + i * 44 for i in range(5)] and all((r["test_start"] - r["train_end"]).days > 10 for r in folds)
    with pytest.raises(ValueError):
        intervals.expanding_folds(d.limit(100))
    assert intervals.overlapping(CAL, dt.date(2014, 8, 1), dt.date(2014, 9, 1)) == ["b"]


def test_backtest_lead(spark):
    s = pd.Series(np.r_[[5.0] * 228, [90.0] * 10, [5.0] * 100], index=pd.date_range(DAY, periods=338))
    b = {r["event"]: r for r in intervals.backtest(frame(spark, s), CAL, "x", least=120).collect()}
    assert b["b"]["status"] == "detected" and b["b"]["lead_days"] == (dt.date(2014, 9, 1) - s.index[228].date()).days
    assert b["a"]["status"] == "unscoreable" and b["c"]["status"] == "unscoreable"
    assert {r["event"] for r in intervals.backtest(frame(spark, s), CAL, "x", scope="past").collect()} == {"a", "b", "c"}


def test_auc_with_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1.0, 2.0, 2.5, 4.0]), rnd.random() < 0.4) for _ in range(300)]
    r = agg.auc(spark.createDataFrame([*rows, (None, True)], "s double, p boolean"), "s", F.col("p")).first()
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    assert r["auc"] == pytest.approx(want)
    assert agg.auc(spark.createDataFrame([(1.0, True)], "s double, p boolean"), "s", F.col("p")).first()["auc"] is None


def test_confusion_and_weights(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (None, 1)], "t int, p int")
    r = {x["cls"]: x for x in agg.confusion(d, "t", "p").collect()}
    assert (r[1]["support"], r[1]["predicted"], r[1]["hits"]) == (2, 3, 2) and r[2]["precision"] is None and r[1]["recall"] == 1.0
    assert {x["cls"]: x["weight"] for x in agg.class_weights(d, "t").collect()}[2] == pytest.approx(5 / 3)


def test_region_filter_and_articles(spark):
    schema = "GlobalEventID string, DATEADDED string, EventRootCode string, SOURCEURL string, ActionGeo_FullName string, ActionGeo_CountryCode string, ActionGeo_Lat double, ActionGeo_Long double, NumArticles double, GoldsteinScale double, AvgTone double"
    rows = [
        ("1", "20150301001000", "19", "http://x/a", "Gulf", "AE", 25.0, 55.0, 3.0, -5.0, -4.0),
        ("2", "20150301001000", "19", "http://x/a", None, None, None, None, 9.0, -7.0, -2.0),
        ("3", "20150301004500", "04", "http://x/strait-of", "London", "UK", 51.0, 0.0, None, 1.0, 1.0),
        ("4", "bad", "19", None, "TANKER row", None, 22.0, 46.0, 1.0, None, None),
        ("5", "20150302000000", "13", "http://x/b", "Paris", "FR", 48.0, 2.0, 2.0, -1.0, None),
    ]
    d = spark.createDataFrame(rows, schema)
    assert {r["GlobalEventID"]: r["region_match"] for r in ev.filter_region(d).collect()} == {"1": "bbox+country", "3": "keyword", "4": "bbox+keyword"}
    c = ev.leg_counts(d).first()
    assert (c["rows_total"], c["leg_bbox"], c["leg_country"], c["leg_keyword"], c["leg_keyword_only"]) == (5, 2, 1, 2, 1)
    f = {str(r["date"]): r for r in ev.daily_features(d).collect()}
    assert set(f) == {"2015-03-01", "2015-03-02"} and f["2015-03-01"]["conflict_articles"] == 1 and f["2015-03-01"]["conflict_rows"] == 2
    t = {r["GlobalEventID"]: r for r in [ev.best_per_article(d).filter("SOURCEURL = 'http://x/a'").first()]}
    assert set(t) == {"2"}
    s = ev.tension(d.withColumn("date", ev.day()), "date").filter("date = '2015-03-01'").first()
    assert s["events"] == 2 and s["articles"] == 1 and s["score"] == pytest.approx(40 / 50 + 0.7 * 35 + 0.2 * 25)
    assert [str(r["slot"]) for r in ev.missing_slots(d).orderBy("slot").collect()][:2] == ["2015-03-01 00:15:00", "2015-03-01 00:30:00"]
    assert ev.missing_slots(d).count() == 94 and ev.missing_slots(d, 16).count() == 2 + 16
    assert ev.filter_region(d.limit(0)).count() == 0 and ev.daily_aggregate(d.limit(0)).count() == 0


SLUGS = {
    "http://a.b/News/Oil-tanker-hit-in-gulf.HTML": "oil tanker hit gulf",
    "http://a.b/x/12345": "",
    "https://a.b/long-headline-about-ships-here/99": "long headline about ships here",
    "http://a.b/a+b+sea+lane": "sea lane",
    "http://a.b": "",
    "http://a.b/%D9%86%D8%A7%D9%82%D9%84%D8%A9-%D9%85%D8%B6%D9%8A%D9%82": "\u0646\u0627\u0642\u0644\u0629 \u0645\u0636\u064a\u0642",
    "http://a.b/one two/three four five six": "three four five six",
    "http://a.b/x;p=1": "",
    "http://a.b/abcd/efgh?q=zzz#frag": "efgh",
    "http://a.b/pilots-guide-tanker-through-narrow-channel/latest-update": "pilots guide tanker through narrow channel",
    "http://a.b/port-closed-after-strong-winds.php": "port closed after strong winds",
    "": "",
}


def test_slugs(spark):
    d = spark.createDataFrame([(u,) for u in SLUGS], "u string")
    got = {r["u"]: r["w"] for r in d.select("u", fn.slug_words(F.col("u")).alias("w")).collect()}
    assert got == SLUGS
    assert spark.createDataFrame([(None,), ("http://a.b/%zz-broken-but-kept-here",)], "u string").select(fn.slug_words(F.col("u")).alias("w")).collect()[0]["w"] is None


def test_scalars(spark):
    d = spark.createDataFrame([(1.0, float("nan"), dt.date(2015, 1, 2), "secretkey", "a | b|"), (None, 2.0, None, "ab", None)], "a double, b double, c date, d string, e string")
    assert [r["json"] for r in fn.json_rows(d.select("a", "b", "c")).collect()] == ['{"a":1.0,"b":null,"c":"2015-01-02"}', '{"a":null,"b":2.0,"c":null}']
    assert [r[0] for r in d.select(fn.redact(F.col("d"))).collect()] == ["*****tkey", "ab"]
    assert [r[0] for r in d.select(fn.routes(F.col("e"))).collect()] == [["a", "b"], []]
    v = spark.createDataFrame([(0.9,), (0.8999,), (0.0,), (None,)], "v double")
    assert [r[0] for r in v.select(fn.coverage_status(F.col("v"))).collect()] == ["FULL", "PARTIAL", "EMPTY", "EMPTY"]
    b = spark.createDataFrame([(5.0,), (5.1,), (9.0,), (9.1,), (None,)], "v double")
    assert [r[0] for r in b.select(fn.band_exclusive(F.col("v"), F.lit(5.0), F.lit(9.0))).collect()] == ["NORMAL", "ELEVATED", "ELEVATED", "HIGH", "UNCALIBRATED"]
    assert [r[0] for r in b.select(fn.band_inclusive(F.col("v"), F.lit(5.0), F.lit(9.0))).collect()][:3] == ["ELEVATED", "ELEVATED", "HIGH"]
    assert b.select(fn.dot(fn.literal_vector([1, 2]), fn.literal_vector([3, 4]))).first()[0] == 11.0


# ------------------------------------------------------------------ rasters


def chip(seed, h=40, w=36):
    r = np.random.default_rng(seed)
    a = r.gamma(2.0, 0.02, (h, w))
    a[5:8, 6:9] = 5.0
    a[20, 20:24] = 4.0
    a[0:2, :] = 0.0
    a[10, 10] = np.nan
    return a


def pixels(spark, arrays):
    rows = [(k, i, j, float(a[i, j]), float(b[i, j])) for k, (a, b) in enumerate(arrays) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "chip long, row int, col int, vv double, vh double")


def numpy_cfar(img, g=2, b=5, k=3.0, least=0.3):
    ok = np.isfinite(img) & (img > 0)
    x = np.where(ok, np.nan_to_num(img), 0.0)

    def box(a, h):
        p = np.pad(a, h)
        return np.array([[p[i : i + 2 * h + 1, j : j + 2 * h + 1].sum() for j in range(a.shape[1])] for i in range(a.shape[0])])

    n, s, q = (box(a, b) - box(a, g) for a in (ok.astype(float), x, x * x))
    n1 = np.where(n > 0, n, 1)
    sd = np.sqrt(np.maximum(q / n1 - (s / n1) ** 2, 0))
    return ok & (n > ((2 * b + 1) ** 2 - (2 * g + 1) ** 2) * least) & (x > s / n1 + k * sd)


def test_cfar_and_objects(spark):
    a = [(chip(1), chip(2)), (chip(3), chip(4))]
    d = pixels(spark, a)
    got = {(r["chip"], r["row"], r["col"]) for r in raster.cfar(d, guard=2, background=5, k=3.0).filter("hit").collect()}
    want = {(k, i, j) for k, (v, _) in enumerate(a) for i, j in zip(*np.nonzero(numpy_cfar(v)))}
    assert got == want and want
    o = raster.objects(raster.cfar(d, guard=2, background=5, k=3.0), least=2).toPandas()
    bar = o[(o.chip == 0) & (o.width_px == 4) & (o.height_px == 1)].iloc[0]
    assert (bar.size_px, bar.row, bar.col, bar.elongation) == (4, 20.0, 21.5, 4.0)
    assert raster.objects(raster.cfar(d.limit(0), guard=2, background=5)).count() == 0
    with pytest.raises(ValueError):
        raster.cfar(d, guard=5, background=5)


def test_labels_equal_flood_fill():
    r = np.random.default_rng(8)
    for _ in range(40):
        m = r.random((r.integers(1, 14), r.integers(1, 14))) < 0.5
        want, n = np.zeros(m.shape, dtype=int), 0
        for i, j in zip(*np.nonzero(m)):
            if want[i, j]:
                continue
            n += 1
            todo = [(i, j)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not want[a, b]:
                    want[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        got, k = raster.label(m)
        assert k == n and (got == want).all()


def test_filters_and_water(spark):
    r = np.random.default_rng(9)
    a = r.normal(size=(20, 17))
    p = np.pad(a, 2, mode="edge")
    want = np.array([[np.median(p[i : i + 5, j : j + 5]) for j in range(17)] for i in range(20)])
    assert np.allclose(raster.median_filter(a, 5), want)
    vv = np.full((60, 60), 0.01) * r.gamma(9, 1 / 9, (60, 60))
    vv[:, 40:] *= 60
    vv[10:12, 10:12] = 3.0
    d = pixels(spark, [(vv, vv), (np.zeros((4, 4)), np.zeros((4, 4)))])
    w = {(r["chip"], r["row"], r["col"]): r["water"] for r in raster.water_masks(d, smooth=5, least_land=50).collect()}
    assert w[0, 30, 10] and not w[0, 30, 55] and w[0, 11, 11] and len(w) == 3616 and not any(v for k, v in w.items() if k[0] == 1)
    port, empty = raster.water_facts(d, smooth=5, least_land=50).orderBy("chip").collect()
    assert port["status"] == "OK" and port["water_frac"] == round(sum(w.values()) / 3600, 4) and port["valid_frac"] == 1.0 and port["land_blobs"] >= 1
    assert empty["status"] == "EMPTY" and empty["threshold_db"] is None and empty["land_blobs"] == 0


def test_closing_and_blobs(spark):
    """Against erosion of a dilation, pixel by pixel."""
    r = np.random.default_rng(12)
    a = np.where(r.random((24, 20)) < 0.55, 3.0, 0.01)
    got = raster.land_pixels(pixels(spark, [(a, a)]), smooth=1, close=3).toPandas()
    hit = {(i, j) for i, j in zip(*np.nonzero(a > 1))}
    square = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    wide = {(i, j) for i in range(24) for j in range(20) if any((i + x, j + y) in hit for x, y in square)}
    want = {(i, j) for i in range(24) for j in range(20) if all((i + x, j + y) in wide for x, y in square)}
    assert {(p.row, p.col) for p in got.itertuples() if p.land} == want
    m = spark.createDataFrame([(0, i, j, True) for i, j in want], "chip long, row int, col int, land boolean")
    lab, n = raster.label(np.array([[(i, j) in want for j in range(20)] for i in range(24)]))
    assert raster.blobs(m, "land").select("blob").distinct().count() == n


def test_otsu_and_histogram(spark):
    r = np.random.default_rng(10)
    x = np.r_[r.normal(0, 1, 300), r.normal(8, 1, 200)]
    d = spark.createDataFrame([(1, float(v)) for v in x] + [(1, None), (1, float("nan"))], "chip int, v double")
    h = agg.histogram(d, ["chip"], "v")
    n = np.histogram(x, 256)[0]
    assert {r_["bin"]: r_["n"] for r_ in h.collect()} == {i: c for i, c in enumerate(n.tolist()) if c}
    assert agg.histogram(d, [], "v", 4).agg(F.sum("n")).first()[0] == 500
    t = agg.otsu(h, ["chip"]).first()["threshold"]  # the first of the empty bins between the two heaps
    assert x[:300].max() - np.ptp(x) / 256 <= t < x[300:].min()


def test_patches(spark):
    v = chip(1)
    d = pixels(spark, [(v, v)])
    c = spark.createDataFrame([(0, 1, 20.0, 18.0), (0, 2, 1.0, 1.0)], "chip long, label int, row double, col double")
    p = raster.patches(d, c, 8, *v.shape).collect()
    assert [r["label"] for r in p] == [1] and len(p[0]["pixels"]) == 64
    assert p[0]["pixels"][0][0] == pytest.approx(min(1, max(0, (10 * np.log10(max(v[16, 14], 1e-6)) + 35) / 40)))


def test_on_water_rounds_half_to_even(spark):
    f = spark.createDataFrame([(0, 2.5, 3.5), (0, 99.0, -4.0)], "chip long, row double, col double")
    m = spark.createDataFrame([(0, 2, 4, True), (0, 9, 0, False)], "chip long, row int, col int, water boolean")
    assert [r["water"] for r in raster.on_water(f, m, 10, 10).orderBy("row").collect()] == [True, False]


def test_market_model(spark):
    a = series(300, 11, 0.05)
    d = frame(spark, a, "brent").withColumn("wti", F.col("brent") * 0.9 + F.rand(1))
    s = market_model.scores(d, ["brent", "wti"], CAL[:1], buffer=20, k=3)
    p = s.orderBy("date").toPandas()
    assert len(p) == a.notna().sum() - 19 and (p.recon_error >= 0).all() and not p.clean.all()
    share = (p[p.clean].recon_error > p.p95[0]).mean()
    assert 0.03 < share < 0.07
    again = market_model.scores(d, ["brent", "wti"], CAL[:1], buffer=20, k=3).orderBy("date").toPandas()
    assert np.allclose(p.recon_error, again.recon_error)
    mine = market_model.scores(d, ["brent", "wti"], CAL[:1], buffer=20, scorer=lambda w, c: w[:, -1, 0]).orderBy("date").toPandas()
    assert mine.recon_error.iloc[-1] == a.dropna().iloc[-1]
    assert market_model.evaluation(s).first()["false_positives"] > 0
    assert market_model.scores(d, ["brent", "wti"], CAL[:1], buffer=2000).filter("recon_error is not null").count() == 0


def test_column_coverage_and_row_mean(spark):
    d = spark.createDataFrame([(DAY, 1.0, None), (DAY + dt.timedelta(1), None, None), (DAY + dt.timedelta(2), 3.0, 5.0)], "date date, a double, b double")
    r = {x["column"]: x for x in agg.coverage_report(d, ["a", "b"]).collect()}
    assert r["a"]["n"] == 2 and r["b"]["share"] == pytest.approx(1 / 3) and r["b"]["first_day"] == DAY + dt.timedelta(2)
    assert [x[0] for x in d.select(agg.row_mean(["a", "b"])).collect()] == [1.0, None, 4.0]


def test_densify_has_every_day(spark):
    a = spark.createDataFrame([(DAY, 1)], "date date, a int")
    b = spark.createDataFrame([(DAY + dt.timedelta(3), 2)], "date date, b int")
    r = ts.densify([a, b]).orderBy("date").collect()
    assert [(x["a"], x["b"]) for x in r] == [(1, None), (None, None), (None, None), (None, 2)]
    assert ts.densify([a.limit(0), b.limit(0)]).count() == 0


def test_negatives_and_date_split(spark):
    m = spark.createDataFrame([(0, i, j, j < 16) for i in range(32) for j in range(32)], "chip long, row int, col int, water boolean")
    o = spark.createDataFrame([(0, 3.0, 3.0)], "chip long, row double, col double")
    n = raster.negatives(m, o, 8, 5, 32, 32).collect()
    assert len(n) == 5 and n[0]["label"] < 0 and all(r["col"] < 16 and not (r["row"] < 8 and r["col"] < 8) and r["row"] >= 4 for r in n)
    assert sorted(map(tuple, n)) == sorted(map(tuple, raster.negatives(m.repartition(3), o, 8, 5, 32, 32).collect()))
    d = spark.createDataFrame([(p, dt.date(2015, 1, k)) for p in "ab" for k in range(1, 5) for _ in range(3)], "port string, date date")
    s = raster.split_by_date(d, ["port"], "date")
    assert s.count() == 24 and {str(r["date"]) for r in s.filter("is_test").collect()} == {"2015-01-04"} and s.filter("is_test").count() == 6


def test_terms(spark):
    d = spark.createDataFrame([("Gulf  of\nOman",), ("gulfofoman",), (None,), ("HORMUZ",)], "t string")
    assert [r[0] for r in d.select(ev.mentions(F.col("t"))).collect()] == [True, False, False, True]
