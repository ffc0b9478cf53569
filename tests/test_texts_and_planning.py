import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import intervals, planning
from tidegauge.operators import text_features as tf


def test_contrast_and_daily(spark):
    rows = [("u1", tf.DISRUPTION[2], "en", 1), ("u2", tf.CALM[0], "en", 1), ("u3", None, None, 1), ("u4", "", "fr", 1), ("u5", "mines have been laid", None, 2)]
    d = spark.createDataFrame([(u, t, x, dt.date(2015, 1, k)) for u, t, x, k in rows], "url string, title string, lang string, date date")
    s = tf.contrast(d, "title")
    got = {r["url"]: r for r in s.collect()}
    assert got["u1"]["sim_disruption"] == pytest.approx(1.0) and got["u1"]["chokepoint_score"] > 0 > got["u2"]["chokepoint_score"]
    assert got["u3"]["chokepoint_score"] is None and got["u4"]["chokepoint_score"] == 0
    f = {r["date"].day: r for r in tf.daily(s, "lang", k=1).collect()}
    assert f[1]["n"] == 3 and f[1]["top10"] == pytest.approx(got["u1"]["chokepoint_score"]) and f[1]["n_nonenglish"] == 1 and f[2]["n_nonenglish"] == 1
    assert f[1]["share_above_0"] == pytest.approx(1 / 3)
    assert tf.contrast(d.limit(0), "title").count() == 0


def test_encoder_interface_and_cache(spark):
    v = tf.hashed_encoder(["a b c", "a b c", "", "x"])
    assert np.allclose(v[0], v[1]) and np.linalg.norm(v[0]) == pytest.approx(1) and not v[2].any()
    texts = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", None)], "url string, text string")
    one = tf.encode_new(texts, spark.createDataFrame([("u1",)], "url string")).collect()
    assert [r["url"] for r in one] == ["u2"] and len(one[0]["vec"]) == 384


def test_slug_corpus_takes_each_article_once(spark):
    e = spark.createDataFrame([("http://x/a-big-ship-sank-near-port", "20150302000000"), ("http://x/a-big-ship-sank-near-port", "20150301000000"), ("http://x/1", "20150301000000"), (None, "20150301000000"), ("http://x/other-long-words-here-now", "bad")], "SOURCEURL string, DATEADDED string")
    r = tf.slug_corpus(e).collect()
    assert [(x["text"], str(x["date"]), x["n_words"]) for x in r] == [("big ship sank near port", "2015-03-01", 5)]
    assert tf.slug_features(e).count() == 1


def test_planning(spark):
    at = lambda d, h: dt.datetime(2015, 1, d, h)
    s = spark.createDataFrame([(1, "p", at(1, 5)), (1, "p", at(1, 5)), (2, "p", at(1, 3)), (3, "q", at(2, 1)), (4, "p", at(9, 1)), (5, "p", None)], "id int, port string, acquired timestamp_ntz")
    assert [r["id"] for r in planning.catalogue(s).collect()] == [4, 3, 1, 2, 5]
    cal = (intervals.period("w", "2015-01-01", "2015-01-05"),)
    assert sorted((r["port"], r["id"]) for r in planning.plan(s, cal).collect()) == [("p", 2), ("q", 3)]
    assert planning.pass_days(s).count() == 3
    c = planning.cost(planning.pass_days(s), planning.pass_days(s).filter("port = 'q'"), ["port", "day"], 2.0).first()
    assert (c["planned"], c["missing"], c["cost"]) == (3, 2, 4.0)
    assert planning.search_chunks((intervals.period("w", "2015-01-01", "2015-03-01"),)) == [("w", dt.date(2015, 1, 1), dt.date(2015, 2, 14)), ("w", dt.date(2015, 2, 15), dt.date(2015, 3, 1))]
    assert planning.chip_cost(512) == pytest.approx(10 / 3) and planning.chip_cost(256) == pytest.approx(0.8333, abs=1e-3)
    d = spark.createDataFrame([("p", 1, 5), ("p", 2, 7)], "port string, k int, n int")
    got = planning.with_detections(s.select("port").distinct(), d, "k", ["port"]).orderBy("port").collect()
    assert [(r["port"], r["n"]) for r in got] == [("p", 7), ("q", None)]
    p = spark.createDataFrame([(dt.date(2015, 1, 2), 1.0, None), (dt.date(2015, 1, 3), None, None), (dt.date(2015, 2, 3), 1.0, 2.0)], "date date, a double, b double")
    w = planning.window_coverage(p, cal, ["a", "b"]).first()
    assert (w["window"], w["days"], w["covered"]) == ("w", 5, 1)


def test_boxes():
    one = [[22, 46], [31, 60]]
    assert planning.checked_boxes(one) == planning.checked_boxes([one]) == [[[22.0, 46.0], [31.0, 60.0]]]
    for bad in ([22, 46, 31, 60], [[[22, 46]]], [[[22, 46, 1], [31, 60, 1]]], [[[122, 46], [31, 60]]], [], [[one]]):
        with pytest.raises(ValueError):
            planning.checked_boxes(bad)
