import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegauge import api
from tidegauge.plans import dag, semantic
from tidegauge.sources import files
from tidegauge.streaming import slots


def line(i, n=61, url="http://x/strait-news"):
    f = [""] * 61
    f[0], f[1], f[28], f[-2], f[-1] = str(i), "20150301", "19", "20150301001500", url
    return "\t".join((f + ["extra"] * 5)[:n])


def test_raw_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "\n".join([line(1), line(2, 64), line(3, 40), 'quo"te\t' + line(4)[6:]]) + "\n")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    d = files.read_event_zips(spark, f"{tmp_path}/*.zip")
    got = {r["GlobalEventID"]: r["SOURCEURL"] for r in d.collect()}
    assert set(got) == {"1", "3", 'quo"te'} and got["3"] is None
    (tmp_path / "t.tsv").write_text(line(7) + "\n")
    assert files.read_event_tsv(spark, f"{tmp_path}/t.tsv").first()["DATEADDED"] == "20150301001500"


def test_schema_guard(spark):
    good = files.parse_lines(spark.createDataFrame([(line(i),) for i in range(30)], "value string"))
    files.validate(good)
    files.validate(good.limit(0))
    with pytest.raises(files.SchemaError):
        files.validate(good.select(*good.columns[1:], good.columns[0]))
    shifted = good.select(*(F.col(c).alias(d) for c, d in zip([*good.columns[1:], good.columns[0]], good.columns)))
    with pytest.raises(files.SchemaError):
        files.validate(shifted)
    assert files.column_gaps(good, ["globaleventid", "nope"]) == [("globaleventid", "GlobalEventID"), ("nope", None)]


def test_small_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"port": "x", "n": {"k": 1}}, {"port": "y", "n": {"k": 2}}]))
    assert files.read_json_records(spark, f"{tmp_path}/a.json").select("n.k").count() == 2
    (tmp_path / "p.csv").write_text("name,emirate,coast_side,hormuz_dependent,type,role,primary_routes,latitude,longitude,coord_precision\nA,e,Gulf,True,t,r,x | y,1.5,,exact\n")
    p = files.read_ports(spark, f"{tmp_path}/none.csv", f"{tmp_path}/p.csv").first()
    assert p["routes"] == ["x", "y"] and p["longitude"] is None and p["hormuz_dependent"]
    with pytest.raises(FileNotFoundError):
        files.read_ports(spark, f"{tmp_path}/none.csv")
    o = spark.createDataFrame([('{"observations":[{"date":"2015-01-02","value":"."},{"date":"2015-01-03","value":"4.5"},{"date":"bad","value":"1"}]}',)], "j string")
    assert [tuple(r) for r in files.parse_observations(o, "j", F.lit("S")).collect()] == [("S", dt.date(2015, 1, 3), 4.5)]
    m = [{"MessageType": "PositionReport", "MetaData": {"MMSI": "1", "ShipName": " A "}, "Message": {"PositionReport": {"Latitude": 1.0, "Longitude": 2.0, "Sog": 3.0}}}, {"MessageType": "Other", "MetaData": {"MMSI": "1"}}, {"MessageType": "ShipStaticData", "MetaData": {"MMSI": "2", "latitude": 5.0}, "Message": {"ShipStaticData": {"Destination": " ", "MaximumStaticDraught": 0.0}}}]
    a = files.parse_ais(spark.createDataFrame([(json.dumps(x),) for x in m], "j string"), "j", F.lit(dt.datetime(2015, 1, 1))).orderBy("mmsi").collect()
    assert [(r["mmsi"], r["lat"], r["name"], r["destination"], r["draught"]) for r in a] == [("1", 1.0, "A", None, None), ("2", 5.0, None, None, None)]
    d = spark.createDataFrame([("1", 5)], "k string, v int")
    assert files.queue_rows(d, "k").first()["value"] == '{"k":"1","v":5}'
    import numpy as np

    np.save(tmp_path / "c.npy", np.arange(6.0).reshape(2, 3))
    px = files.read_pixels(spark, f"{tmp_path}/*.npy", lambda raw: (np.load(io.BytesIO(raw)),) * 2)
    assert px.filter("row = 1 and col = 2").first()["vv"] == 5.0


def test_stores(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a = spark.createDataFrame([("1", dt.date(2015, 1, 1)), ("2", dt.date(2015, 1, 2))], "k string, dt date")
    files.write_slots(a, root)
    files.write_slots(spark.createDataFrame([("3", dt.date(2015, 1, 2))], "k string, dt date"), root)
    assert sorted(r["k"] for r in spark.read.parquet(root).collect()) == ["1", "3"]
    assert [r["k"] for r in files.read_partitioned(spark, root, start="2015-01-02").collect()] == ["3"]
    assert [r["k"] for r in files.not_stored(spark.createDataFrame([("3",), ("4",)], "k string"), root, ["k"]).collect()] == ["4"]
    assert files.not_stored(a, root + "none", ["k"]).count() == 2
    assert {r["k"] for r in files.newest_files(spark, root, 1, 8).collect()} == {"3"}
    files.append_json(a, root + "j")
    files.append_json(a, root + "j")
    assert spark.read.json(root + "j").count() == 4
    files.consolidate(a, root + "c", ["k"])
    assert spark.read.parquet(root + "c").count() == 2
    with pytest.raises(FileNotFoundError):
        files.newest_files(spark, root + "c")
    files.report({"n": 1}, spark, root + "r")
    assert json.loads(spark.read.text(root + "r").first()[0]) == {"n": 1}
    v = {r["name"]: r for r in files.volumes(spark, {"s": f"{tmp_path}/s/*/*.parquet", "none": f"{tmp_path}/zz*"}).collect()}
    assert v["s"]["files"] == 2 and v["s"]["bytes"] > 0 and v["none"]["files"] == 0


def test_slots_twice_leave_the_store_as_it_was(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/event_rows.parquet")
    root = f"file://{tmp_path}"
    for k in range(2):
        e.repartition(3).write.mode("append").parquet(f"{root}/in")
        slots.run_slots(slots.file_stream(spark, f"{root}/in", e.schema, 2), f"{root}/store", f"{root}/scores", f"{root}/cp")
        got = spark.read.parquet(f"{root}/store")
        want = slots.transform_slot(e).filter("dt is not null").select("GlobalEventID", "DATEADDED").distinct()
        assert got.count() == want.count() == got.select("GlobalEventID", "DATEADDED").distinct().count()
    s = spark.read.parquet(f"{root}/scores")
    batch = slots.slot_scores(got)
    assert s.count() == batch.count() and s.agg(F.sum("events")).first() == batch.agg(F.sum("events")).first()


def test_stored_rows_are_not_written_again(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/event_rows.parquet")
    root = f"file://{tmp_path}"
    for k in range(2):
        e.coalesce(1).write.mode("append").parquet(f"{root}/in")
        slots.run_slots(slots.file_stream(spark, f"{root}/in", e.schema), f"{root}/store", f"{root}/scores", f"{root}/cp")
        stored = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
        if k:
            assert stored == first
        first = stored
    assert first


def test_due_slots(spark):
    at = lambda *x: dt.datetime(2015, 3, 1, *x)
    rows = [(at(10, 0), at(10, 33, 59)), (at(10, 0), at(10, 34, 0)), (at(10, 0), at(10, 20)), (at(10, 7), at(11, 4, 5)), (None, at(11))]
    d = spark.createDataFrame(rows, "last timestamp_ntz, now timestamp_ntz")
    got = [[x.minute for x in r[0]] for r in d.select(slots.due_slots(F.col("last"), F.col("now"))).collect()]
    assert got == [[], [15], [], [15, 30, 45], []]


def test_heartbeat_flush_and_snapshot(spark, sf, tmp_path):
    root = f"file://{tmp_path}"
    p = spark.read.parquet(f"{sf}/positions.parquet").limit(200)
    p.repartition(3).write.parquet(f"{root}/in")
    beat, sizes = slots.Heartbeat(spark, f"{root}/beats"), []
    spark.streams.addListener(beat)
    try:
        q = slots.flushed(slots.file_stream(spark, f"{root}/in", p.schema, 1), lambda df, i: sizes.append(df.count()), f"{root}/cp")
        assert q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(beat)
    assert len(sizes) == 3 and sum(sizes) == 200  # by count: a file a flush
    beats = spark.read.json(f"{root}/beats").collect()
    assert beat.beats >= 3 and sum(r["rows"] for r in beats) == 200
    for k in (50, 200):
        slots.write_snapshot(p.limit(k), f"{root}/snap")
    assert slots.read_snapshot(spark, f"{root}/snap").agg(F.sum("n")).first()[0] == 200


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tidegauge import session

    class Sc:
        def __init__(self, master):
            self.master = master
            self._jsc = self

        def __getattr__(self, name):
            return lambda *a: self

        def isEmpty(self):
            return True

        def get(self, *a):
            return None

    class Session:
        sparkContext = Sc("spark://x:7077")

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    d = session.written(spark.range(3), "t")
    folder = session.run_dir(spark)
    assert d.count() == 3 and files.exists(spark, folder) and session.release(spark) and not files.exists(spark, folder)


def test_stream_counts_state_and_positions(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/event_rows.parquet")
    root = f"file://{tmp_path}"
    e.coalesce(1).write.parquet(f"{root}/in")
    src = slots.file_stream(spark, f"{root}/in", e.schema)
    q = slots.windowed_counts(src, once_by=["GlobalEventID", "DATEADDED"]).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{root}/c1").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("w").count() > 0 and slots.throughput(q)["rows"] > 0
    p = spark.read.parquet(f"{sf}/positions.parquet")
    p.limit(500).coalesce(1).write.parquet(f"{root}/pos")
    ps = slots.file_stream(spark, f"{root}/pos", p.schema)
    q = slots.vessel_state(ps, 3600).writeStream.format("memory").queryName("v").outputMode("update").option("checkpointLocation", f"{root}/c2").trigger(availableNow=True).start()
    ended = q.awaitTermination(60)
    q.stop()
    assert ended
    v = spark.table("v")
    got = {r["mmsi"]: (r["n"], r["name"]) for r in v.filter("not stalled").collect()}
    want = {r["mmsi"]: (r["n"], r["name"]) for r in slots.vessel_snapshot(spark.read.parquet(f"{root}/pos")).collect()}
    assert got == want and v.filter("stalled").count() > 0
    slots.store_positions(ps, f"{root}/store", f"{root}/c3")
    assert spark.read.parquet(f"{root}/store").count() == 500


def test_dag():
    a = (dag.Stage("c", ("b",)), dag.Stage("b", ("a", "unknown")), dag.Stage("a"))
    assert dag.order(a) == ["a", "b", "c"] and dag.order(a, ["b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        dag.order((dag.Stage("a", ("b",)), dag.Stage("b", ("a",))))
    ran = []
    def fail():
        raise RuntimeError("no")
    st = (dag.Stage("in", outputs=("i",)), dag.Stage("x", ("in",), ("i",), ("x",), run=lambda: ran.append("x")), dag.Stage("g", ("x",), ("x",), ("g",), gate=True, run=fail), dag.Stage("z", ("g",), ("x",), ("z",)))
    t = {"i": 5.0, "x": 1.0}
    log = dag.run(st, t.get, t.get)
    assert log == [("in", "fresh"), ("x", "ran"), ("g", "gate failed: no")] and ran == ["x"]
    assert dag.state(st[1], {"i": 5.0}.get, {"x": 6.0}.get) == "fresh" and dag.state(st[1], {}.get, {}.get) == "missing-input"


def test_bound_stages(spark, sf01, tmp_path, monkeypatch):
    from tidegauge.operators import fusion
    from tidegauge.plans import pipeline

    out = f"file://{tmp_path}"
    assert {x for _, x in pipeline.run(spark, sf01, out)} == {"ran"}
    assert spark.read.parquet(f"{out}/panel").count() > 0 and spark.read.parquet(f"{out}/backtest").count() == 5
    assert {x for _, x in pipeline.run(spark, sf01, out)} == {"fresh"}
    assert dict(pipeline.run(spark, sf01, out, ["slugs"])) == {"events": "fresh", "slugs": "fresh"}
    monkeypatch.setattr(fusion, "leakage", lambda p: p.limit(2))  # a gate that finds something stops the run
    log = pipeline.run(spark, sf01, out, ["events", "market", "chips", "leakage", "market_scores"], force=True)
    assert log[-1] == ("leakage", "gate failed: 2 rows of leakage")


def test_registry_and_service(spark, sf01):
    assert semantic.resolve("sar_vessels_x") == "sar_vessels_<port>" and semantic.resolve("sar_vessels_") is None
    assert api.semantic_audit(spark, sf01).filter("not defined").count() == 0
    assert semantic.metrics(spark, "fusion").count() == 4
    with pytest.raises(KeyError):
        semantic.metric(spark, "nope")
    assert api.features(spark, sf01, "2014-01-01", "2014-01-31", ["brent"]).count() == 31
    with pytest.raises(ValueError):
        api.features(spark, sf01, columns=["brent; drop"])
    assert {r["status"] for r in api.freshness(spark, sf01, "2015-03-06 00:30:00").collect()} <= {"CURRENT", "STALE"}
    assert api.arm_events(spark, sf01).count() > 0 and api.risk(spark, sf01).count() > 0
    assert api.predict_market(spark, sf01).count() == 1 and api.brief(spark, sf01).count() == 1
    r = api.predict_text(spark, [[1.0, 0.0]], [[1.0, 0.0]], [[0.0, 1.0]], 0.5, 0.9).first()
    assert r["score"] == 1.0 and r["band"] == "HIGH"
    with pytest.raises(ValueError):
        api.predict_text(spark, [], [[1.0]], [[1.0]])
    with pytest.raises(NotImplementedError):
        api.vessels(spark, sf01)
    assert api.recent_titles(spark, sf01, 5).count() == 5 and api.sources(spark, sf01).count() == 11
    assert api.pipeline(spark).count() == len(dag.STAGES) and api.pipeline_volumes(spark, sf01).count() == 4
    assert api.health(spark).count() == api.streaming_facts(spark).count() == 1 and api.event_calendar(spark).count() == 5
