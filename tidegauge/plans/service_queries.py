"""Queries of the service functions, the models and the streams."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidegauge import api
from tidegauge.operators import aggregates, fusion, intervals, market_model, planning, text_features
from tidegauge.operators import events as ev
from tidegauge.plans import core_queries as q
from tidegauge.plans import pipeline, semantic
from tidegauge.session import run_dir, table
from tidegauge.sources import payloads
from tidegauge.streaming import slots

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


@query()
def registry_audit(spark, d):
    return api.semantic_audit(spark, d)


@query("""select name, case when name like 'sar_vessels_%' and length(name) > 12 then 'sar_vessels_<port>' when name like 'rank_%' and length(name) > 5 then 'rank_<arm>' when name in ('brent', 'risk_index') then name end as metric
from (values ('sar_vessels_north'), ('rank_arm_b'), ('brent'), ('risk_index'), ('unknown_column'), ('rank_')) v(name)""")
def template_match(spark, d):
    names = ["sar_vessels_north", "rank_arm_b", "brent", "risk_index", "unknown_column", "rank_"]
    return spark.createDataFrame([(n,) for n in names], "name string").withColumn("metric", semantic.resolved(F.col("name")))


@query()
def semantic_forbidden(spark, d):
    return semantic.forbidden(spark)


@query("""select count(*) as ports, count(*) filter (where hormuz_dependent) as dependent, count(*) filter (where coord_precision = 'approximate') as approximate from uae_ports""")
def port_summary(spark, d):
    return api.port_summary(spark, d).drop("bypass")


@query("""select p.name, trim(x.route) as route from uae_ports p, unnest(string_split(primary_routes, '|')) as x(route)""")
def port_routes(spark, d):
    return api.ports(spark, d).select("name", F.explode("routes").alias("route"))


@query("""select dataset, count(*) as files, cast(sum(n_rows) as bigint) as n_rows, cast(sum(n_bytes) as bigint) as n_bytes, count(*) filter (where n_rows = 0) as empty from slot_files group by 1""")
def store_inventory(spark, d):
    return api.store_inventory(spark, d)


_USABLE = q.SLUG_SQL + ", usable as (select url, words, length(words) - length(replace(words, ' ', '')) + 1 as n from slug where words <> '' and length(words) - length(replace(words, ' ', '')) + 1 >= 4)"


@query(f"""with {_USABLE} select words as text, max(try_strptime(DATEADDED, '%Y%m%d%H%M%S')) as "at" from event_rows join usable on url = SOURCEURL where try_strptime(DATEADDED, '%Y%m%d%H%M%S') is not null group by 1 order by 2 desc, 1 limit 25""")
def recent_titles(spark, d):
    return api.recent_titles(spark, d)


@query("""select cast(row_number() over () - 1 as integer) as position, stage, 'ran' as outcome from (values ('events'), ('market'), ('chips'), ('detections'), ('slugs'), ('panel'), ('leakage'), ('market_scores'), ('evaluation'), ('folds'), ('risk'), ('backtest')) v(stage)""")
def pipeline_run(spark, d):
    """Every stage into a fresh folder, gates and all."""
    log = pipeline.run(spark, d, f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    return spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "position int, stage string, outcome string")


@query(f"""with {q._SPREAD}, s as (select date, spread, spread - lag(spread, 7) over (order by date) as c from sp where spread is not null), l as (select max(date) as d, last(spread order by date) as v from s)
select (select d from l) as as_of, round((select v from l), 4) + 0.0 as value, round(avg(case when spread < (select v from l) then 100.0 else 0.0 end), 4) + 0.0 as percentile, round(last(c order by date), 4) + 0.0 as change_7 from s""")
def brief_facts(spark, d):
    return q.rounded(api.brief(spark, d))


@query()
def pipeline_order(spark, d):
    return api.pipeline(spark)


@query()
def anomaly_pca_scores(spark, d):
    return market_model.scores(q.spread(spark, d), ["brent", "wti", "spread"], q.CAL, q.OTHER, buffer=20)


@query()
def anomaly_evaluation(spark, d):
    return api.models(spark, d)


@query()
def gbm_comparison(spark, d):
    """Out-of-event scores of boosted trees: for each event the days near it are scored by a model of the earlier days."""
    x = q.arms(spark, d).na.drop("any").withColumn("label", intervals.inside(F.col("date"), q.CAL, 30).cast("double"))
    x = x.withColumn("features", array_to_vector(F.array("arm_b", "arm_c", "arm_a")))
    from datetime import timedelta

    out = None
    for p in q.CAL:  # one fold an event
        lo = p.start - timedelta(days=60)
        train, test = x.filter(F.col("date") < F.lit(lo - timedelta(days=10))), x.filter(F.col("date").between(F.lit(lo), F.lit(p.end)))
        if train.select("label").distinct().count() < 2:
            continue  # one class only: nothing to learn
        m = GBTClassifier(maxIter=80, maxDepth=2, stepSize=0.05, seed=42).fit(train)
        one = m.transform(test).select(F.lit(p.name).alias("event"), "date", "label", vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], "event string, date date, label double, score double")


@query()
def rf_baseline(spark, d):
    """A forest over hand-made chip features, trained on the earlier three quarters of tiles, class weights balanced."""
    px = q.chips(spark, d).withColumns({"tile": F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8)})
    t = px.groupBy("chip", "tile").agg(F.avg("vv").alias("m"), F.max("vv").alias("hi"), F.stddev_pop("vv").alias("s"), F.avg("vh").alias("mh"))
    cut = t.agg(F.percentile("hi", F.lit(0.75))).first()[0]
    t = t.withColumn("label", (F.col("hi") > F.lit(cut)).cast("double")).withColumn("features", array_to_vector(F.array("m", "s", "mh")))
    w = aggregates.class_weights(t, "label").select(F.col("cls").alias("label"), "weight")
    t = t.join(F.broadcast(w), "label")  # two rows
    last = t.agg(F.max("chip")).first()[0]
    m = RandomForestClassifier(numTrees=250, weightCol="weight", seed=42).fit(t.filter(F.col("chip") < F.lit(last)))
    s = m.transform(t.filter(F.col("chip") == F.lit(last)))
    return aggregates.confusion(s, "label", "prediction")


_TAGGED = """coalesce(ActionGeo_Lat between 22 and 31 and ActionGeo_Long between 46 and 60, false) or coalesce(ActionGeo_CountryCode in ('IR','AE','MU','SA','QA','KU','BA','IZ'), false)
 or regexp_matches(lower(coalesce(ActionGeo_FullName, '')) || chr(10) || lower(coalesce(SOURCEURL, '')), 'hormuz|strait|fujairah|jebel ali|khor fakkan|tanker|persian gulf|arabian gulf|gulf of oman')"""


@query(f"""with k as (select distinct GlobalEventID, DATEADDED from event_rows where ({_TAGGED}) and try_strptime(DATEADDED, '%Y%m%d%H%M%S') is not null)
select time_bucket(interval 15 minutes, try_strptime(DATEADDED, '%Y%m%d%H%M%S')) as slot, count(*) as n from k group by 1""")
def stream_slot_replay(spark, d):
    """The event table twice through the stream, in day-sized files; the store must hold every row once."""
    root = f"{run_dir(spark)}/replay-{uuid.uuid4().hex}"
    e = table(spark, d, "event_rows")
    part = e.withColumn("p", F.coalesce(F.date_format(ev.published(), "yyyyMMdd"), F.lit("none")))
    for i in (0, 1):  # delivered twice
        part.repartition("p").drop("p").write.mode("append").parquet(f"{root}/in")
        src = slots.file_stream(spark, f"{root}/in", e.schema, per_batch=64)
        slots.run_slots(src, f"{root}/store", f"{root}/scores", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/store").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query("""select mmsi, count(*) as n, min(ts_utc) as first_seen, max(ts_utc) as last_seen from positions where mmsi is not null and ts_utc is not null group by 1""")
def vessel_snapshot(spark, d):
    return slots.vessel_snapshot(table(spark, d, "positions")).select("mmsi", "n", "first_seen", "last_seen")


# ------------------------------------------------------------------ the radar arm, dimensions, evaluation


@query("""with d as (select l_returnflag as port, cast(l_shipdate as date) as date, l_quantity as n from lineitem where 1 - l_discount >= 0.96)
select date, round(avg(n) filter (where port = 'A'), 4) + 0.0 as sar_vessels_A, round(avg(n) filter (where port = 'N'), 4) + 0.0 as sar_vessels_N, round(avg(n) filter (where port = 'R'), 4) + 0.0 as sar_vessels_R
from d group by 1""")
def port_features(spark, d):
    """Vessels per port and day of fully covered chips; order lines stand in for chips, return flags for ports."""
    return q.rounded(fusion.port_features(_radar(spark, d), ["A", "N", "R"], least=0.96))


def _radar(spark, d):
    x = table(spark, d, "lineitem")
    n = F.col("l_quantity").cast("double")
    return x.select(F.col("l_returnflag").alias("port"), F.to_date("l_shipdate").alias("date"), (1 - F.col("l_discount")).alias("coverage"), F.when(F.col("l_linenumber") % 3 > 0, n).alias("n_on_water"), n.alias("n_detections"))


@query(f"""with {q._SPREAD}, r as (select cast(l_shipdate as date) + 7670 as date, round(avg(l_quantity) filter (where l_returnflag = 'A'), 4) + 0.0 as sar_vessels_A, round(avg(l_quantity) filter (where l_returnflag = 'R'), 4) + 0.0 as sar_vessels_R from lineitem where 1 - l_discount >= 0.96 group by 1),
e as (select cast(try_strptime(DATEADDED, '%Y%m%d%H%M%S') as date) as date, count(*) as events_rows, count(distinct SOURCEURL) as events_articles, round(avg(AvgTone), 4) + 0.0 as events_tone from event_rows group by 1 having date is not null),
b as (select date from sp union select date from e union select date from r), c as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from b)
select c.date, round(brent, 4) + 0.0 as brent, round(wti, 4) + 0.0 as wti, round(gas, 4) + 0.0 as gas, round(spread, 4) + 0.0 as brent_wti_spread, events_rows, events_articles, events_tone, sar_vessels_A, sar_vessels_R
from c left join sp using (date) left join e using (date) left join r using (date)""")
def three_arm_panel(spark, d):
    """Market, events and radar on one calendar; the order lines' dates are moved into the years of the other tables."""
    radar = _radar(spark, d).withColumn("date", F.date_add("date", 7670))
    e = ev.daily_features(table(spark, d, "event_rows")).select("date", "events_rows", "events_articles", F.col("tone").alias("events_tone"))
    m = fusion.market_features(q.wide(spark, d)).select("date", "brent", "wti", "gas", "brent_wti_spread")
    return q.rounded(fusion.panel(m, e, fusion.port_features(radar, ["A", "R"], least=0.96)))


@query("""with c as (select distinct o_orderpriority as port, cast(o_orderdate as date) as date from orders), r as (select o_orderpriority as port, cast(o_orderdate as date) as date, arg_max(o_orderkey, o_orderkey) as detection, arg_max(o_totalprice, o_orderkey) as price from orders where o_orderkey % 2 = 1 group by 1, 2)
select port, date, detection, price from c left join r using (port, date)""")
def chips_with_detections(spark, d):
    """The catalogue with the last detection record of each chip, or none."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("port"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("detection"), F.col("o_totalprice").alias("price"))
    return planning.with_detections(o.select("port", "date").distinct(), o.filter("detection % 2 = 1"), "detection")


_DIMENSION = [("brent_spot_usd", "Crude of the North Sea, spot", "benchmark"), ("wti_spot_usd", "Crude of the Gulf Coast, spot", "reference"), ("henry_hub_gas_usd", "Natural gas, spot", "context")]


@query(f"""with dim(label, description, role) as (values {", ".join(map(str, _DIMENSION))})
select series_id, label, description, role, count(*) as n from market_daily join dim using (label) group by all""")
def series_dimension(spark, d):
    dim = spark.createDataFrame(_DIMENSION, "label string, description string, role string")
    m = payloads.describe(table(spark, d, "market_daily").select("series_id", "label"), dim, "label")
    return m.groupBy("series_id", "label", "description", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select GlobalEventID, src_file from event_rows where Day between '20150201' and '20150214' and (coalesce(ActionGeo_Lat between 22 and 31 and ActionGeo_Long between 46 and 60, false) or coalesce(ActionGeo_CountryCode in ('IR','AE','MU','SA','QA','KU','BA','IZ'), false)
 or regexp_matches(lower(coalesce(ActionGeo_FullName, '')) || chr(10) || lower(coalesce(SOURCEURL, '')), 'hormuz|strait|fujairah|jebel\\s+ali|khor\\s+fakkan|tanker|persian\\s+gulf|arabian\\s+gulf|gulf\\s+of\\s+oman'))""")
def event_pull(spark, d):
    return payloads.pull(ev.coerce_numeric(table(spark, d, "event_rows")), "20150201", "20150214").select("GlobalEventID", "src_file")


_SCORED = f"""{q._SPREAD}, {q._CAL}, x as (select date, spread as v, exists (select 1 from cal where sp.date between s - 60 and e + 60) as near, date between date '2014-08-01' and date '2014-09-15' as other from sp where spread is not null),
t as (select quantile_cont(v, 0.95) as p95, quantile_cont(v, 0.99) as p99 from x where not near and not other), y as (select * from x cross join t)"""


def _scored(spark, d):
    """The spread as a score, with flags and thresholds as of the market model."""
    x = q.spread(spark, d).filter("spread is not null").select("date", F.col("spread").alias("recon_error"), intervals.inside(F.col("date"), q.CAL, 60).alias("near_event"), intervals.inside(F.col("date"), q.OTHER).alias("declared_other"))
    return market_model.with_thresholds(x.withColumn("clean", ~F.col("near_event") & ~F.col("declared_other")))


@query(f"""with {_SCORED}, rk as (select v, near, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from y where near or not other),
c as (select v, false as pos from y where not near and not other union all select v, true from y where near), rc as (select pos, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from c),
a as (select (sum(r) filter (where pos) - count(*) filter (where pos) * (count(*) filter (where pos) + 1) / 2.0) / nullif(count(*) filter (where pos) * count(*) filter (where not pos), 0) as auc from rc)
select round(median(v) filter (where not near and not other), 4) + 0.0 as calm_median, round(median(v) filter (where near), 4) + 0.0 as event_median, round(median(v) filter (where other), 4) + 0.0 as other_median,
 round(avg(case when v > p95 then 100.0 else 0.0 end) filter (where not near and not other), 4) + 0.0 as calm_pct_above_p95, round(avg(case when v > p95 then 100.0 else 0.0 end) filter (where near), 4) + 0.0 as event_pct_above_p95,
 round(avg(case when v > p95 then 100.0 else 0.0 end) filter (where other), 4) + 0.0 as other_pct_above_p95, round((select auc from a), 4) + 0.0 as auc_event_vs_calm,
 count(*) filter (where v > p99 and not near and not other) as false_positives, round(100.0 * count(*) filter (where v > p99 and not near and not other) / nullif(count(*), 0), 4) + 0.0 as false_positive_pct,
 coalesce(bool_or(v > p99) filter (where other), false) as other_fires from y""")
def score_evaluation(spark, d):
    return q.rounded(market_model.evaluation(_scored(spark, d)))


@query(f"""with {_SCORED}, p as (select name as event, cal.s as onset, th, date, v, case th when 'p95' then p95 else p99 end as lim from cal left join y on y.date between cal.s - 60 and cal.s cross join (values ('p95'), ('p99')) z(th))
select event, onset, th as threshold, count(v) as n_days, round(max(v), 4) + 0.0 as peak, min(date) filter (where v > lim) as first_cross, cast(onset - min(date) filter (where v > lim) as integer) as lead_days,
 case when count(v) > 0 then count(*) filter (where v > lim) > 0 end as detected from p group by 1, 2, 3""")
def score_lead_times(spark, d):
    return q.rounded(market_model.lead_report(_scored(spark, d), q.CAL))


# ------------------------------------------------------------------ texts and planning


@query(f"""with {_USABLE} select url, cast(min(try_strptime(DATEADDED, '%Y%m%d%H%M%S')) as date) as date, words as text, cast(n as integer) as n_words from event_rows join usable on url = SOURCEURL
 where try_strptime(DATEADDED, '%Y%m%d%H%M%S') is not null group by 1, 3, 4""")
def slug_corpus(spark, d):
    return text_features.slug_corpus(table(spark, d, "event_rows"))


@query()
def slug_features_daily(spark, d):
    return q.rounded(text_features.slug_features(table(spark, d, "event_rows")))


@query()
def headline_features_daily(spark, d):
    return q.rounded(text_features.headline_features(table(spark, d, "documents")))


@query("""with f as (select url, min(cast(seendate as date)) as date from documents where title is not null and seendate is not null and url is not null group by 1
 union all select cast(doc_id as varchar), cast(seendate as date) from documents where title is not null and seendate is not null and url is null)
select date, count(*) as n from f group by 1""")
def headlines_per_day(spark, d):
    h = text_features.headlines(table(spark, d, "documents"))
    return h.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def _scenes(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("port"), (F.col("o_orderdate").cast("timestamp_ntz")).alias("acquired"))


_WINDOWS = (intervals.period("w1", "1995-05-01", "1995-07-15"), intervals.period("w2", "1996-08-15", "1996-10-15"))


@query("""with w(name, s, e) as (values ('w1', date '1995-05-01', date '1995-07-15'), ('w2', date '1996-08-15', date '1996-10-15')),
x as (select name as "window", o_orderpriority as port, cast(o_orderdate as date) as day, o_orderkey as id, row_number() over (partition by name, o_orderpriority, cast(o_orderdate as date) order by o_orderdate, o_orderkey) as r
 from orders join w on cast(o_orderdate as date) between s and e) select "window", port, day, id from x where r = 1""")
def pass_plan(spark, d):
    return planning.plan(_scenes(spark, d), _WINDOWS).select("window", "port", "day", "id")


@query("""select o_orderpriority as port, cast(o_orderdate as date) as day from orders group by 1, 2""")
def pass_days(spark, d):
    return planning.pass_days(_scenes(spark, d))


@query("""with p as (select distinct o_orderpriority as port, cast(o_orderdate as date) as day from orders), s as (select distinct port, day from p where day < date '1997-01-01')
select (select count(*) from p) as planned, (select count(*) from p) - (select count(*) from s) as missing, round(((select count(*) from p) - (select count(*) from s)) * 3.3333, 4) + 0.0 as cost""")
def planned_cost(spark, d):
    p = planning.pass_days(_scenes(spark, d))
    return q.rounded(planning.cost(p, p.filter("day < date'1997-01-01'"), ["port", "day"], 3.3333))


@query(f"""with {q._WIDE} select 'a' as "window", cast(76 as integer) as days, count(*) filter (where coalesce(brent, wti) is not null and date between date '2013-05-01' and date '2013-07-15') as covered from wide
union all select 'b', cast(62 as integer), count(*) filter (where coalesce(brent, wti) is not null and date between date '2014-08-15' and date '2014-10-15') from wide""")
def anchor_window_coverage(spark, d):
    cal = (intervals.period("a", "2013-05-01", "2013-07-15"), intervals.period("b", "2014-08-15", "2014-10-15"))
    return planning.window_coverage(q.wide(spark, d), cal, ["brent", "wti"])
