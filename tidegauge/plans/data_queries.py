"""The queries of problems 1 to 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import anomalies, compaction, grid, proximity, rolling, sketches, trips
from tidegauge.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return trips.found(table(spark, d, "positions"))


def p1_stops(spark: SparkSession, d: str) -> DataFrame:
    v = trips.stops_and_trips(table(spark, d, "positions")).filter("kind = 'stop'")
    return v.select("mmsi", "place", "start_ts", "end_ts", "duration_s", "n_fixes", "lat", "lon")


def p1_trips(spark: SparkSession, d: str) -> DataFrame:
    v = trips.stops_and_trips(table(spark, d, "positions")).filter("kind = 'trip'")
    return v.select("mmsi", "from_place", "to_place", "start_ts", "end_ts", "duration_s", "distance_m")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.found(table(spark, d, "market_daily"))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.daily_grid(table(spark, d, "market_daily"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.found(table(spark, d, "positions"), table(spark, d, "uae_ports"))


def p3_port_pings(spark: SparkSession, d: str) -> DataFrame:
    return proximity.port_calls(table(spark, d, "positions"), table(spark, d, "uae_ports"))


def p4_distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    return sketches.estimates(sketches.distinct_cube(table(spark, d, "event_rows")))


def p4_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The estimates held against exact counts: (level, day, root, n_exact, within) at a confidence of one in a thousand million."""
    e = table(spark, d, "event_rows")
    est = sketches.estimates(sketches.distinct_cube(e), confidence=1 - 1e-9)
    k = sketches.event_keys(e).filter("SOURCEURL is not null")
    n, none = F.count_distinct("SOURCEURL").alias("n_exact"), F.lit(None).cast("string")
    exact = k.agg(n).filter("n_exact > 0").select(F.lit("total").alias("level"), none.alias("day"), none.alias("root"), "n_exact")
    exact = exact.unionAll(k.filter("day is not null").groupBy("day").agg(n).select(F.lit("day"), "day", none, "n_exact"))
    exact = exact.unionAll(k.filter("root is not null").groupBy("root").agg(n).select(F.lit("root"), none, "root", "n_exact"))
    exact = exact.unionAll(k.filter("day is not null and root is not null").groupBy("day", "root").agg(n).select(F.lit("day_root"), "day", "root", "n_exact"))
    key = lambda x: F.concat_ws("|", x["level"], F.coalesce(x["day"], F.lit("-")), F.coalesce(x["root"], F.lit("-")))
    a, b = exact.withColumn("k", key(exact)), est.withColumn("k", key(est)).select("k", "low", "high")
    j = a.join(b, "k", "full")
    return j.select("level", "day", "root", "n_exact", F.coalesce(F.col("n_exact").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.found(table(spark, d, "event_rows"), table(spark, d, "positions"), table(spark, d, "slot_files"))


def p5_compact(spark: SparkSession, d: str) -> DataFrame:
    c = compaction.compact_all(table(spark, d, "event_rows"), table(spark, d, "positions"), table(spark, d, "slot_files"))
    return c.groupBy("dataset").agg(F.sum("rows_out").alias("rows_out"), F.sum("files").alias("files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.found(table(spark, d, "positions"), table(spark, d, "market_daily"))


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.flag(table(spark, d, "positions"), table(spark, d, "market_daily"))


def p7_market(spark: SparkSession, d: str) -> DataFrame:
    return rolling.market(table(spark, d, "market_daily"))


def p7_events(spark: SparkSession, d: str) -> DataFrame:
    return rolling.events(table(spark, d, "event_rows"))


def p7_market_run_out(spark: SparkSession, d: str) -> DataFrame:
    return rolling.market(table(spark, d, "market_daily"), run_out=True)


def p7_events_run_out(spark: SparkSession, d: str) -> DataFrame:
    return rolling.events(table(spark, d, "event_rows"), run_out=True)


QUERIES = {f.__name__: f for f in (
    p1_found, p1_stops, p1_trips, p2_found, p2_grid, p3_found, p3_port_pings, p4_distinct_urls, p4_within_bounds, p5_found, p5_compact, p6_found, p6_reasons, p7_events, p7_market,
    p7_events_run_out, p7_market_run_out,
)}

_READINGS = """r as (
  select series_id, cast(date as date) as d, value, obs_id from market_daily
  where value is not null and not isnan(value) and series_id is not null and date is not null),
life as (select series_id, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from r group by 1)"""

_NEAR = """near as (
  select p.msg_id, u.name as port_name from positions p join uae_ports u
  on p.lat between -90 and 90 and p.lon between -180 and 180 and u.latitude between -90 and 90 and u.longitude between -180 and 180
  and 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(u.latitude - p.lat) / 2), 2)
      + cos(radians(p.lat)) * cos(radians(u.latitude)) * pow(sin(radians(u.longitude - p.lon) / 2), 2)))) <= 5)"""


def _trailing(source: str, keys: str) -> str:
    """Windows of 7 and 30 days over ``source`` (keys, d, v)."""
    cols = ", ".join(
        f"cast(coalesce(sum(n) over w{w}, 0) as bigint) as n_{w}, round(coalesce(sum(s) over w{w}, 0), 4) as sum_{w}, "
        f"round(coalesce(sum(s) over w{w}, 0), 4) / nullif(sum(n) over w{w}, 0) as avg_{w}, min(lo) over w{w} as min_{w}, max(hi) over w{w} as max_{w}"
        for w in (7, 30)
    )
    return f"""with src as ({source}),
x as (select {keys}, d, sum(v) as s, count(v) as n, min(v) as lo, max(v) as hi from src group by all),
life as (select {keys}, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from x group by {keys}),
y as (select life.*, s, n, lo, hi from life left join x using ({keys}, d))
select {keys}, d as day, {cols} from y
window w7 as (partition by {keys} order by d rows between 6 preceding and current row),
       w30 as (partition by {keys} order by d rows between 29 preceding and current row)"""


_EVENT_GROUPS = """with_day as (
  select cast(try_strptime(DATEADDED, '%Y%m%d%H%M%S') as date) as d, case when length(trim(EventRootCode)) < 2 then lpad(trim(EventRootCode), 2, '0') else trim(EventRootCode) end as root, ActionGeo_CountryCode as country,
         GoldsteinScale, AvgTone from event_rows),
groups as (select d, 'root' as kind, root as entity, GoldsteinScale, AvgTone from with_day union all
           select d, 'country', country, GoldsteinScale, AvgTone from with_day)
select kind, entity, 'GoldsteinScale' as measure, d, GoldsteinScale as v from groups where d is not null and entity is not null and GoldsteinScale is not null and not isnan(GoldsteinScale)
union all
select kind, entity, 'AvgTone', d, AvgTone from groups where d is not null and entity is not null and AvgTone is not null and not isnan(AvgTone)"""



def _spikes(steps: str, longest: int, up: str, down: str) -> str:
    """Steps (src, i, lo, hi, first, last, lim) in blocks of at most ``longest`` on one side of the steps before and after.

    ``up`` and ``down`` are conditions on {x} and the reference {r}."""
    parts = []
    for k in range(1, longest + 1):
        low, high = (f"{f}({c}) over (partition by src order by i rows between current row and {k - 1} following)" for f, c in (("min", "lo"), ("max", "hi")))
        one = lambda cond, x: " and ".join(f"({cond.format(x=x, r=r)})" for r in ("b", "a"))
        parts.append(f"""select src, i, bool_or(h) over (partition by src order by i rows between {k - 1} preceding and current row) as h from (
  select src, i, coalesce(({one(up, "l")}) or ({one(down, "g")}), false) as h from (
    select src, i, lim, {low} as l, {high} as g, lag(last) over (partition by src order by i) as b, lead(first, {k}) over (partition by src order by i) as a from {steps}))""")
    return "select distinct src, i from (" + "\nunion all\n".join(parts) + ") where h"


def _runs(table_: str, least: int, at: str) -> str:
    """Rows in runs of at least ``least`` equal readings."""
    return f"""select id, v from (select id, v, count(*) over (partition by src, g) as n from (
  select *, sum(case when v is distinct from pv then 1 else 0 end) over (partition by src order by ts, id) as g from (
    select *, lag(v) over (partition by src order by ts, id) as pv from {table_}))) where n >= {least} {at}"""


_P6 = f"""with sog as (select mmsi as src, ts_utc as ts, msg_id as id, sog as v from positions where mmsi is not null and ts_utc is not null and sog is not null and not isnan(sog)),
dr as (select mmsi as src, ts_utc as ts, msg_id as id, draught as v from positions where mmsi is not null and ts_utc is not null and draught is not null and not isnan(draught)),
va as (select series_id as src, date as ts, obs_id as id, value as v from market_daily where series_id is not null and date is not null and value is not null and not isnan(value)),
p95 as (select src, quantile_cont(v, 0.95) as lim from sog where v between 2 and 60 group by 1),
dstep as (select *, sum(case when ts is distinct from pt or v is distinct from pv then 1 else 0 end) over (partition by src order by ts, id) as i from (
  select *, lag(ts) over w as pt, lag(v) over w as pv from dr window w as (partition by src order by ts, id))),
dsteps as (select src, i, v as lo, v as hi, v as first, v as last, 0.0 as lim from dstep group by all),
vday as (select src, cast(ts as date) as d, min(v) as lo, max(v) as hi, first(v order by ts, id) as first, last(v order by ts, id) as last from va group by 1, 2),
mac as (select src, median(abs(c)) as lim from (select src, last - lag(last) over (partition by src order by d) as c from vday) where c is not null group by 1),
vsteps as (select vday.src, row_number() over (partition by vday.src order by d) as i, d, lo, hi, first, last, lim from vday join mac using (src)),
dspikes as ({_spikes("dsteps", 5, "{x} - {r} > 0.4 * abs({r})", "{r} - {x} > 0.4 * abs({r})")}),
vspikes as ({_spikes("vsteps", 3, "{x} - {r} > 8.0 * lim", "{r} - {x} > 8.0 * lim")})
select 'positions' as tbl, 'sog' as field, id as row_id from (select id from sog left join p95 using (src) where v < 0 or v > 60 or v > 2 * lim union select id from ({_runs("sog", 15, "and v >= 2")}))
union all select 'positions', 'draught', id from (select id from dr where v <= 0 or v > 25 union select id from dstep join dspikes using (src, i))
union all select 'market_daily', 'value', id from (select id from va where v <= 0 union select id from va join vsteps on va.src = vsteps.src and cast(va.ts as date) = vsteps.d join vspikes on vspikes.src = vsteps.src and vspikes.i = vsteps.i union select id from ({_runs("va", 10, "")}))"""

_P6_HEAD = _P6[: _P6.index("select 'positions' as tbl, 'sog'")]
_P6_REASONS = f"""{_P6_HEAD.rstrip()},
hits as (select 'positions' as tbl, 'sog' as field, id, 1 as c from sog where v < 0 or v > 60
 union all select 'positions', 'sog', id, 2 from sog join p95 using (src) where v > 2 * lim
 union all select 'positions', 'sog', id, 3 from ({_runs("sog", 15, "and v >= 2")})
 union all select 'positions', 'draught', id, 1 from dr where v <= 0 or v > 25
 union all select 'positions', 'draught', id, 4 from dstep join dspikes using (src, i)
 union all select 'market_daily', 'value', id, 1 from va where v <= 0
 union all select 'market_daily', 'value', id, 3 from ({_runs("va", 10, "")})
 union all select 'market_daily', 'value', id, 4 from va join vsteps on va.src = vsteps.src and cast(va.ts as date) = vsteps.d join vspikes on vspikes.src = vsteps.src and vspikes.i = vsteps.i)
select tbl, field, id as row_id, case min(c) when 1 then 'impossible' when 2 then 'above_own_range' when 3 then 'stuck' else 'spike' end as reason from hits group by 1, 2, 3"""
_URLS = """k as (select strftime(cast(try_strptime(DATEADDED, '%Y%m%d%H%M%S') as date), '%Y-%m-%d') as day, case when length(trim(EventRootCode)) < 2 then lpad(trim(EventRootCode), 2, '0') else trim(EventRootCode) end as root, SOURCEURL as u from event_rows where SOURCEURL is not null)"""

ORACLES = {
    "p6_found": _P6,
    "p6_reasons": _P6_REASONS,
    "p4_within_bounds": f"""with {_URLS} select 'total' as level, cast(null as varchar) as day, cast(null as varchar) as root, count(distinct u) as n_exact, true as within from k having count(*) > 0
union all select 'day', day, null, count(distinct u), true from k where day is not null group by 2 union all select 'root', null, root, count(distinct u), true from k where root is not null group by 3
union all select 'day_root', day, root, count(distinct u), true from k where day is not null and root is not null group by 2, 3""",
    "p2_found": f"""with {_READINGS}
select life.series_id, strftime(life.d, '%Y-%m-%d') as day from life anti join r on r.series_id = life.series_id and r.d = life.d""",
    "p2_grid": f"""with {_READINGS},
v as (select series_id, d, arg_max(value, obs_id) as value, count(*) as n from r group by 1, 2),
g as (select life.series_id, life.d, v.value, coalesce(n, 0) as n, v.n is null as missing,
        max(case when v.n is not null then life.d end) over (partition by life.series_id order by life.d) as last_day
      from life left join v on v.series_id = life.series_id and v.d = life.d)
select series_id, d as day, value, cast(n as bigint) as n_readings, missing, last_day, cast(d - last_day as integer) as gap_days from g""",
    "p3_found": f"with {_NEAR} select msg_id, port_name from near",
    "p3_port_pings": f"with {_NEAR} select port_name, count(*) as pings from near group by 1",
    "p5_found": """with r as (
  select distinct 0 as ds, GlobalEventID as k, cast(null as timestamp) as t, src_file as f from event_rows where GlobalEventID is not null
  union all select distinct 1, mmsi, ts_utc, src_file from positions where mmsi is not null and ts_utc is not null)
select distinct a.f as file_a, b.f as file_b from r a join r b on a.ds = b.ds and a.k = b.k and a.t is not distinct from b.t and a.f < b.f""",
    "p5_compact": """with f as (select dataset, count(*) as files from slot_files group by 1)
select dataset, cast(case dataset when 'events' then (select count(distinct GlobalEventID) from event_rows)
  else (select count(*) from (select distinct mmsi, ts_utc from positions)) end as bigint) as rows_out, files from f""",
    "p7_market": _trailing("select series_id, cast(date as date) as d, value as v from market_daily where value is not null and not isnan(value) and date is not null", "series_id"),
    "p7_events": _trailing("with " + _EVENT_GROUPS, "kind, entity, measure"),
}
