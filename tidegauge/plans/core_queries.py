"""Queries of the event, market, interval, fusion, text, vector and raster operators, each with SQL of the same meaning.

Doubles that come out of long sums are rounded to 4 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import scalar as fn
from tidegauge.operators import aggregates as agg
from tidegauge.operators import events as ev
from tidegauge.operators import fusion, intervals, raster
from tidegauge.operators import timeseries as ts
from tidegauge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r4(c) for c, t in df.dtypes if t == "double"})


# The labelled calendar of the examples: onsets within the market tables, and a declared other shock.
CAL = (
    intervals.period("ev1", "2013-05-20"), intervals.period("ev2", "2013-09-10", "2013-09-12"), intervals.period("ev3", "2014-01-15"),
    intervals.period("ev4", "2014-05-01", "2014-06-30"), intervals.period("ev5", "2014-11-10", "2014-11-20"),
)
OTHER = (intervals.period("x1", "2014-08-01", "2014-09-15"),)
LABELS = {"brent_spot_usd": "brent", "wti_spot_usd": "wti", "henry_hub_gas_usd": "gas"}

_CAL = "cal(name, s, e) as (values " + ", ".join(f"('{p.name}', date '{p.start}', date '{p.end}')" for p in CAL) + ")"
_WIDE = """mk as (select cast(date as date) as date, label, last(value order by date, obs_id) as v from market_daily
  where value is not null and not isnan(value) and label in ('brent_spot_usd', 'wti_spot_usd', 'henry_hub_gas_usd') group by 1, 2),
wide as (select date, max(case when label = 'brent_spot_usd' then v end) as brent, max(case when label = 'wti_spot_usd' then v end) as wti,
  max(case when label = 'henry_hub_gas_usd' then v end) as gas from mk group by 1)"""
_EV = """ev as (select *, try_strptime(DATEADDED, '%Y%m%d%H%M%S') as t, cast(try_strptime(DATEADDED, '%Y%m%d%H%M%S') as date) as date,
  coalesce(EventRootCode in ('13','14','15','16','17','18','19','20'), false) as c from event_rows)"""


def wide(spark: SparkSession, d: str) -> DataFrame:
    return fusion.market_wide(table(spark, d, "market_daily"), list(LABELS)).withColumnsRenamed(LABELS)


def spread(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).withColumn("spread", F.col("brent") - F.col("wti"))


_SPREAD = _WIDE + ", sp as (select *, brent - wti as spread from wide)"


# ------------------------------------------------------------------ events


@query(f"""with {_EV} select date, count(*) as n_rows, count(distinct SOURCEURL) as articles, round(avg(AvgTone), 4) + 0.0 as tone_mean, round(avg(GoldsteinScale), 4) + 0.0 as goldstein_mean,
 count(*) filter (where c) as conflict_rows, count(distinct SOURCEURL) filter (where c) as conflict_articles from ev group by date""")
def daily_event_aggregate(spark, d):
    return rounded(ev.daily_aggregate(table(spark, d, "event_rows")))


@query(f"""with {_EV} select date, count(*) as events_rows, count(distinct SOURCEURL) as events_articles, round(avg(AvgTone), 4) + 0.0 as tone, round(avg(GoldsteinScale), 4) + 0.0 as goldstein,
 nullif(count(*) filter (where c), 0) as conflict_rows, case when count(*) filter (where c) > 0 then count(distinct SOURCEURL) filter (where c) end as conflict_articles,
 round(avg(AvgTone) filter (where c), 4) + 0.0 as conflict_tone, round(avg(GoldsteinScale) filter (where c), 4) + 0.0 as conflict_goldstein,
 round(case when count(*) filter (where c) > 0 then count(distinct SOURCEURL) filter (where c) end / nullif(count(distinct SOURCEURL), 0), 4) + 0.0 as conflict_share
 from ev where date is not null group by date""")
def daily_event_features(spark, d):
    return rounded(ev.daily_features(table(spark, d, "event_rows")))


@query("""with e as (select GlobalEventID, AvgTone, cast(try_strptime(DATEADDED, '%Y%m%d%H%M%S') as date) as date from event_rows)
select date, GlobalEventID, AvgTone from e where date between (select max(date) from e) - 30 and (select max(date) from e)""")
def date_range_projection(spark, d):
    rows = table(spark, d, "event_rows")
    last = rows.agg(F.max(ev.day())).first()[0]  # one value
    if last is not None:  # stamps sort as text, so the scan skips row groups by their bounds; unreadable ones fall to the exact filter
        rows = rows.filter(F.col("DATEADDED").between(f"{last - timedelta(days=30):%Y%m%d}", f"{last:%Y%m%d}235959"))
    e = rows.select(ev.day().alias("date"), "GlobalEventID", "AvgTone")
    return e.filter(F.col("date").between(F.date_sub(F.lit(last), 30), F.lit(last)))


@query("""select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total from events where try_cast(json_extract_string(props, '$.k') as bigint) >= 50 group by 1""")
def json_prop_filter(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").withColumn("k", k).filter("k >= 50").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


_LEGS = """legs as (select *, coalesce(ActionGeo_Lat between 22 and 31 and ActionGeo_Long between 46 and 60, false) as b, coalesce(ActionGeo_CountryCode in ('IR','AE','MU','SA','QA','KU','BA','IZ'), false) as c,
 regexp_matches(lower(coalesce(ActionGeo_FullName, '')) || chr(10) || lower(coalesce(SOURCEURL, '')), 'hormuz|strait|fujairah|jebel ali|khor fakkan|tanker|persian gulf|arabian gulf|gulf of oman') as k from event_rows)"""


@query(f"""with {_LEGS} select GlobalEventID, src_file, concat_ws('+', case when b then 'bbox' end, case when c then 'country' end, case when k then 'keyword' end) as region_match from legs where b or c or k""")
def three_leg_filter_tag(spark, d):
    return ev.filter_region(ev.coerce_numeric(table(spark, d, "event_rows"))).select("GlobalEventID", "src_file", "region_match")


@query(f"""with {_LEGS} select count(*) as rows_total, count(*) filter (where b) as leg_bbox, count(*) filter (where c) as leg_country, count(*) filter (where k) as leg_keyword, count(*) filter (where k and not b and not c) as leg_keyword_only from legs""")
def leg_contribution_counts(spark, d):
    return ev.leg_counts(ev.coerce_numeric(table(spark, d, "event_rows")))


@query("""select SOURCEURL, max(NumArticles) as NumArticles, count(*) as n from event_rows group by 1""")
def dedup_keep_best(spark, d):
    e = table(spark, d, "event_rows").select("SOURCEURL", "NumArticles", "GlobalEventID")
    best = ev.best_per_article(e).select("SOURCEURL", "NumArticles")
    n = e.groupBy("SOURCEURL").agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, best.SOURCEURL.eqNullSafe(n.SOURCEURL)).select(best.SOURCEURL, "NumArticles", "n")


@query(f"""with {_EV}, cf as (select * from ev where c),
best as (select *, row_number() over (partition by date, SOURCEURL order by NumArticles desc nulls last, GlobalEventID nulls last) as r from cf),
a as (select date, count(*) as events, sum(coalesce(NumArticles, 0)) as reports from cf group by 1), m as (select date, count(*) as articles from best where r = 1 group by 1)
select a.date, events, articles, reports from a join m on a.date is not distinct from m.date""")
def tension_volume_daily(spark, d):
    return ev.tension(table(spark, d, "event_rows").withColumn("date", ev.day()), "date").select("date", "events", "articles", "reports")


@query(f"""with {_EV}, cf as (select * from ev where c), best as (select *, row_number() over (partition by date, SOURCEURL order by NumArticles desc nulls last, GlobalEventID nulls last) as r from cf),
a as (select date, count(*) as events, sum(coalesce(NumArticles, 0)) as reports from cf group by 1), m as (select date, count(*) as articles, avg(GoldsteinScale) as g, avg(AvgTone) as t from best where r = 1 group by 1)
select a.date, events, articles, round(reports, 4) + 0.0 as reports, round(g, 4) + 0.0 as goldstein, round(t, 4) + 0.0 as tone,
 round(least(100, least(articles / 50.0, 1) * 40 + greatest(0, coalesce(-g, 0) / 10) * 35 + greatest(0, coalesce(-t, 0) / 10) * 25), 4) + 0.0 as score from a join m on a.date is not distinct from m.date""")
def tension_score_daily(spark, d):
    return rounded(ev.tension(table(spark, d, "event_rows").withColumn("date", ev.day()), "date"))


@query(f"""with {_EV} select time_bucket(interval 15 minutes, t) as slot, count(*) as n, count(distinct SOURCEURL) as articles, count(*) filter (where c) as conflict from ev where t is not null group by 1""")
def slot_aggregate_15min(spark, d):
    s = ev.slots(table(spark, d, "event_rows")).filter("slot is not null")
    return s.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("SOURCEURL").alias("articles"), F.count_if(ev.is_conflict()).alias("conflict"))


@query(f"""with {_EV}, have as (select distinct time_bucket(interval 15 minutes, t) as slot from ev where t is not null)
select s.slot from (select unnest(generate_series(min(slot), max(slot), interval 15 minutes)) as slot from have) s anti join have using (slot)""")
def missing_slots(spark, d):
    return ev.missing_slots(table(spark, d, "event_rows"))


# ------------------------------------------------------------------ market series


@query(f"with {_WIDE} select date, brent, wti, gas from wide")
def market_wide_panel(spark, d):
    return wide(spark, d)


def _series(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, date, v) of all series, one row a day."""
    m = table(spark, d, "market_daily").filter("value is not null and not isnan(value)")
    best = F.max_by("value", F.struct("date", "obs_id"))
    return m.groupBy("series_id", F.to_date("date").alias("day")).agg(best.alias("v")).withColumnRenamed("day", "date")


_SERIES = "s as (select series_id, cast(date as date) as date, last(value order by date, obs_id) as v from market_daily where value is not null and not isnan(value) group by 1, 2)"
def _by():
    return ts.ordered(["series_id"])


@query(f"""with {_SERIES} select series_id, date, round((v / nullif(lag(v, 1) over w, 0) - 1) * 100, 4) + 0.0 as ret_1, round((v / nullif(lag(v, 7) over w, 0) - 1) * 100, 4) + 0.0 as ret_7, round(v - lag(v, 7) over w, 4) + 0.0 as diff_7
from s window w as (partition by series_id order by date)""")
def returns_and_differences(spark, d):
    v = F.col("v")
    return _series(spark, d).select("series_id", "date", r4(ts.pct_change(v, 1, _by())).alias("ret_1"), r4(ts.pct_change(v, 7, _by())).alias("ret_7"), r4(ts.diff(v, 7, _by())).alias("diff_7"))


@query(f"""with {_WIDE} select date, round(brent, 4) + 0.0 as brent, round(sum(brent) over w10, 4) / nullif(count(brent) over w10, 0) as mean_10, round(max(brent) over w10, 4) + 0.0 as max_10, cast(count(brent) over w10 as bigint) as n_10 from wide window w10 as (order by date rows between 9 preceding and current row)""")
def rolling_smooth(spark, d):
    w = ts.ordered().rowsBetween(-9, 0)
    b = F.col("brent")
    return wide(spark, d).select("date", r4("brent").alias("brent"), F.try_divide(F.round(F.sum(b).over(w), 4), F.count(b).over(w).cast("double")).alias("mean_10"), r4(F.max(b).over(w)).alias("max_10"), F.count(b).over(w).alias("n_10"))


@query(f"""with {_SPREAD}, r as (select date, (brent / nullif(lag(brent) over (order by date), 0) - 1) * 100 as r1, spread from sp)
select date, round(case when r1 is not null and count(r1) over w7 >= 3 then stddev_samp(r1) over w7 end, 3) + 0.0 as vol_7,
 case when spread is not null and count(*) over w30 >= 10 then cast(sum(case when spread > 15 then 1.0 else 0.0 end) over w30 as double) end as stressed_30
from r window w7 as (order by date rows between 6 preceding and current row), w30 as (order by date rows between 29 preceding and current row)""")
def rolling_vol_and_stress(spark, d):
    w = ts.ordered()
    x = spread(spark, d).withColumn("r1", ts.pct_change(F.col("brent"), 1, w))
    vol = ts.only_where(ts.rolling(F.stddev_samp, F.col("r1"), 7, 3, w), F.col("r1"))
    st = ts.only_where(ts.count_above(F.col("spread"), 15.0, 30, 10, w), F.col("spread"))
    return x.select("date", (F.round(vol, 3) + 0.0).alias("vol_7"), st.alias("stressed_30"))


@query(f"""with {_SERIES}, z as (select series_id, date, v, case when count(v) over w >= 60 then avg(v) over w end as m, case when count(v) over w >= 60 then stddev_samp(v) over w end as sd from s window w as (partition by series_id order by date rows between 251 preceding and current row))
select series_id, date, round((v - m) / nullif(sd, 0), 3) + 0.0 as z_252 from z""")
def rolling_z252(spark, d):
    return _series(spark, d).select("series_id", "date", (F.round(ts.rolling_z(F.col("v"), 252, 60, _by()), 3) + 0.0).alias("z_252"))


@query(f"""with {_SERIES} select series_id, date, round(case when count(v) over w >= 20 then (v - avg(v) over w) / nullif(stddev_samp(v) over w, 0) end, 3) + 0.0 as z
from s window w as (partition by series_id order by date rows between unbounded preceding and current row)""")
def expanding_z(spark, d):
    return _series(spark, d).select("series_id", "date", (F.round(ts.expanding_z(F.col("v"), 20, _by()), 3) + 0.0).alias("z"))


@query("""with r as (select series_id, cast(date as date) as d, max(case when not isnan(value) then value end) as v from market_daily group by 1, 2),
g as (select series_id, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from r group by 1), j as (select g.series_id, g.d as date, v from g left join r using (series_id, d))
select series_id, date, last_value(v ignore nulls) over (partition by series_id order by date rows between 5 preceding and current row) as filled from j""")
def ffill_limit5(spark, d):
    m = table(spark, d, "market_daily").groupBy("series_id", F.to_date("date").alias("date")).agg(F.max(ts.clean(F.col("value"))).alias("v"))
    life = m.groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    g = life.select("series_id", F.explode(F.sequence("lo", "hi")).alias("date")).join(m, ["series_id", "date"], "left")
    return g.select("series_id", "date", ts.forward_fill(F.col("v"), 5, _by()).alias("filled"))


@query(f"""with {_SPREAD}, e as (select cast(try_strptime(DATEADDED, '%Y%m%d%H%M%S') as date) as date, count(*) as events_rows, count(distinct SOURCEURL) as events_articles from event_rows group by 1 having date is not null),
b as (select date from sp union select date from e), c as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from b)
select c.date, brent, wti, gas, round(spread, 4) + 0.0 as brent_wti_spread, events_rows, events_articles from c left join sp using (date) left join e using (date)""")
def feature_panel(spark, d):
    m = fusion.market_features(wide(spark, d)).select("date", "brent", "wti", "gas", r4("brent_wti_spread").alias("brent_wti_spread"))
    e = ev.daily_features(table(spark, d, "event_rows")).select("date", "events_rows", "events_articles")
    return ts.densify([m, e])


@query(f"""with {_SPREAD}, x as (select *, (brent / nullif(lag(brent) over w, 0) - 1) * 100 as r1, (brent / nullif(lag(brent, 7) over w, 0) - 1) * 100 as r7, spread - lag(spread, 7) over w as c7 from sp window w as (order by date))
select date, round(brent, 4) + 0.0 as brent, round(wti, 4) + 0.0 as wti, round(gas, 4) + 0.0 as gas, round(spread, 4) + 0.0 as brent_wti_spread, round(r1, 4) + 0.0 as brent_ret_1d, round(r7, 4) + 0.0 as brent_ret_7d, round(c7, 4) + 0.0 as spread_chg_7d,
 round(case when spread is not null and count(spread) over w252 >= 60 then (spread - avg(spread) over w252) / nullif(stddev_samp(spread) over w252, 0) end, 4) + 0.0 as spread_z,
 round(case when spread is not null and count(spread) over w10 >= 5 then avg(spread) over w10 end, 6) + 0.0 as spread_smooth_10d,
 case when spread is not null and count(*) over w30 >= 10 then cast(sum(case when spread > 15 then 1.0 else 0.0 end) over w30 as double) end as spread_days_gt15_30d,
 round(case when r1 is not null and count(r1) over w7 >= 3 then stddev_samp(r1) over w7 end, 4) + 0.0 as brent_vol_7d
from x window w252 as (order by date rows between 251 preceding and current row), w10 as (order by date rows between 9 preceding and current row), w30 as (order by date rows between 29 preceding and current row), w7 as (order by date rows between 6 preceding and current row)""")
def market_features(spark, d):
    m = fusion.market_features(wide(spark, d))
    return rounded(m.drop("spread_smooth_10d")).join(m.select("date", (F.round("spread_smooth_10d", 6) + 0.0).alias("spread_smooth_10d")), "date")  # means of prices end at a 5


@query(f"""with {_SPREAD}, x as (select (select max(date) from sp where brent is not null) as hi) select cast(null as varchar) as "column", cast(null as varchar) as problem from x where hi is null""")
def leakage_report(spark, d):
    return fusion.leakage(fusion.market_features(wide(spark, d)))


@query(f"""with {_SPREAD} select c as "column", p as problem from (values ('spread_chg_7d'), ('spread_z'), ('spread_smooth_10d'), ('spread_days_gt15_30d')) x(c), (values ('outlives its source'), ('has more values than its source')) y(p)
where (select count(spread) from sp) > 120""")
def leakage_of_a_cut_source(spark, d):
    """The same checks where the spread is known for its first days only: everything derived from it has leaked."""
    m = fusion.market_features(wide(spark, d))
    first = m.filter("brent_wti_spread is not null").orderBy("date").limit(10).select("date").withColumn("__known", F.lit(True))
    cut = m.join(F.broadcast(first), "date", "left")  # ten rows
    return fusion.leakage(cut.withColumn("brent_wti_spread", F.when(F.col("__known"), F.col("brent_wti_spread"))).drop("__known"))


@query(f"""with {_SERIES}, n as (select series_id, v, lead(v) over (partition by series_id order by date) as nx from s), g as (select series_id, count(*) as n, corr(v, nx) as c from n group by 1)
select series_id, n, round(case when n >= 60 then c end, 4) + 0.0 as autocorr, coalesce(case when n >= 60 then abs(c) > 0.9999 end, false) as suspect from g""")
def lag1_autocorr(spark, d):
    return rounded(ts.lag1_autocorrelation(_series(spark, d), "v", keys=["series_id"]))


_RANK = """select a.series_id, a.date, a.v, case when count(*) >= 120 then round(count(*) filter (where b.v < a.v) / count(*), 6) end as rank
from s a join s b on a.series_id = b.series_id and b.date <= a.date group by 1, 2, 3"""


@query(f"with {_SERIES} {_RANK}")
def causal_rank(spark, d):
    return ts.causal_rank(_series(spark, d), "v", keys=["series_id"]).withColumn("rank", F.round("rank", 6))


def arms(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d).select("date", F.col("spread").alias("arm_b"), F.col("wti").alias("arm_c"), F.col("gas").alias("arm_a"))


_ARMS = _SPREAD + """, arms as (select date, spread as arm_b, wti as arm_c, gas as arm_a from sp),
rb as (select a.date, case when count(*) >= 120 then count(*) filter (where b.arm_b < a.arm_b) / count(*) end as r from arms a join arms b on b.date <= a.date and b.arm_b is not null where a.arm_b is not null group by a.date),
rc as (select a.date, case when count(*) >= 120 then count(*) filter (where b.arm_c < a.arm_c) / count(*) end as r from arms a join arms b on b.date <= a.date and b.arm_c is not null where a.arm_c is not null group by a.date),
ra as (select a.date, case when count(*) >= 120 then count(*) filter (where b.arm_a < a.arm_a) / count(*) end as r from arms a join arms b on b.date <= a.date and b.arm_a is not null where a.arm_a is not null group by a.date),
rk as (select arms.date, rb.r as rank_arm_b, rc.r as rank_arm_c, ra.r as rank_arm_a from arms left join rb using (date) left join rc using (date) left join ra using (date)),
pr as (select *, (case when rank_arm_b is not null then 0.5 else 0 end) + (case when rank_arm_c is not null then 0.5 else 0 end) as p from rk),
risk as (select date, round(rank_arm_b, 4) + 0.0 as rank_arm_b, round(rank_arm_c, 4) + 0.0 as rank_arm_c, round(rank_arm_a, 4) + 0.0 as rank_arm_a,
  cast((rank_arm_b is not null)::int + (rank_arm_c is not null)::int + (rank_arm_a is not null)::int as integer) as arms_available, cast(p as double) as weight_available,
  round(case when p >= 0.5 then (coalesce(rank_arm_b * 0.5, 0) + coalesce(rank_arm_c * 0.5, 0)) / nullif(p, 0) * 100 end, 4) + 0.0 as risk_index from pr)"""


@query(f"with {_ARMS} select * from risk")
def risk_index(spark, d):
    return rounded(fusion.risk_index(arms(spark, d)))


# ------------------------------------------------------------------ intervals


@query(f"""with {_WIDE}, {_CAL} select date, exists (select 1 from cal where wide.date between s - 60 and e + 60) as near_event, wide.date between date '2014-08-01' and date '2014-09-15' as declared_other from wide""")
def event_mask(spark, d):
    x = F.col("date")
    return wide(spark, d).select("date", intervals.inside(x, CAL, 60).alias("near_event"), intervals.inside(x, OTHER).alias("declared_other"))


@query(f"""with {_SERIES}, {_CAL}, life as (select series_id, min(date) as lo, max(date) as hi from s group by 1) select series_id, name as event from life join cal on e >= lo and s <= hi""".replace("and s <= hi", "and cal.s <= hi"))
def events_in_window(spark, d):
    life = _series(spark, d).groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    every = F.array(*(F.when((F.lit(p.end) >= F.col("lo")) & (F.lit(p.start) <= F.col("hi")), F.lit(p.name)) for p in CAL))
    return life.select("series_id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("event"))


@query(f"""with {_ARMS}, {_CAL}, q as (select risk_index as v from risk where risk_index is not null and not exists (select 1 from cal where risk.date between s - 30 and e + 30))
select round(quantile_cont(v, 0.9), 4) + 0.0 as threshold, count(*) as n_quiet from q""")
def quiet_threshold_p90(spark, d):
    return rounded(intervals.quiet_threshold(risk_index(spark, d), CAL, "risk_index"))


@query(f"""with {_SPREAD}, {_CAL}, p as (select name as event, cal.s as onset, sp.date, spread from sp join cal on sp.date between cal.s - 60 and cal.s where spread is not null)
select event, onset, count(*) as n_days, round(max(spread), 4) + 0.0 as peak, min(date) filter (where spread > 5) as first_cross, cast(onset - min(date) filter (where spread > 5) as integer) as lead_days, count(*) filter (where spread > 5) > 0 as detected from p group by 1, 2""")
def lead_time(spark, d):
    return rounded(intervals.lead_times(spread(spark, d), CAL, "spread", F.lit(5.0)))


_FOLDS = f"""{_CAL}, days as (select distinct date from wide), f as (select name as event, s as onset,
 (select min(date) from days where date < s - 70) as train_start, (select max(date) from days where date < s - 70) as train_end, (select count(*) from days where date < s - 70) as train_days,
 (select min(date) from days where date between s - 60 and e) as test_start, (select max(date) from days where date between s - 60 and e) as test_end, (select count(*) from days where date between s - 60 and e) as test_days from cal)"""


@query(f"""with {_WIDE}, {_FOLDS} select *, case when test_days = 0 then 'no coverage' when train_days < 120 then 'too little history' end as reason, test_days > 0 and train_days >= 120 as scoreable from f""")
def loeo_folds(spark, d):
    return intervals.leave_one_event_out(wide(spark, d), CAL, least=120)


@query(f"""with {_WIDE}, n as (select date, row_number() over (order by date) as pos, count(*) over () as n from wide), i as (select unnest(generate_series(0, 4)) as fold),
c as (select fold, 180 + fold * ((select max(n) from n) - 180) // 5 as cut, ((select max(n) from n) - 180) // 5 as size from i), c2 as (select fold, 180 + fold * size as cut, size from c),
a as (select fold, cut, size, min(date) as train_start, max(date) as train_end, count(*) as train_days from c2 join n on pos <= cut group by 1, 2, 3)
select cast(a.fold as integer) as fold, train_start, train_end, train_days, train_end + 10 as embargo_end, min(date) as test_start, max(date) as test_end, count(*) as test_days from a join n on n.date > train_end + 10 and pos <= cut + size group by 1, 2, 3, 4, 5""")
def expanding_folds(spark, d):
    return _folds(spark, d)


def _folds(spark: SparkSession, d: str) -> DataFrame:
    """The folds of the market panel; none where it has too few days."""
    try:
        return intervals.expanding_folds(wide(spark, d))
    except ValueError:
        kind = "fold int, train_start date, train_end date, train_days long, embargo_end date, test_start date, test_end date, test_days long"
        return spark.createDataFrame([], kind)


@query(f"""with {_WIDE}, {_FOLDS} select event, problem from f, (values ('event in training'), ('embargo broken'), ('training after the test')) y(problem) where test_days > 0 and train_days >= 120""")
def loeo_audit_of_late_training(spark, d):
    """The audit of folds whose training runs into the event: each has all three faults."""
    folds = intervals.leave_one_event_out(wide(spark, d), CAL, least=120).withColumn("train_end", F.date_add("onset", 1))
    return intervals.audit_loeo(folds, CAL)


@query()
def fold_audit(spark, d):
    return intervals.audit_folds(_folds(spark, d), CAL)


@query(f"""with {_WIDE}, {_FOLDS} select event, 'event in training' as problem from f join cal on name = event where test_days > 0 and train_days >= 120 and e >= train_start and s <= train_end""")
def loeo_audit(spark, d):
    return intervals.audit_loeo(intervals.leave_one_event_out(wide(spark, d), CAL, least=120), CAL)


@query(f"""with {_ARMS}, {_CAL}, idx as (select date, risk_index as v from risk where risk_index is not null),
thr as (select quantile_cont(v, 0.9) as t, count(*) as nq from idx where not exists (select 1 from cal where idx.date between s - 30 and e + 30)),
f as (select name as event, s as onset, (select count(*) from idx where date < s - 70) as train_days, (select count(*) from idx where date between s - 60 and e) as test_days from cal),
p as (select name as event, max(v) as peak, count(*) as n_days, min(date) filter (where v > t) as fc from cal join idx on idx.date between s - 60 and s cross join thr group by 1),
j as (select f.*, t, nq, peak, n_days, fc, case when test_days = 0 or train_days < 120 then 'unscoreable' when nq < 50 then 'too few quiet days' when n_days is null then 'no coverage' when fc is not null then 'detected' else 'missed' end as status from f cross join thr left join p using (event))
select event, onset, status, case when status in ('detected', 'missed') then round(t, 4) + 0.0 end as threshold, case when status in ('detected', 'missed') then round(peak, 4) + 0.0 end as peak,
 case when status in ('detected', 'missed') then n_days end as n_days, case when status in ('detected', 'missed') then fc end as first_cross,
 case when status in ('detected', 'missed') then cast(onset - fc as integer) end as lead_days, case when status in ('detected', 'missed') then fc is not null end as detected from j""")
def loeo_backtest(spark, d):
    return rounded(intervals.backtest(risk_index(spark, d), CAL, "risk_index"))


@query(f"""with {_ARMS}, {_CAL}, idx as (select date, risk_index as v from risk where risk_index is not null),
quiet as (select date, v from idx where not exists (select 1 from cal where idx.date between s - 30 and e + 30)),
thr as (select name as event, quantile_cont(v, 0.9) as t, count(v) as nq from cal left join quiet on quiet.date < cal.s - 60 group by 1),
f as (select name as event, s as onset, (select count(*) from idx where date < s - 70) as train_days, (select count(*) from idx where date between s - 60 and e) as test_days from cal),
p as (select name as event, max(v) as peak, count(*) as n_days, min(date) filter (where v > t) as fc from cal join idx on idx.date between s - 60 and s join thr on thr.event = cal.name group by 1),
j as (select f.*, t, nq, peak, n_days, fc, case when test_days = 0 or train_days < 120 then 'unscoreable' when nq < 50 then 'too few quiet days' when n_days is null then 'no coverage' when fc is not null then 'detected' else 'missed' end as status from f join thr using (event) left join p using (event))
select event, onset, status, case when status in ('detected', 'missed') then round(t, 4) + 0.0 end as threshold, case when status in ('detected', 'missed') then round(peak, 4) + 0.0 end as peak,
 case when status in ('detected', 'missed') then n_days end as n_days, case when status in ('detected', 'missed') then fc end as first_cross,
 case when status in ('detected', 'missed') then cast(onset - fc as integer) end as lead_days, case when status in ('detected', 'missed') then fc is not null end as detected from j""")
def loeo_backtest_causal(spark, d):
    return rounded(intervals.backtest(risk_index(spark, d), CAL, "risk_index", scope="past"))


@query(f"""with {_WIDE}, {_CAL}, x as (select date, exists (select 1 from cal where wide.date between s - 60 and e + 60) as f from wide),
y as (select date, bool_or(f) over w as contaminated, count(*) over w as k from x window w as (order by date rows between 19 preceding and current row)) select date, contaminated from y where k = 20""")
def window_contamination(spark, d):
    return intervals.contaminated(wide(spark, d), CAL)


@query(f"""with {_SPREAD}, c as (select date, brent, spread from sp where brent is not null and spread is not null),
y as (select date, sum(brent) over w as sb, sum(spread) over w as ss, first_value(brent) over w as b0, count(*) over w as k from c window w as (order by date rows between 19 preceding and current row))
select date, round(sb, 4) + 0.0 as sum_brent, round(ss, 4) + 0.0 as sum_spread, round(b0, 4) + 0.0 as first_brent, cast(20 as integer) as n from y where k = 20""")
def sequence_windows(spark, d):
    w = ts.sequence_windows(spread(spark, d), ["brent", "spread"])
    total = lambda i: F.aggregate("window", F.lit(0.0), lambda s, x: s + x[i])
    return w.select("date", r4(total(0)).alias("sum_brent"), r4(total(1)).alias("sum_spread"), r4(F.col("window")[0][0]).alias("first_brent"), F.size("window").alias("n"))


@query(f"""with {_SPREAD}, {_CAL}, c as (select date, brent, spread, exists (select 1 from cal where sp.date between s - 60 and e + 60) as f from sp where brent is not null and spread is not null),
y as (select date, brent, spread, row_number() over (order by date) as i, f from c), e as (select date, i, bool_or(f) over w as bad, count(*) over w as k from y window w as (order by i rows between 19 preceding and current row)),
t as (select y.brent, y.spread from e join y on y.i between e.i - 19 and e.i where e.k = 20 and not e.bad)
select count(*) as n, round(avg(brent), 3) + 0.0 as mean_brent, round(stddev_pop(brent), 3) + 0.0 as std_brent, round(avg(spread), 3) + 0.0 as mean_spread, round(stddev_pop(spread), 3) + 0.0 as std_spread from t""")
def train_scaler_stats(spark, d):
    from tidegauge.operators import market_model

    rows = market_model.training_rows(spread(spark, d), ["brent", "spread"], CAL, 60)
    r3 = lambda c: F.round(c, 3) + 0.0
    return rows.agg(F.count(F.lit(1)).alias("n"), r3(F.avg("brent")).alias("mean_brent"), r3(F.stddev_pop("brent")).alias("std_brent"), r3(F.avg("spread")).alias("mean_spread"), r3(F.stddev_pop("spread")).alias("std_spread"))


# ------------------------------------------------------------------ evaluation


@query("""with x as (select n_chars as s, (abusive + hateful + sexual) > 0 as p from review_labels join documents using (doc_id) where n_chars is not null),
r as (select p, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from x)
select count(*) filter (where p) as n_pos, count(*) filter (where not p) as n_neg, round((sum(rk) filter (where p) - count(*) filter (where p) * (count(*) filter (where p) + 1) / 2.0) / nullif(count(*) filter (where p) * count(*) filter (where not p), 0), 6) as auc from r""")
def auc_mannwhitney(spark, d):
    x = table(spark, d, "review_labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return agg.auc(x, "n_chars", F.col("abusive") + F.col("hateful") + F.col("sexual") > 0).withColumn("auc", F.round("auc", 6))


@query("""with g as (select abusive as t, hateful as p, count(*) as n from review_labels where abusive is not null and hateful is not null group by 1, 2), c as (select t as cls from g union select p from g)
select cls, cast(coalesce(sum(n) filter (where t = cls), 0) as bigint) as support, cast(coalesce(sum(n) filter (where p = cls), 0) as bigint) as predicted, cast(coalesce(sum(n) filter (where t = cls and p = cls), 0) as bigint) as hits,
 round(coalesce(sum(n) filter (where t = cls and p = cls), 0) / nullif(coalesce(sum(n) filter (where p = cls), 0), 0), 4) + 0.0 as precision, round(coalesce(sum(n) filter (where t = cls and p = cls), 0) / nullif(coalesce(sum(n) filter (where t = cls), 0), 0), 4) + 0.0 as recall
from c cross join g group by 1""")
def confusion_matrix(spark, d):
    return rounded(agg.confusion(table(spark, d, "review_labels"), "abusive", "hateful"))


@query("""select lang as cls, count(*) as n, round((select count(*) from documents where lang is not null) / ((select count(distinct lang) from documents) * count(*)), 4) + 0.0 as weight from documents where lang is not null group by 1""")
def class_weights(spark, d):
    return rounded(agg.class_weights(table(spark, d, "documents"), "lang"))


@query(f"""with {_SPREAD}, t as (select quantile_cont(spread, 0.95) as p95, quantile_cont(spread, 0.99) as p99 from sp)
select date, case when spread is null then 'UNCALIBRATED' when spread > p99 then 'HIGH' when spread > p95 then 'ELEVATED' else 'NORMAL' end as band_strict, case when spread is null then 'UNCALIBRATED' when spread >= p99 then 'HIGH' when spread >= p95 then 'ELEVATED' else 'NORMAL' end as band_inclusive from sp cross join t""")
def percentile_bands(spark, d):
    x = spread(spark, d)
    t = x.agg(F.percentile("spread", F.lit(0.95)), F.percentile("spread", F.lit(0.99))).first()  # two numbers
    v, a, b = F.col("spread"), F.lit(t[0]), F.lit(t[1])
    return x.select("date", fn.band_exclusive(v, a, b).alias("band_strict"), fn.band_inclusive(v, a, b).alias("band_inclusive"))


@query(f"""with {_SPREAD} select 'brent' as "column", count(brent) as n, round(count(brent) / nullif(count(*), 0), 4) + 0.0 as share, min(date) filter (where brent is not null) as first_day, max(date) filter (where brent is not null) as last_day from sp
union all select 'spread', count(spread), round(count(spread) / nullif(count(*), 0), 4) + 0.0, min(date) filter (where spread is not null), max(date) filter (where spread is not null) from sp""")
def column_coverage(spark, d):
    return rounded(agg.coverage_report(spread(spark, d), ["brent", "spread"]))


@query("""select series_id, min(cast(date as date)) as first_day, max(cast(date as date)) as last_day, count(*) as n, bool_and(official) as official from market_daily group by 1""")
def series_provenance(spark, d):
    m = table(spark, d, "market_daily")
    return m.groupBy("series_id").agg(F.min(F.to_date("date")).alias("first_day"), F.max(F.to_date("date")).alias("last_day"), F.count(F.lit(1)).alias("n"), F.bool_and("official").alias("official"))


# ------------------------------------------------------------------ text and vectors


SLUG_SQL = """slug as (select url, lower(array_to_string(case when len(last) < 4 and len(longest) > len(last) then longest else last end, ' ')) as words from (
 select url, list_filter(regexp_extract_all(coalesce(segs[-1], ''), '[A-Za-z\\x{0600}-\\x{06FF}\\x{0400}-\\x{04FF}]{3,}'), lambda w: not list_contains(stops, lower(w))) as last,
  list_filter(regexp_extract_all(case when len(segs) = 0 then '' else list_reduce(segs, lambda a, s: case when length(s) > length(a) then s else a end) end, '[A-Za-z\\x{0600}-\\x{06FF}\\x{0400}-\\x{04FF}]{3,}'), lambda w: not list_contains(stops, lower(w))) as longest
 from (select url, ['news', 'article', 'articles', 'story', 'stories', 'index', 'world', 'politics', 'business', 'en', 'ar', 'amp', 'www'] as stops,
  list_transform(list_filter(string_split(url_decode(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')), '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '\\.(html?|php|aspx?|shtml|jsp)$', '', 'i')) as segs
  from (select distinct SOURCEURL as url from event_rows where SOURCEURL is not null))))"""


@query(f"""with {SLUG_SQL} select url as SOURCEURL, words, cast(case when words = '' then 0 else length(words) - length(replace(words, ' ', '')) + 1 end as integer) as n_words from slug""")
def url_slug_words(spark, d):
    u = table(spark, d, "event_rows").select("SOURCEURL").filter("SOURCEURL is not null").distinct()
    s = u.withColumn("words", fn.slug_words(F.col("SOURCEURL")))
    return s.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(fn.word_count(F.col("words"))))


@query("""select doc_id, lower(coalesce(text, '')) similar to '(.|\\n)*(tanker|strait|hormuz)(.|\\n)*' as hit from documents""".replace("lower(coalesce(text, '')) similar to '(.|\\n)*(tanker|strait|hormuz)(.|\\n)*'", "regexp_matches(lower(coalesce(text, '')), 'tanker|strait|hormuz')"))
def keyword_contains(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.contains_any(F.col("text"), ["tanker", "strait", "hormuz"]).alias("hit"))


@query("""select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as r from documents) where r <= 120""")
def hash_sample_per_group(spark, d):
    return agg.hash_sample(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], 120, "doc_id")


@query("""with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as r from documents where n_chars is not null) select lang, round(avg(n_chars), 4) + 0.0 as top_mean from r where r <= 10 group by 1""")
def topk_mean_per_group(spark, d):
    return rounded(agg.top_k_mean(table(spark, d, "documents"), ["lang"], "n_chars", 10, "doc_id"))


@query("""select source, round(avg(case when n_chars > 500 then 1.0 else 0.0 end), 4) + 0.0 as share_long, count(*) filter (where lang is distinct from 'en') as n_not_english from documents group by 1""")
def share_above_and_not_equal(spark, d):
    long = F.when(F.col("n_chars") > 500, 1.0).otherwise(0.0)
    g = table(spark, d, "documents").groupBy("source").agg(F.avg(long).alias("share_long"), F.count_if(~F.col("lang").eqNullSafe("en")).alias("n_not_english"))
    return rounded(g)


def scored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, date, score) of the vectors against ten and six anchors. The anchors are the rows with the lowest ids, 16 in all."""
    e = table(spark, d, "embeddings")
    a = {r["vec_id"]: r["embedding"] for r in e.filter("vec_id < 16").select("vec_id", "embedding").collect()}
    many = lambda ids: F.array(*(fn.literal_vector(a[i]) for i in ids if i in a))
    v = F.col("embedding")
    score = fn.max_similarity(v, many(range(10))) - fn.max_similarity(v, many(range(10, 16)))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int"))
    return e.filter("vec_id >= 16").select("vec_id", day.alias("date"), score.alias("score"))


_SCORES = """a as (select vec_id, embedding from embeddings where vec_id < 16), v as (select vec_id, embedding, date '2024-01-01' + cast(vec_id % 30 as integer) as date from embeddings where vec_id >= 16),
sc as (select v.vec_id, v.date, max(list_dot_product(cast(v.embedding as double[]), cast(a.embedding as double[]))) filter (where a.vec_id < 10) - max(list_dot_product(cast(v.embedding as double[]), cast(a.embedding as double[]))) filter (where a.vec_id >= 10) as score from v cross join a group by 1, 2)"""


@query(f"with {_SCORES} select vec_id, date, round(score, 4) + 0.0 as score from sc")
def contrastive_score(spark, d):
    return rounded(scored_vectors(spark, d))


@query(f"""with {_SCORES}, r as (select *, row_number() over (partition by date order by score desc, vec_id) as r from sc)
select date, round(avg(score) filter (where r <= 10), 4) + 0.0 as top10, round(avg(score), 4) + 0.0 as mean, round(avg(case when score > 0 then 1.0 else 0.0 end), 4) + 0.0 as share_above_0, count(*) as n from r group by 1""")
def contrastive_daily(spark, d):
    s = scored_vectors(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "vec_id")))
    g = s.groupBy("date").agg(F.avg(F.when(F.col("r") <= 10, F.col("score"))).alias("top10"), F.avg("score").alias("mean"), F.avg((F.col("score") > 0).cast("double")).alias("share_above_0"), F.count(F.lit(1)).alias("n"))
    return rounded(g)


# ------------------------------------------------------------------ rasters

SIDE = 64


def chips(spark: SparkSession, d: str) -> DataFrame:
    """Dense chips of 64 by 64 pixels, one per line number, summed up from the order lines; two bands, missing pixels 0."""
    x = table(spark, d, "lineitem")
    bright = F.col("l_extendedprice") * F.when(F.col("l_discount") >= 0.1, 6).otherwise(1) / 1e5
    px = lambda key, band: x.groupBy(F.col("l_linenumber").cast("long").alias("chip"), (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col(key) % SIDE).cast("int").alias("col")).agg(F.sum(bright).alias(band))
    grid = x.select(F.col("l_linenumber").cast("long").alias("chip")).distinct()
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = grid.withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    g = grid.join(px("l_partkey", "vv"), ["chip", "row", "col"], "left").join(px("l_suppkey", "vh"), ["chip", "row", "col"], "left")
    return g.fillna(0.0, ["vv", "vh"])


_CHIPS = """px as (select l_linenumber as chip, l_orderkey % 64 as r, l_partkey % 64 as c, sum(l_extendedprice * (case when l_discount >= 0.1 then 6 else 1 end) / 1e5) as vv from lineitem group by 1, 2, 3),
chips as (select cast(k.chip as bigint) as chip, cast(i.i as integer) as r, cast(j.i as integer) as c, coalesce(vv, 0) as vv from (select distinct l_linenumber as chip from lineitem) k
  cross join (select unnest(generate_series(0, 63)) as i) i cross join (select unnest(generate_series(0, 63)) as i) j left join px on px.chip = k.chip and px.r = i.i and px.c = j.i)"""


def _boxes(source: str, col: str, out: str, h: int) -> str:
    return f"""{out}_a as (select chip, r, c, sum({col}) over (partition by chip, r order by c range between {h} preceding and {h} following) as s from {source}),
{out} as (select chip, r, c, sum(s) over (partition by chip, c order by r range between {h} preceding and {h} following) as s from {out}_a)"""


@query(f"""with {_CHIPS}, {_boxes("chips", "vv", "b25", 12)} select chip, r as "row", c as col, round(s, 7) + 0.0 as box from b25""")
def box_sum_25(spark, d):
    return raster.box_sum(chips(spark, d), {"vv": "box"}, 12).select("chip", "row", "col", (F.round("box", 7) + 0.0).alias("box"))


def _hits(k: float) -> str:
    """Pixels (chip, r, c) brighter than their ring by k standard deviations."""
    return f"""{_CHIPS}, q as (select *, case when vv > 0 then 1.0 else 0.0 end as n, vv * vv as q from chips),
{_boxes("q", "n", "no", 12)}, {_boxes("q", "vv", "xo", 12)}, {_boxes("q", "q", "qo", 12)}, {_boxes("q", "n", "ni", 4)}, {_boxes("q", "vv", "xi", 4)}, {_boxes("q", "q", "qi", 4)},
j as (select chips.*, no.s - ni.s as n, xo.s - xi.s as x, qo.s - qi.s as q from chips join no using (chip, r, c) join xo using (chip, r, c) join qo using (chip, r, c) join ni using (chip, r, c) join xi using (chip, r, c) join qi using (chip, r, c)),
hits as (select chip, r, c from j where vv > 0 and n > (625 - 81) * 0.3 and vv > x / n + {k} * sqrt(greatest(q / n - (x / n) * (x / n), 0)))"""


@query(f"""with {_hits(3)} select chip, r as "row", c as col from hits""")
def cfar_mask(spark, d):
    return raster.cfar(chips(spark, d), k=3.0).filter("hit").select("chip", "row", "col")


# connected pixels: each reaches the others of its object, whose first pixel in reading order names it
@query(f"""with recursive {_hits(2.0)}, reach as (select chip, r, c, r * 64 + c as first from hits union select h.chip, h.r, h.c, first from reach join hits h on h.chip = reach.chip and abs(h.r - reach.r) + abs(h.c - reach.c) = 1),
own as (select chip, r, c, min(first) as first from reach group by 1, 2, 3), o as (select chip, first, count(*) as n, min(r) as ra, max(r) as rb, min(c) as ca, max(c) as cb from own group by 1, 2)
select chip, cast(dense_rank() over (partition by chip order by first) as integer) as label, n as size_px, cast(ra + rb as double) / 2 as "row", cast(ca + cb as double) / 2 as col, cast(rb - ra + 1 as integer) as height_px, cast(cb - ca + 1 as integer) as width_px,
 cast(greatest(rb - ra, cb - ca) + 1 as double) / (least(rb - ra, cb - ca) + 1) as elongation from o where n <= 400""")
def object_boxes(spark, d):
    return raster.objects(raster.cfar(chips(spark, d), k=2.0), least=1)


@query(f"""with {_CHIPS}, v as (select chip, 10 * log10(greatest(vv, 1e-6)) as x from chips where vv > 0), e as (select chip, min(x) as lo, max(x) as hi from v group by 1)
select chip, cast(least(255, floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 256)) as integer) as bin, count(*) as n from v join e using (chip) group by 1, 2""")
def otsu_histogram(spark, d):
    return agg.histogram(_lit(spark, d), ["chip"], "db").select("chip", "bin", "n")


def _lit(spark: SparkSession, d: str) -> DataFrame:
    return chips(spark, d).filter("vv > 0").select("chip", fn.decibel(F.col("vv")).alias("db"))


@query(f"""with {_CHIPS}, v as (select chip, 10 * log10(greatest(vv, 1e-6)) as x from chips where vv > 0), e as (select chip, min(x) as lo, max(x) as hi from v group by 1),
h as (select chip, lo, hi, cast(least(255, floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 256)) as integer) as bin, count(*) as n from v join e using (chip) group by 1, 2, 3, 4),
p as (select *, lo + (bin + 0.5) * (hi - lo) / 256 as c, n / sum(n) over (partition by chip) as p from h),
o as (select *, sum(p) over w as om, sum(p * c) over w as mu, sum(p * c) over (partition by chip) as mt from p window w as (partition by chip order by bin rows between unbounded preceding and current row)),
s as (select chip, c, row_number() over (partition by chip order by round(pow(mt * om - mu, 2) / (case when om * (1 - om) <= 1e-12 then 1e-12 else om * (1 - om) end), 9) desc, bin) as r from o where om * (1 - om) > 1e-12)
select chip, round(c, 4) + 0.0 as threshold from s where r = 1""")
def otsu_threshold(spark, d):
    return rounded(agg.otsu(agg.histogram(_lit(spark, d), ["chip"], "db"), ["chip"]).select("chip", "threshold"))


@query()
def water_mask_facts(spark, d):
    return raster.water_facts(chips(spark, d), smooth=5, least_land=20)


@query()
def vessel_detections(spark, d):
    return raster.detect(chips(spark, d), k=2.0)


@query()
def chip_report(spark, d):
    return raster.chip_report(chips(spark, d), SIDE, SIDE, k=2.0)


@query()
def patch_cut(spark, d):
    p = raster.patches(chips(spark, d), raster.objects(raster.cfar(chips(spark, d), k=3.0), least=1), 16, SIDE, SIDE)
    return p.select("chip", "label", F.size("pixels").alias("n"), r4(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x[0])).alias("sum_vv"))


@query()
def negative_patches(spark, d):
    found = raster.objects(raster.cfar(chips(spark, d), k=3.0), least=1)
    return raster.negatives(raster.water_masks(chips(spark, d), smooth=5, least_land=20), found, 16, 12, SIDE, SIDE)


@query("""with k as (select distinct o_orderpriority, cast(o_orderdate as date) as day from orders), t as (select *, row_number() over (order by day desc, o_orderpriority desc) as r, count(*) over () as n from k)
select o_orderkey, r <= greatest(1, cast(floor(n * 0.25) as bigint)) as is_test from orders o join t on t.o_orderpriority = o.o_orderpriority and t.day = cast(o.o_orderdate as date)""")
def split_by_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    return raster.split_by_date(o, ["o_orderpriority"], "day").select("o_orderkey", "is_test")


@query("""select doc_id, coalesce(regexp_matches(text, '(?i)oil\\s+price|war\\s+risk|live\\s+firing'), false) as hit from documents""")
def term_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", ev.mentions(F.col("text"), ["oil price", "war risk", "live firing"]).alias("hit"))


@query(f"""with {_CHIPS} select chip, r as "row", c as col, round(10 * log10(greatest(vv, 1e-6)), 4) + 0.0 as db, round(least(1, greatest(0, (10 * log10(greatest(vv, 1e-6)) + 35) / 40)), 4) + 0.0 as scaled from chips""")
def db_clip_norm(spark, d):
    db = fn.decibel(F.col("vv"))
    return chips(spark, d).select("chip", "row", "col", r4(db).alias("db"), r4(fn.clip_scale(db, -35.0, 5.0)).alias("scaled"))


@query("""select name, round(latitude - 5 / 111.0, 6) + 0.0 as south, round(longitude - 5 / (111.0 * greatest(0.2, abs(cos(radians(latitude))))), 6) + 0.0 as west, round(latitude + 5 / 111.0, 6) + 0.0 as north, round(longitude + 5 / (111.0 * greatest(0.2, abs(cos(radians(latitude))))), 6) + 0.0 as east from uae_ports""")
def bbox_from_km(spark, d):
    b = fn.box_around(F.col("latitude"), F.col("longitude"), F.lit(5.0))
    return table(spark, d, "uae_ports").select("name", b.alias("b")).select("name", "b.*")


@query(f"""with {_CHIPS}, g as (select chip, avg(case when vv <> 0 then 1.0 else 0.0 end) as coverage from chips group by 1)
select chip, round(coverage, 4) + 0.0 as coverage, case when coverage = 0 then 'EMPTY' when coverage < 0.9 then 'PARTIAL' else 'FULL' end as status, coverage >= 0.9 as usable from g""")
def coverage_usable_flag(spark, d):
    c = raster.coverage(chips(spark, d))
    return c.select("chip", r4("coverage").alias("coverage"), fn.coverage_status(F.col("coverage")).alias("status"), (F.col("coverage") >= 0.9).alias("usable"))


# ------------------------------------------------------------------ keyed state, gaps, prefixes, status


@query("""with k as (select mmsi, ts_utc, msg_id, name, draught, sog from positions where mmsi is not null and ts_utc is not null)
select mmsi, min(ts_utc) as first_seen, max(ts_utc) as last_seen, last(name order by ts_utc, msg_id) filter (where name is not null) as name, last(draught order by ts_utc, msg_id) filter (where draught is not null) as draught,
 last(sog order by ts_utc, msg_id) filter (where sog is not null) as sog from k group by 1""")
def latest_state_per_key(spark, d):
    p = table(spark, d, "positions").filter("mmsi is not null and ts_utc is not null")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("ts_utc", "msg_id"))).alias(c)
    return p.groupBy("mmsi").agg(F.min("ts_utc").alias("first_seen"), F.max("ts_utc").alias("last_seen"), last("name"), last("draught"), last("sog"))


@query("""with x as (select distinct o_custkey, cast(o_orderdate as date) as d from orders), g as (select o_custkey, d - lag(d) over (partition by o_custkey order by d) as gap from x)
select o_custkey, round(avg(gap), 4) + 0.0 as mean_gap, cast(min(gap) as integer) as min_gap, cast(max(gap) as integer) as max_gap from g group by 1""")
def revisit_gaps(spark, d):
    x = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d")).distinct()
    g = x.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy("o_custkey").orderBy("d"))))
    return rounded(g.groupBy("o_custkey").agg(F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap")))


@query("""with x as (select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and current row) as spent, l_partkey from lineitem) select l_orderkey, l_linenumber, l_partkey, spent from x where spent <= 60""")
def budgeted_prefix(spark, d):
    p = agg.budgeted_prefix(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", 60.0, [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "spent")


@query("""select source, doc_id from (select source, doc_id, row_number() over (partition by source order by n_chars desc nulls last, doc_id) as r from documents) where r <= 12""")
def per_group_cap(spark, d):
    return agg.per_group_cap(table(spark, d, "documents"), ["source"], 12, [F.col("n_chars").desc_nulls_last(), F.col("doc_id")]).select("source", "doc_id")


@query("""with a as (select 'events' as arm, max(try_strptime(DATEADDED, '%Y%m%d%H%M%S')) as as_of, 1 as lim from event_rows union all select 'market', max(date), 96 from market_daily union all select 'positions', max(ts_utc), 336 from positions)
select arm, as_of, round(date_diff('second', as_of, timestamp '2015-04-01 00:00:00') / 3600.0, 2) as age_hours, case when as_of is null then 'NO DATA' when date_diff('second', as_of, timestamp '2015-04-01 00:00:00') / 3600.0 > lim then 'STALE' else 'CURRENT' end as status from a""")
def freshness_status(spark, d):
    from tidegauge import api

    return api.freshness(spark, d, "2015-04-01 00:00:00")
