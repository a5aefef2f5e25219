"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazmill.durable import settled, shared_folder
from hazmill.extract import rules, when, where
from hazmill.functions import exprs as X
from hazmill.ml import models, severity
from hazmill.operators import evaluate as EV
from hazmill.operators import event_study as S
from hazmill.operators import events as E
from hazmill.operators import tables as T
from hazmill.plans import pipeline as P
from hazmill.plans import views as V
from hazmill.sources import rest
from hazmill.sources import tables as R
from hazmill.sources.prices import read_prices, write_prices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ART = V.duck(V.ART)
WITH = f"with art as ({ART}), cat as ({V.CAT_DUCK}), px as ({V.PX}), mkt as ({V.MKT}), ev as ({V.EV}), "
RATES = """
 rx as (select ticker, date, ln(close / lag(close) over (partition by ticker order by date)) as ret from px),
 rm as (select date, ln(close / lag(close) over (order by date)) as x from mkt),
 al as (select rx.ticker, rx.date, rx.ret as y, rm.x, row_number() over (partition by rx.ticker order by rx.date) - 1 as pos from rx join rm on rx.date = rm.date where rx.ret is not null and rm.x is not null)"""


def study(ev: str, n: str = "") -> str:
    """DuckDB: the event study over a table of events, its tables named with a suffix."""
    return f""",
 t0{n} as (select ev.*, d.date as t0, d.pos as t0_pos from {ev} ev asof left join al d on d.ticker = ev.ticker and ev.event_date <= d.date),
 st{n} as (select distinct ticker, t0_pos from t0{n} where t0_pos is not null),
 fit{n} as (select st.ticker, st.t0_pos, count(*) filter (pos <= t0_pos - 6) as n_est, regr_slope(y, x) filter (pos <= t0_pos - 6) as beta, regr_intercept(y, x) filter (pos <= t0_pos - 6) as alpha from st{n} st join al on al.ticker = st.ticker and pos between t0_pos - 45 and t0_pos + 5 group by all),
 ar{n} as (select fit.*, count(*) filter (pos >= fit.t0_pos) as n_ev, sum(y - (alpha + beta * x)) filter (pos between fit.t0_pos + 1 and fit.t0_pos + 1) as c1, sum(y - (alpha + beta * x)) filter (pos between fit.t0_pos + 1 and fit.t0_pos + 3) as c3, sum(y - (alpha + beta * x)) filter (pos between fit.t0_pos + 1 and fit.t0_pos + 5) as c5 from fit{n} fit join al on al.ticker = fit.ticker and pos between fit.t0_pos and fit.t0_pos + 5 group by all),
 car{n} as (select t0.*, coalesce(n_est, 0) as n_est, beta, alpha,
  case when t0.t0_pos is null then 'event_date_after_data' when coalesce(n_est, 0) < 10 then 'insufficient_estimation_data' when beta is null then 'ols_failed' end as error,
  case when coalesce(n_est, 0) >= 10 and n_ev > 1 then c1 end as car_t1, case when coalesce(n_est, 0) >= 10 and n_ev > 3 then c3 end as car_t3, case when coalesce(n_est, 0) >= 10 and n_ev > 5 then c5 end as car_t5
  from t0{n} t0 left join ar{n} ar on ar.ticker = t0.ticker and ar.t0_pos = t0.t0_pos)"""


RETURNS = WITH + RATES + study("ev") + " "


def tp(t: str, n: str) -> str:
    """DuckDB: two-sided Student-t p-value for n degrees of freedom."""
    th, c, s = f"atan(abs({t}) / sqrt({n}))", f"cos(atan(abs({t}) / sqrt({n})))", f"sin(atan(abs({t}) / sqrt({n})))"
    even = f"{s} * list_sum(list_transform(range(cast({n} // 2 as bigint)), lambda k: exp(lgamma(2*k + 1) - 2*k*ln(2) - 2*lgamma(k + 1)) * pow({c}, 2*k)))"
    odd = f"2/pi() * ({th} + {s} * coalesce(list_sum(list_transform(range(cast(({n} - 1) // 2 as bigint)), lambda k: exp(2*k*ln(2) + 2*lgamma(k + 1) - lgamma(2*k + 2)) * pow({c}, 2*k + 1))), 0))"
    return f"greatest(0, 1 - (case when {n} % 2 = 0 then {even} else {odd} end))"


def _px(spark, d):
    return V.view(spark, d, V.PX), V.view(spark, d, V.MKT)


def _cars(spark, d):
    return S.abnormal_returns(V.view(spark, d, V.EV), *_px(spark, d))


@query(WITH + "r as (select ticker, date, ln(close / lag(close) over (partition by ticker order by date)) as ret from px) select ticker, date, round(ret, 6) as ret from r where ret is not null")
def q_log_returns(spark, d):
    return S.log_returns(V.view(spark, d, V.PX)).select("ticker", "date", F.round("ret", 6).alias("ret"))


@query(RETURNS + "select event_id, ticker, event_date, t0, t0_pos from t0")
def q_t0_asof(spark, d):
    got = S.event_days(V.view(spark, d, V.EV), S.aligned_returns(*_px(spark, d)))
    return got.select("event_id", "ticker", "event_date", "t0", F.col("t0_pos").cast("long").alias("t0_pos"))


@query(RETURNS + "select event_id, ticker, n_est, round(beta, 6) as beta, round(alpha, 6) as alpha from car where error is null")
def q_ols_beta(spark, d):
    return _cars(spark, d).filter("error is null").select("event_id", "ticker", F.col("n_est").cast("long").alias("n_est"), F.round("beta", 6).alias("beta"), F.round("alpha", 6).alias("alpha"))


@query(RETURNS + "select event_id, ticker, error, round(car_t1, 6) as car_t1, round(car_t3, 6) as car_t3, round(car_t5, 6) as car_t5 from car")
def q_car_windows(spark, d):
    return _cars(spark, d).select("event_id", "ticker", "error", *[F.round(f"car_t{k}", 6).alias(f"car_t{k}") for k in S.HORIZONS])


@query(RETURNS + f"""
 , l as (select event_type, severity, ticker as sector, 'car_t1' as "window", car_t1 as car from car union all select event_type, severity, ticker, 'car_t3', car_t3 from car union all select event_type, severity, ticker, 'car_t5', car_t5 from car),
 g as (select event_type, severity, sector, "window", count(car) as n, avg(car) as m, stddev_samp(car) as s from l group by all),
 p as (select *, case when n >= 3 and s > 0 then round({tp('(m / (s / sqrt(n)))', '(n - 1)')}, 4) end as p_value from g)
 select event_type, severity, sector, "window", n, round(m, 5) as mean_car, p_value, coalesce(p_value < 0.05, false) as significant_5pct from p""")
def q_group_ttest(spark, d):
    return S.group_statistics(_cars(spark, d).withColumn("sector", F.col("ticker")))


@query(RETURNS + f"""
 , l as (select event_id % 20 = 0 as ev, 'car_t1' as "window", car_t1 as car from car union all select event_id % 20 = 0, 'car_t3', car_t3 from car union all select event_id % 20 = 0, 'car_t5', car_t5 from car),
 g as (select "window", avg(car) filter (ev) as em, stddev_pop(car) filter (ev) as ep, stddev_samp(car) filter (ev) as es, count(car) filter (ev) as en, avg(car) filter (not ev) as rm_, stddev_pop(car) filter (not ev) as rp, stddev_samp(car) filter (not ev) as rs, count(car) filter (not ev) as rn from l group by 1),
 h as (select *, ((en - 1) * es * es + (rn - 1) * rs * rs) / (en + rn - 2) as pooled from g where en >= 3 and rn >= 3)
 select "window", round(em, 6) as event_mean, round(ep, 6) as event_std, round(rm_, 6) as random_mean, round(rp, 6) as random_std, en as event_n, rn as random_n,
 round({tp('(em / (es / sqrt(en)))', '(en - 1)')}, 4) as p_event_vs_zero, round({tp('(rm_ / (rs / sqrt(rn)))', '(rn - 1)')}, 4) as p_random_vs_zero,
 round({tp('((em - rm_) / sqrt(pooled * (1.0 / en + 1.0 / rn)))', '(en + rn - 2)')}, 4) as p_event_vs_random from h""")
def q_baseline_compare(spark, d):
    c = _cars(spark, d)
    return S.compare_baseline(c.filter("event_id % 20 = 0"), c.filter("event_id % 20 <> 0"))


POOL = """s as (select min(event_date) as a, max(event_date) as b from evm), p as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from s),
 pool as (select date, row_number() over (order by date) - 1 as k from p where not exists (select 1 from evm where abs(date_diff('day', event_date, p.date)) <= 10))"""


@query(f"with evm as ({V.EVM}), " + POOL + " select date from pool")
def q_date_pool(spark, d):
    return S.free_dates(V.view(spark, d, V.EVM))


DRAWN = """
 own as (select ticker, sum(c) over (order by ticker) - c as a, sum(c) over (order by ticker) as b from (select ticker, count(*) as c from carm where error is null and ticker is not null group by 1)),
 total as (select max(b) as nv, (select count(*) from pool) as np from own),
 draws as (select cast('0x' || substr(md5('42|' || id), 1, 15) as bigint) % np as k, cast('0x' || substr(md5('43|' || id), 1, 15) as bigint) % nv as j from (select unnest(range(cast(nv as bigint))) as id, np, nv from total where np > 0)),
 evr as (select 'RAND_' || date || '_' || ticker as event_id, date as event_date, ticker from draws join pool using (k) join own on j >= a and j < b)"""


@query(WITH + RATES + f", evm as ({V.EVM})" + study("evm", "m") + ", " + POOL + "," + DRAWN + study("evr", "r") + " select event_id, ticker, error, round(car_t1, 6) as car_t1, round(car_t3, 6) as car_t3, round(car_t5, 6) as car_t5 from carr")
def q_random_baseline(spark, d):
    events, model = V.view(spark, d, V.EVM), settled(S.market_model(S.aligned_returns(*_px(spark, d))))
    drawn = S.random_events(events, S.study(events, model))
    return S.study(drawn, model).select("event_id", "ticker", "error", *[F.round(f"car_t{k}", 6).alias(f"car_t{k}") for k in S.HORIZONS])


@query(WITH + RATES + f", evm as ({V.EVM})" + study("evm", "m") + ", " + POOL + "," + DRAWN + study("evr", "r") + f"""
 , l as (select true as ev, 'car_t1' as "window", car_t1 as car from carm union all select true, 'car_t3', car_t3 from carm union all select true, 'car_t5', car_t5 from carm
   union all select false, 'car_t1', car_t1 from carr union all select false, 'car_t3', car_t3 from carr union all select false, 'car_t5', car_t5 from carr),
 g as (select "window", avg(car) filter (ev) as em, stddev_pop(car) filter (ev) as ep, stddev_samp(car) filter (ev) as es, count(car) filter (ev) as en, avg(car) filter (not ev) as rm_, stddev_pop(car) filter (not ev) as rp, stddev_samp(car) filter (not ev) as rs, count(car) filter (not ev) as rn from l group by 1),
 h as (select *, ((en - 1) * es * es + (rn - 1) * rs * rs) / (en + rn - 2) as pooled from g where en >= 3 and rn >= 3)
 select "window", round(em, 6) as event_mean, round(ep, 6) as event_std, round(rm_, 6) as random_mean, round(rp, 6) as random_std, en as event_n, rn as random_n,
 round({tp('(em / (es / sqrt(en)))', '(en - 1)')}, 4) as p_event_vs_zero, round({tp('(rm_ / (rs / sqrt(rn)))', '(rn - 1)')}, 4) as p_random_vs_zero,
 round({tp('((em - rm_) / sqrt(pooled * (1.0 / en + 1.0 / rn)))', '(en + rn - 2)')}, 4) as p_event_vs_random from h""")
def q_events_against_random(spark, d):
    """The whole of the baseline: events to abnormal returns, against those of as many random dates."""
    events, model = V.view(spark, d, V.EVM), settled(S.market_model(S.aligned_returns(*_px(spark, d))))
    cars = settled(S.study(events, model))
    return S.compare_baseline(cars, S.study(S.random_events(events, cars), model))


def _asked(spark, d):
    a = V.view(spark, d, V.ART).filter("label <> 'not_related'")
    return a.select(F.col("pos").alias("cid"), X.type_code(F.col("label")).alias("type"), F.col("country_iso2").alias("iso2"), X.parse_date(F.col("event_date")).alias("day"))


def _cat(spark, d):
    return V.view(spark, d, V.CAT_SPARK).select(F.col("eventid").alias("g_pos"), F.col("eventtype").alias("g_type"), F.col("iso2").alias("g_iso2"), F.col("fromdate").alias("g_day"), F.col("alertlevel").alias("alert"))


CODE = "case label when 'earthquake' then 'EQ' when 'cyclone' then 'TC' when 'wildfire' then 'WF' when 'drought' then 'DR' else 'FL' end"
ASKED = WITH + f"""asked as (select pos as cid, {CODE} as type, country_iso2 as iso2, cast(event_date as date) as day from art where label <> 'not_related'),
 near as (select cid, eventid as g_pos, alertlevel as alert, abs(date_diff('day', fromdate, day)) as gap from asked join cat on type = eventtype and asked.iso2 = cat.iso2 and abs(date_diff('day', fromdate, day)) <= 7) """


@query(ASKED + ", b as (select *, row_number() over (partition by cid order by gap, g_pos) as rn from near) select a.cid, a.type, a.iso2, a.day, g_pos, cast(gap as int) as gap, case when alert in ('orange', 'red') then 'orange_or_red' when g_pos is not null then 'green' end as predicted_alert, case when alert in ('orange', 'red') then 1.0::double when g_pos is not null then 0.0::double end as prob from asked a left join b on a.cid = b.cid and rn = 1")
def q_nearest_catalogue(spark, d):
    return E.nearest_catalogue(_asked(spark, d), _cat(spark, d))


@query(ASKED + ", m as (select g_pos, count(*) as n, string_agg(cast(cid as varchar), ';' order by cid) as ids from near group by 1) select eventid as g_pos, eventtype as g_type, iso2 as g_iso2, fromdate as g_day, alertlevel as alert, coalesce(n, 0) as n_matching, coalesce(n, 0) > 0 as found, coalesce(n, 0) > 1 as over_split, coalesce(ids, '') as matching_ids from cat left join m on m.g_pos = eventid")
def q_catalogue_matches(spark, d):
    return E.catalogue_recall(_asked(spark, d), _cat(spark, d), lists=True)


@query(ASKED + ", m as (select g_pos, count(*) as n from near group by 1), f as (select eventtype as g_type, coalesce(n, 0) as n from cat left join m on m.g_pos = eventid) select g_type, count(*) as matchable, count(*) filter (n > 0) as n_found, round(count(*) filter (n > 0) / count(*), 4) as recall, round(count(*) filter (n > 1) / nullif(count(*) filter (n > 0), 0), 4) as over_split_rate from f group by grouping sets ((), (g_type))")
def q_catalogue_recall(spark, d):
    return E.recall_rates(E.catalogue_recall(_asked(spark, d), _cat(spark, d)))


# stated from the rule, not taken from the code
STOP = "['the','and','for','area','region','province','district','county','city','state','states','united','kingdom','republic','democratic','north','south','east','west','central','upper','lower','new','greater','metropolitan']"
PLACE = "concat(case p_partkey % 4 when 0 then 'Greater ' when 1 then 'The island of ' when 2 then 'Near Upper ' else 'Coast, Democratic Republic of ' end, p_name, case p_partkey % 3 when 0 then ' Sea' when 1 then ' Metropolitan Area' else ', Northern Province' end)"


@query(f"select p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower({PLACE}), '[a-z]{{3,}}')), lambda x: not list_contains({STOP}, x))), ' ') as tokens from part")
def q_location_tokens(spark, d):
    return V.view(spark, d, f"select p_partkey, {PLACE} as place from part").select("p_partkey", F.array_join(F.array_sort(X.location_tokens(F.col("place"))), " ").alias("tokens"))


@query("with p as (select p_partkey, split_part(p_name, ' ', 1) as w from part) select a.p_partkey, a.w = b.w or a.w = 'new' or b.w = 'new' or a.p_partkey % 5 = 0 or b.p_partkey % 5 = 0 as overlap from p a join p b on b.p_partkey = a.p_partkey + 1")
def q_token_overlap(spark, d):
    place = "case when p_partkey % 5 = 0 then 'The New State' else concat('United ', split_part(p_name, ' ', 1), ' Province of the Republic') end"
    p = V.view(spark, d, f"select p_partkey, {place} as place from part").select("p_partkey", X.location_tokens(F.col("place")).alias("t"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return p.join(b, "p_partkey").select("p_partkey", X.tokens_overlap(F.col("t"), F.col("u")).alias("overlap"))


@query(WITH + f"k as (select *, {CODE} as type, coalesce(country_iso2, 'UNKNOWN_COUNTRY') as country from art where label <> 'not_related') select type, country, count(*) as n, min(pos) as first_pos from k group by all")
def q_cluster_partition(spark, d):
    a = V.view(spark, d, V.ART).filter("label <> 'not_related'")
    return E.partition_keys(a).groupBy("type", "country").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


GREEDY = WITH.replace("with ", "with recursive ", 1) + f"""
 keyed as (select pos, {CODE} as type, coalesce(country_iso2, 'UNKNOWN_COUNTRY') as country, case when o_undated then null else cast(event_date as date) end as day,
  list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(location_text, '')), '[a-z]{{3,}}')), lambda x: not list_contains({STOP}, x))) as tokens from (select *, pos % 17 = 0 as o_undated from art) where label <> 'not_related'),
 line as (select *, row_number() over (partition by type, country order by day nulls last, pos) as rn from keyed),
 step as (
  select type, country, cast(0 as bigint) as rn, cast([] as struct(day date, sets varchar[][])[]) as st, cast(null as bigint) as pos, cast(null as bigint) as k from (select distinct type, country from line)
  union all
  select type, country, rn,
   case when k is null then list_append(st, {{'day': day, 'sets': [tokens]}}) else list_transform(st, lambda c, i: case when i = k then {{'day': coalesce(c.day, day), 'sets': case when list_contains(c.sets, tokens) then c.sets else list_append(c.sets, tokens) end}} else c end) end,
   pos, coalesce(k, len(st) + 1)
  from (select s.type, s.country, l.rn, s.st, l.pos, l.day, l.tokens,
    list_filter(list_transform(s.st, lambda c, i: case when (l.day is null or c.day is null or date_diff('day', c.day, l.day) <= 7) and (len(l.tokens) = 0 or len(list_filter(c.sets, lambda m: len(m) > 0 and not list_has_any(m, l.tokens))) = 0) then i end), lambda i: i is not null)[1] as k
   from step s join line l on l.type = s.type and l.country = s.country and l.rn = s.rn + 1)),
 greedy as (select pos, type, country, cast(k - 1 as int) as cluster, cast(rn - 1 as int) as seq from step where pos is not null) """


def _undated(spark, d):
    """Articles, each seventeenth without a date."""
    a = V.view(spark, d, V.ART).filter("label <> 'not_related'")
    return a.withColumn("event_date", F.when(F.col("pos") % 17 != 0, F.col("event_date")))


@query(GREEDY + "select pos, type, country, cluster, seq from greedy")
def q_greedy_clusters(spark, d):
    return E.greedy_clusters(_undated(spark, d))


MORE = """case when pos % 5 = 0 then cast('NaN' as double) else (pos % 50) / 10.0 end as magnitude, case when pos % 4 = 0 then null else cast(pos % 97 as double) end as dead,
 case when pos % 3 = 0 then null else pos % 180 - 90.0 end as lat, case when pos % 7 = 0 then null else pos % 360 - 180.0 end as lon,
 case pos % 4 when 0 then null when 1 then '' when 2 then concat(pos % 1000, ' people') else concat('few people ', pos % 3) end as rapidpopdescription,
 case when pos % 6 = 0 then null else pos % 100 <> 1 end as low_confidence"""


def _merged(spark, d):
    a = V.view(spark, d, f"select *, {MORE} from ({V.ART}) x").filter("label <> 'not_related'")
    a = a.withColumns({c: F.col(c).cast("double") for c in ("magnitude", "dead", "lat", "lon")})
    a = E.partition_keys(a).withColumn("cluster", F.floor(F.col("pos") / 600).cast("int")).withColumn("seq", F.col("pos"))
    return E.merge_clusters(a, ["type", "country", "cluster"], lists=True)


MERGED = WITH + f"""k as (select *, {MORE}, {CODE} as type, coalesce(country_iso2, 'UNKNOWN_COUNTRY') as country, cast(floor(pos / 600) as int) as cluster from art where label <> 'not_related'),
 lc as (select type, country, cluster, location_text as v, count(*) as n, min(pos) as s from k where location_text is not null group by all),
 l as (select type, country, cluster, arg_min(v, (-n, s)) as location_text from lc group by all),
 g as (select type, country, cluster, min(event_date) as event_date, count(*) as article_count, min(pos) as first_pos, string_agg(cast(idx as varchar), ',' order by pos) as articles, any_value(country_iso2) as primary_country,
  max(case when not isnan(magnitude) then cast(magnitude as double) end) as magnitude, max(dead) as dead, cast(arg_min(lat, pos) filter (lat is not null and lon is not null) as double) as lat, cast(arg_min(lon, pos) filter (lat is not null and lon is not null) as double) as lon,
  arg_min(rapidpopdescription, (-length(rapidpopdescription), pos)) filter (rapidpopdescription <> '') as rapidpopdescription, bool_and(coalesce(low_confidence, true)) as low_confidence from k group by all),
 m as (select g.*, l.location_text from g left join l using (type, country, cluster)) """


@query(MERGED + "select * from m")
def q_cluster_merge(spark, d):
    m = _merged(spark, d)
    return m.withColumn("articles", F.array_join(F.transform("article_indices", lambda i: i.cast("string")), ",")).drop("article_indices")


@query(MERGED + ", f as (select type, country, min(first_pos) as gf from m group by all) select printf('%s_%04d', m.type, row_number() over (order by gf, m.type, m.country, cluster) - 1) as event_id, m.type, m.country, m.cluster, first_pos from m join f on f.type = m.type and f.country = m.country")
def q_event_ids(spark, d):
    return E.number_events(_merged(spark, d)).select("event_id", "type", "country", "cluster", "first_pos")


@query(WITH + "t as (select pos, split_part(text, ' [SEP] ', 1) as title, substr(text, strpos(text, ' [SEP] ') + 7) as body from art) select pos, title, body, substr(body, 1, 40) as cut, concat(title, ' [SEP] ', body) as rebuilt from t")
def q_title_body(spark, d):
    t = V.view(spark, d, V.ART).select("pos", X.title_of(F.col("text")).alias("title"), X.body_of(F.col("text")).alias("body"))
    return t.select("*", F.substring("body", 1, 40).alias("cut"), X.build_text(F.col("title"), F.col("body")).alias("rebuilt"))


@query("select o_orderkey, case when o_orderkey % 4 = 3 then null else cast(o_orderdate as date) end as parsed from orders")
def q_parse_timestamp(spark, d):
    o = V.view(spark, d, "select * from orders")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMddHHmmss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("junk")
    return o.select("o_orderkey", F.to_date(X.parse_timestamp(raw)).alias("parsed"))


@query("select s_suppkey, s_suppkey * 1000 + 0.5 as a, s_suppkey * case s_suppkey % 4 when 0 then 1.0 when 1 then 1000.0 when 2 then 1000000.0 else 1000000000.0 end as b from supplier".replace("0.5 as a", "cast(0.5 as double) as a").replace("end as b", "end::double as b"))
def q_number_parse(spark, d):
    s = V.view(spark, d, "select * from supplier")
    k = F.col("s_suppkey")
    word = F.element_at(F.array(F.lit(""), F.lit(" k"), F.lit(" million"), F.lit("billion")), (k % 4 + 1).cast("int"))
    return s.select("s_suppkey", X.to_number(F.concat(F.format_number(k * 1000, 0), F.lit(".5"))).alias("a"), X.scaled_number(F.concat(F.lit("about "), F.format_number(k, 0), word, F.lit(" people"))).alias("b"))


@query("select l_orderkey, l_linenumber, round(case l_linenumber % 4 when 0 then l_quantity * 1.60934 when 1 then l_quantity * 1.852 when 2 then l_quantity * 3.6 else l_quantity end, 4) as kmh, round(case when l_linenumber % 2 = 0 then l_quantity * 0.404686 else l_quantity * 100 end, 4) as ha from lineitem")
def q_unit_convert(spark, d):
    x = V.view(spark, d, "select * from lineitem")
    k = F.col("l_linenumber")
    wind = F.element_at(F.array(*map(F.lit, ["mph", "knots", "m/s", "km/h"])), (k % 4 + 1).cast("int"))
    area = F.when(k % 2 == 0, "acres").otherwise("km2")
    return x.select("l_orderkey", "l_linenumber", F.round(X.convert_unit("maximum_wind_speed_kmh", F.col("l_quantity"), wind), 4).alias("kmh"), F.round(X.convert_unit("burned_area_ha", F.col("l_quantity"), area), 4).alias("ha"))


FIELD_SQL = {
    "magnitude": ("earthquake", r"magnitude ([0-9.]+)", "1.0"), "depth": ("earthquake", r"depth of ([0-9.]+)", "1.0"), "maximum_wind_speed_kmh": ("cyclone", r"with ([0-9]+) mph", "1.60934"),
    "maximum_storm_surge_m": ("cyclone", r"surge of ([0-9]+)", "0.3048"), "burned_area_ha": ("wildfire", r"burned ([0-9]+)", "0.404686"), "duration_days": ("drought", r"lasting ([0-9]+)", "30.0"),
    "affected_country_count": ("drought", r"([0-9]+) countries", "1.0"),
}
FIELD_VALUES = ", ".join(f"case when label = '{t}' then round(cast(regexp_extract(text, '{p}', 1) as double) * {f}, 4) end as {n}" for n, (t, p, f) in FIELD_SQL.items())


@query(WITH.rstrip(", ") + f" select pos, {FIELD_VALUES}, case when label in ('earthquake', 'flood') then cast(regexp_extract(text, 'killed ([0-9]+)', 1) as double) end as dead, case when label = 'flood' then cast(regexp_extract(text, '([0-9]+) people were displaced', 1) as double) end as displaced from art")
def q_extract_fields(spark, d):
    got = rules.extract_fields(V.view(spark, d, V.ART), ["pos"], fields=[*FIELD_SQL, "dead", "displaced"])
    return got.select("pos", *[F.round(n, 4).alias(n) for n in FIELD_SQL], "dead", "displaced")


#: label, text, field, factor (or the text that is wanted), unit, confidence: each of the catalogue's patterns matches one of them. The confidence was worked out by hand from the rule: base + 0.24 x
#: (0.42 + 0.12 x hits + 0.26 - 0.03 x distance), less 0.2 by a negation, more 0.04 by "official". Null: no find.
FINDS = [
    ("earthquake", "The quake had magnitude {n}.", "magnitude", 1.0, "", 0.821),
    ("earthquake", "It was {n} miles deep.", "depth", 1.60934, "km", 0.772),
    ("cyclone", "The storm blew at {n} knots.", "maximum_wind_speed_kmh", 1.852, "km/h", 0.71),
    ("cyclone", "A storm surge of {n} feet came.", "maximum_storm_surge_m", 0.3048, "m", 0.834),
    ("cyclone", "{n} thousand people were exposed.", "exposed_population", 1000.0, "people", 0.772),
    ("flood", "{n} mm of rain fell.", "rainfall_mm", 1.0, "mm", 0.692),
    ("flood", "{n} cm of rain fell.", "rainfall_mm", 10.0, "mm", 0.692),
    ("wildfire", "The fire burned {n} acres.", "burned_area_ha", 0.404686, "ha", 0.801),
    ("wildfire", "The fire burned {n} sq.km.", "burned_area_ha", 100.0, "ha", 0.801),
    ("drought", "The drought left {n} sq mi parched.", "affected_area_km2", 2.58999, "km2", 0.761),
    ("wildfire", "It raged on for {n} weeks.", "duration_days", 7.0, "days", 0.712),
    ("drought", "A {n}-month drought ended.", "duration_days", 30.0, "days", 0.712),
    ("flood", "Damage of ${n} million was counted.", "economic_loss_usd", 1e6, "usd", 0.742),
    ("drought", "{n} countries affected.", "affected_country_count", 1.0, "countries", 0.805),
    ("flood", "It killed {n} people.", "dead", 1.0, "people", 0.792),
    ("flood", "Officials say {n} people were injured.", "injured", 1.0, "people", 0.812),
    ("flood", "Perhaps not all: {n} people are missing.", "missing", 1.0, "people", 0.572),
    ("flood", "{n} residents fled their homes.", "displaced", 1.0, "people", 0.792),
    ("flood", "Evacuation orders for {n} residents came.", "people_affected", 1.0, "people", 0.771),
    ("earthquake", "Shaking felt: {n} thousand people in MMI VI.", "rapidpopdescription", "{n} thousand people in MMI VI", "", 0.774),
    ("earthquake", "Shaking felt: {n} thousand people in MMI VI.", "rapid_pop_people", 1000.0, "people", 0.724),
    ("cyclone", "The quake had magnitude {n}.", "magnitude", None, None, None),
    ("flood", "The fatality count isn't known. Reporters who came from afar asked about it for days, and {n} killed cows.", "injured", None, None, None),
    ("earthquake", "The magnitudes were {n} mw.", "magnitude", None, None, None),
    ("earthquake", "M {n} quake.", "magnitude", 1.0, "", 0.785),
    ("earthquake", "A {n}-magnitude quake.", "magnitude", 1.0, "", 0.821),
    ("earthquake", "Depth of {n} km.", "depth", 1.0, "km", 0.772),
    ("earthquake", "MMI VI affecting {n} thousand people.", "rapidpopdescription", "MMI VI affecting {n} thousand people", "", 0.752),
    ("cyclone", "The cyclone put at risk {n} homes.", "exposed_population", 1.0, "people", 0.794),
    ("wildfire", "Some {n} hectares scorched.", "burned_area_ha", 1.0, "ha", 0.772),
    ("wildfire", "Lost: {n} ha of forest were burned.", "burned_area_ha", 1.0, "ha", 0.772),
    ("wildfire", "The blaze spread over {n} acres.", "burned_area_ha", 0.404686, "ha", 0.772),
    ("flood", "All {n} km2 of farmland.", "affected_area_km2", 1.0, "km2", 0.732),
    ("drought", "After {n} days of drought.", "duration_days", 1.0, "days", 0.741),
    ("wildfire", "The blaze continued {n} weeks.", "duration_days", 7.0, "days", 0.741),
    ("drought", "Begun {n} months ago.", "duration_days", 30.0, "days", 0.705),
    ("flood", "Some ${n} million in damage.", "economic_loss_usd", 1e6, "usd", 0.742),
    ("drought", "Dry across {n} countries.", "affected_country_count", 1.0, "countries", 0.841),
    ("flood", "Some {n} people were killed.", "dead", 1.0, "people", 0.792),
    ("flood", "The death toll rose to {n}.", "dead", 1.0, "people", 0.785),
    ("flood", "Some {n} dead after rain.", "dead", 1.0, "people", 0.792),
    ("flood", "Water came, claiming {n} lives.", "dead", 1.0, "people", 0.792),
    ("flood", "More than {n} people perished.", "dead", 1.0, "people", 0.792),
    ("flood", "It injured {n} people.", "injured", 1.0, "people", 0.772),
    ("flood", "Missing persons rose to {n}.", "missing", 1.0, "people", 0.772),
    ("flood", "Some {n} people were evacuated.", "displaced", 1.0, "people", 0.792),
    ("flood", "It displaced some {n} families.", "displaced", 1.0, "people", 0.792),
    ("flood", "And {n} people are seeking shelter.", "displaced", 1.0, "people", 0.792),
    ("flood", "Some {n} families were affected.", "people_affected", 1.0, "people", 0.742),
    ("flood", "Rain affecting {n} households.", "people_affected", 1.0, "people", 0.742),
    ("flood", "Some {n} homes under evacuation orders.", "people_affected", 1.0, "people", 0.735),
    ("flood", "Some {n} residents were told to evacuate.", "people_affected", 1.0, "people", 0.735),
    ("flood", "Some {n} people are at risk.", "people_affected", 1.0, "people", 0.764),
]


def _case(values) -> str:
    return f"case o_orderkey % {len(FINDS)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


def _text_of(text: str, function: str = "concat") -> str:
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in text.split("{n}")]
    return f"{function}({', cast(10 + o_custkey % 90 as varchar(3)), '.join(parts)})"


FOUND = [("null" if w is None else _text_of(w) if isinstance(w, str) else f"cast(round((10 + o_custkey % 90) * cast({w} as double), 6) as varchar)") for _, _, _, w, _, _ in FINDS]


@query("select o_orderkey, " + _case(f"'{f[2]}'" for f in FINDS) + " as field, try_cast(" + _case(FOUND) + " as double) as number, " + _case(w if isinstance(f[3], str) else "null" for w, f in zip(FOUND, FINDS)) + " as words, " + _case("null" if f[4] is None else f"'{f[4]}'" for f in FINDS) + " as unit, cast(" + _case("null" if f[5] is None else str(f[5]) for f in FINDS) + " as double) as confidence from orders")
def q_extract_rules(spark, d):
    asked = V.view(spark, d, "select o_orderkey, " + _case(f"'{f[0]}'" for f in FINDS) + " as label, " + _case(_text_of(f[1]) for f in FINDS) + " as text, " + _case(f"'{f[2]}'" for f in FINDS) + " as field from orders")
    got = rules.extract_features(asked).withColumn("m", F.from_json("event_features", "struct<metrics:map<string,struct<value:string,unit:string,confidence:double>>>")["metrics"])
    got = got.withColumn("m", F.try_element_at("m", F.col("field")))
    return got.select("o_orderkey", "field", F.round(F.col("m.value").try_cast("double"), 6).alias("number"), F.when(F.col("field") == "rapidpopdescription", F.col("m.value")).alias("words"), "m.unit", "m.confidence")


SCORE = """case label when 'earthquake' then 18 * ln(1 + cast(regexp_extract(text, 'killed ([0-9]+)', 1) as double)) + 2.5 * cast(regexp_extract(text, 'magnitude ([0-9.]+)', 1) as double)
 when 'cyclone' then 0.08 * round(cast(regexp_extract(text, 'with ([0-9]+) mph', 1) as double) * 1.60934, 6) when 'wildfire' then 3 * ln(1 + round(cast(regexp_extract(text, 'burned ([0-9]+)', 1) as double) * 0.404686, 6) / 1000)
 when 'flood' then 18 * ln(1 + cast(regexp_extract(text, 'killed ([0-9]+)', 1) as double)) + 8 * ln(1 + cast(regexp_extract(text, '([0-9]+) people were displaced', 1) as double)) else 0.0 end"""


@query(WITH + f"s as (select pos, label, least(100, {SCORE}) as s from art) select pos, case label when 'earthquake' then 'EQ' when 'cyclone' then 'TC' when 'wildfire' then 'WF' when 'drought' then 'DR' when 'flood' then 'FL' end as event_type, round(cast(s as double), 3) as score, case when s >= 65 then 'high' when s >= 35 then 'medium' else 'low' end as tier, case when label <> 'not_related' then false end as low_confidence, case label when 'wildfire' then 'insurance,transportation' when 'drought' then 'transportation,agriculture' else 'transportation' end as sectors, case when label = 'earthquake' then 1.0::double end as rapid_missing from s")
def q_extract_full(spark, d):
    shape = "event_type string, metrics map<string,struct<value:string>>, low_confidence boolean, affected_sectors array<string>, stock_impact_summary struct<impact_score_0_100:double,impact_tier:string>"
    got = rules.extract_features(V.view(spark, d, V.ART)).select("pos", F.from_json("event_features", shape).alias("r"))
    missing = F.try_element_at("r.metrics", F.lit("rapid_missing"))["value"].cast("double")
    return got.select("pos", "r.event_type", F.col("r.stock_impact_summary.impact_score_0_100").alias("score"), F.col("r.stock_impact_summary.impact_tier").alias("tier"), "r.low_confidence", F.array_join("r.affected_sectors", ",").alias("sectors"), missing.alias("rapid_missing"))


@query("select s_suppkey, round(cast(s_suppkey % 90 as double) + 0.25, 4) * case when s_suppkey % 2 = 0 then 1 else -1 end as lat, round(cast(s_suppkey % 180 as double) + 0.5, 4) as lon from supplier")
def q_coordinates(spark, d):
    k = F.col("s_suppkey")
    n, e = (k % 90).cast("string"), (k % 180).cast("string")
    text = F.when(k % 2 == 0, F.concat(F.lit("at "), n, F.lit(".25°N, "), e, F.lit(".5°E"))).otherwise(F.concat(F.lit("latitude -"), n, F.lit(".25, longitude "), e, F.lit(".5")))
    return V.view(spark, d, "select * from supplier").select("s_suppkey", X.coordinates(text).alias("c")).select("s_suppkey", "c.lat", "c.lon")


@query("select a.n_nationkey as a, b.n_nationkey as b, round(2 * 6371.0 * asin(sqrt(pow(sin(radians((b.n_nationkey - a.n_nationkey) * 3.0) / 2), 2) + cos(radians(a.n_nationkey * 3.0)) * cos(radians(b.n_nationkey * 3.0)) * pow(sin(radians((b.n_nationkey - a.n_nationkey) * 5.0) / 2), 2))), 3) as km from nation a join nation b on a.n_regionkey = b.n_regionkey")
def q_haversine(spark, d):
    n = V.view(spark, d, "select * from nation")
    j = n.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey")
    return j.select("a", "b", F.round(X.haversine(F.col("a") * 3.0, F.col("a") * 5.0, F.col("b") * 3.0, F.col("b") * 5.0), 3).alias("km"))


@query("with s as (select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from documents) select doc_id, cast(len(s) as bigint) as n, s[1] as first, s[-1] as last from s")
def q_sentences(spark, d):
    s = V.view(spark, d, "select * from documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


#: Phrases and the sectors that they name.
PHRASES = [
    ("The insurer spoke of a claims payout.", "insurance"), ("Crops failed and livestock died.", "agriculture"), ("A power outage hit the oil field.", "energy"), ("The water shortage and grid failure go on.", "utilities"),
    ("Rebuilding began after road damage.", "construction"), ("The hotel closed.", "tourism"), ("Logging stopped.", "timber"), ("The copper mine closed.", "mining"), ("Garment makers wait.", "manufacturing"),
    ("The port closed, export halted.", "shipping"), ("The stock market fell.", "financial"), ("The flood reached the farm.", "agriculture"), ("An insured hotel lost its power line.", "insurance,tourism,utilities"),
    ("Wildfire smoke hid the forest.", "timber"), ("Nothing to tell; the portly hotelier slept.", ""), ("REINSURERS AND AIRLINE shares", "insurance,tourism"),
]


def _phrase(k: int) -> str:
    return f"case o_orderkey % {len(PHRASES)} " + " ".join(f"when {i} then '{p[k]}'" for i, p in enumerate(PHRASES)) + " end"


@query(f"select o_orderkey, {_phrase(1)} as sectors from orders")
def q_industry(spark, d):
    return V.view(spark, d, f"select o_orderkey, {_phrase(0)} as text from orders").select("o_orderkey", F.array_join(X.industries(F.col("text")), ",").alias("sectors"))


# stated from the rule: by hazard, by country, and what the articles name
LINKED = """prior as (select * from (values ('EQ', ['insurance','construction']), ('TC', ['insurance','agriculture']), ('WF', ['insurance','utilities','timber']), ('DR', ['agriculture','insurance']), ('FL', ['insurance','agriculture','construction'])) p(type, a)),
 kb as (select * from (values ('US', ['insurance','construction','utilities','agriculture','energy']), ('JP', ['insurance','construction','automotive','electronics','utilities']), ('CN', ['agriculture','construction','coal','insurance','tourism']), ('IN', ['agriculture','insurance','infrastructure','power','tourism']),
  ('AU', ['agriculture','mining','insurance','tourism','utilities']), ('ID', ['palm_oil','mining','tourism','agriculture','insurance']), ('PH', ['agriculture','tourism','insurance','utilities','construction']), ('NP', ['tourism','hydropower','agriculture','insurance']), ('TR', ['construction','insurance','tourism','agriculture','textiles']), ('MX', ['agriculture','tourism','oil','insurance','construction']),
  ('PE', ['copper_mining','agriculture','insurance','fishing'])) k(iso2, b)),
 named as (select * from (values ('WF', ['insurance','timber']), ('DR', ['agriculture'])) n(type, c)),
 fund as (select map(['insurance','agriculture','energy','utilities','construction','tourism','timber','mining','manufacturing','shipping','financial'], ['IAK','MOO','XLE','XLU','XHB','JETS','WOOD','XME','XLI','BOAT','XLF']) as f)"""
SECTORS = "list_filter(list_concat(list_concat(coalesce(a, []), coalesce(b, [])), coalesce(c, [])), lambda x, i: list_position(list_concat(list_concat(coalesce(a, []), coalesce(b, [])), coalesce(c, [])), x) = i)"
FUNDS = "list_filter(list_transform(s, lambda x: f[x]), lambda y: y is not null)"


@query(WITH + f"""k as (select pos, country_iso2 as iso2, {CODE} as type from art where label <> 'not_related'), {LINKED},
 l as (select pos, {SECTORS} as s, iso2 from k left join prior using (type) left join kb using (iso2) left join named using (type))
 select pos, array_to_string(s, ',') as key_industries, array_to_string({FUNDS}, ',') as sector_etfs, map(['US','JP','CN','IN','AU','ID','PH','NP','TR','MX'], ['SPY','EWJ','FXI','INDA','EWA','IDX','EPHE','^NEPSE','TUR','EWW'])[iso2] as index_ticker, true as linked from l, fund""")
def q_link_sectors(spark, d):
    a = V.view(spark, d, V.ART).filter("label <> 'not_related'").withColumn("type", X.type_code(F.col("label")))
    got = E.link_sectors(a, "type", "country_iso2", "text")
    return got.select("pos", F.array_join("key_industries", ",").alias("key_industries"), F.array_join("sector_etfs", ",").alias("sector_etfs"), "index_ticker", "linked")


#: Prices under the names of funds; other funds have none.
FX = V.PX.replace("p_type as ticker", "case p_type when 'ECONOMY' then 'SPY' when 'LARGE' then 'EWJ' when 'MEDIUM' then 'IAK' when 'PROMO' then 'MOO' when 'SMALL' then 'XHB' else 'XLU' end as ticker")
FUNDED = f"with art as ({ART}), px as ({FX}), mkt as ({V.MKT}), {LINKED}," + RATES + f""",
 k as (select pos, {CODE} as type, country_iso2 as iso2, case when pos % 23 <> 0 then cast(event_date as date) end as day from art where label <> 'not_related'),
 l as (select pos, day, type, iso2, list_filter(list_concat(a, coalesce(b, [])), lambda x, i: list_position(list_concat(a, coalesce(b, [])), x) = i) as s from k left join prior using (type) left join kb using (iso2))"""


def _linked(spark, d):
    a = V.view(spark, d, V.ART).filter("label <> 'not_related'").withColumn("type", X.type_code(F.col("label"))).withColumn("sectors_from_text", F.array().cast("array<string>"))
    dated = F.when(F.col("event_id") % 23 != 0, F.to_date("event_date"))
    return E.link_sectors(a.withColumnRenamed("pos", "event_id").withColumn("event_date", dated).withColumn("predicted_alert", F.lit("green")), "type", "country_iso2", None)


@query(FUNDED + """, m as (select pos as event_id, day as event_date, f[x] as ticker, x as sector from (select pos, day, unnest(s) as x from l where day is not null), fund where f[x] is not null)""" + study("m", "f") + " select event_id, ticker, sector, case when ticker not in (select ticker from al) then 'no_price_data' else error end as error, round(car_t1, 6) as car_t1, round(car_t3, 6) as car_t3, round(car_t5, 6) as car_t5 from carf")
def q_fund_study(spark, d):
    """Events to their funds to abnormal returns; events without a date or a fund have no rows."""
    cars, _ = P.event_study(_linked(spark, d), V.view(spark, d, FX), V.view(spark, d, V.MKT))
    return cars.select("event_id", "ticker", "sector", "error", *[F.round(f"car_t{k}", 6).alias(f"car_t{k}") for k in S.HORIZONS])


INDEXES = "map(['US','JP','CN','IN','AU','ID','PH','NP','TR','MX'], ['SPY','EWJ','FXI','INDA','EWA','IDX','EPHE','^NEPSE','TUR','EWW'])"


@query(FUNDED + f", o as (select pos as event_id, day as event_date, coalesce({INDEXES}[iso2], list_filter(list_transform(s, lambda x: f[x]), lambda y: y is not null)[1]) as ticker from l, fund)" + study("o", "s") + " select event_id, ticker, case when event_date is null then 'missing_ticker_or_date' when ticker not in (select ticker from al) then 'no_price_data' else error end as error, case when error is null then round(beta, 6) end as beta, round(car_t1, 6) as car_t1, round(car_t3, 6) as car_t3, round(car_t5, 6) as car_t5 from cars")
def q_single_ticker_study(spark, d):
    """One ticker an event: its country's index, or else its first fund."""
    cars = P.single_ticker_study(_linked(spark, d), V.view(spark, d, FX), V.view(spark, d, V.MKT))
    return cars.select("event_id", "ticker", "error", F.round("beta", 6).alias("beta"), *[F.round(f"car_t{k}", 6).alias(f"car_t{k}") for k in S.HORIZONS])


@query(f"with px as ({V.PX}) select ticker, date, round(close, 2) as close from px where ticker in ('ECONOMY', 'PROMO', 'STANDARD') and date >= date '1996-03-01' and date < date '2000-01-01'")
def q_price_history(spark, d):
    """Prices from files by ticker, with a filter that reaches the source: only those tickers' files are opened."""
    folder = f"{shared_folder(spark)}/prices-{uuid.uuid4().hex}"
    write_prices(V.view(spark, d, V.PX), folder)
    wanted = F.col("ticker").isin("ECONOMY", "PROMO", "STANDARD") & (F.col("date") >= F.lit(date(1996, 3, 1))) & (F.col("date") < F.lit(date(2000, 1, 1)))
    return read_prices(spark, path=folder).filter(wanted).select("ticker", "date", F.round("close", 2).alias("close"))


FROM = "case when eventid % 17 = 0 then null when eventid % 19 = 0 then 'bad' else concat(cast(fromdate as {s}), 'T00:00:00') end"


@query(f"with cat as ({V.CAT_DUCK}) select eventid, case when eventid % 17 = 0 or eventid % 19 = 0 then null when fromdate < date '1998-01-01' then 'train' when fromdate < date '2000-01-01' then 'val' else 'test' end as split from cat")
def q_catalogue_split(spark, d):
    rows = V.view(spark, d, V.CAT_SPARK).withColumn("fromdate", F.expr(FROM.format(s="string")))
    return severity.time_split(rows, "fromdate", "1998-01-01", "2000-01-01").select("eventid", "split")


@query(f"with r as (select eventid, eventtype, alertlevel, eventid * 7919 % 1000003 as n from ({V.CAT_DUCK})), a as (select 'level' as by_, *, row_number() over (partition by eventtype, alertlevel order by n) as rn from r), b as (select 'type' as by_, *, row_number() over (partition by eventtype order by n) as rn from r) select by_, eventid, eventtype, alertlevel, n from a where rn <= 10 union all select by_, eventid, eventtype, alertlevel, n from b where rn <= 25")
def q_balanced_rows(spark, d):
    """The first 10 entries of each type and level, and the first 25 of each type."""
    rows = V.view(spark, d, V.CAT_SPARK).select("eventid", "eventtype", "alertlevel", F.expr("eventid * 7919 % 1000003").alias("n"))
    return rest.balanced(rows, 10, 25).withColumn("by_", F.lit("level")).unionByName(rest.balanced(rows, 0, 25).withColumn("by_", F.lit("type")))


#: What a quake's people are: the text's number and scale; 100 for a few.
QUAKES = """select p_partkey, case p_partkey % 6 when 0 then null when 1 then 'Few people in MMI VI' when 2 then concat(cast(p_size as {s}), ' thousand people in MMI VII') when 3 then concat(cast(p_size as {s}), '.5 million in MMI V') when 4 then 'unknown' else ' ' end as rapidpopdescription,
 case p_partkey % 4 when 0 then 'nan' when 1 then 'n/a' else cast(p_size as {s}) end as magnitude, case p_partkey % 5 when 0 then null else concat(cast(p_size as {s}), '.25') end as depth from part"""


@query("with q as (" + QUAKES.format(s="varchar") + """), n as (select *, case p_partkey % 6 when 1 then 100.0::double when 2 then cast(split_part(rapidpopdescription, ' ', 1) as double) * 1000 when 3 then cast(split_part(rapidpopdescription, ' ', 1) as double) * 1000000 end as people from q)
 select p_partkey, case when p_partkey % 4 > 1 then cast(magnitude as double) end as magnitude, cast(depth as double) as depth, people as rapid_pop_people, round(ln(1 + people), 6) as rapid_pop_log, case when p_partkey % 6 in (0, 5) then 1.0::double else 0.0::double end as rapid_missing, case when p_partkey % 6 = 1 then 1.0::double else 0.0::double end as rapid_few_people, case when p_partkey % 6 = 4 then 1.0::double else 0.0::double end as rapid_unparsed from n""")
def q_model_features(spark, d):
    got = severity.with_features(V.view(spark, d, QUAKES.format(s="string")), "EQ")
    return got.select("p_partkey", *[F.round(c, 6).alias(c) if c == "rapid_pop_log" else F.col(c) for c in severity.FEATURES["EQ"]])


BASE = """select o_orderkey as idx, case o_orderpriority when '1-URGENT' then 'flood' when '2-HIGH' then 'drought' when '3-MEDIUM' then 'error' when '4-NOT SPECIFIED' then null else 'cyclone' end as label,
 case o_orderkey % 4 when 0 then ' Flood' when 1 then 'drought' when 2 then 'cyclone ' else 'wildfire' end as old_event_type from orders"""


@query(f"with b as ({BASE}), p as (select label, trim(lower(old_event_type)) as pred from b where label is not null and label <> 'error'), c as (select * from (values (0, 'flood'), (1, 'drought'), (2, 'cyclone'), (3, 'quake')) v(nr, c)), g as (select nr, c, (select count(*) from p where label = c) as support, (select count(*) from p where pred = c) as predicted, (select count(*) from p where label = c and pred = c) as tp from c), f as (select nr, c as label, round(coalesce(tp / nullif(predicted, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) as f1, support from g) select * from f union all select 4, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f union all select 5, 'accuracy', round(count(*) filter (label = pred) / count(*), 6), round(count(*) filter (label = pred) / count(*), 6), round(count(*) filter (label = pred) / count(*), 6), count(*) from p")
def q_rule_baseline(spark, d):
    rows = V.view(spark, d, BASE)
    return EV.rule_baseline(rows.select("idx", "label"), ["flood", "drought", "cyclone", "quake"], articles=rows.select("idx", "old_event_type"))


@query("select o_orderkey, round(least(100, 18 * ln(1 + o_custkey % 300) + 8 * ln(1 + o_custkey % 5000) + 2.5 * (o_orderkey % 9)), 4) as score, case when least(100, 18 * ln(1 + o_custkey % 300) + 8 * ln(1 + o_custkey % 5000) + 2.5 * (o_orderkey % 9)) >= 65 then 'high' when least(100, 18 * ln(1 + o_custkey % 300) + 8 * ln(1 + o_custkey % 5000) + 2.5 * (o_orderkey % 9)) >= 35 then 'medium' else 'low' end as tier from orders")
def q_impact_score(spark, d):
    z = F.lit(None).cast("double")
    s = X.impact_score(F.col("o_custkey") % 300, F.col("o_custkey") % 5000, z, z, z, F.col("o_orderkey") % 9, z)
    return V.view(spark, d, "select * from orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.round("s", 4).alias("score"), X.impact_tier(F.col("s")).alias("tier"))


@query("select s_suppkey, case s_suppkey % 4 when 0 then 100.0 when 1 then s_suppkey * 1000.0 else null end::double as people, round(ln(1 + case s_suppkey % 4 when 0 then 100.0 when 1 then s_suppkey * 1000.0 else null end), 6) as log, case when s_suppkey % 4 = 2 then 1.0 else 0.0 end::double as missing, case when s_suppkey % 4 = 3 then 1.0 else 0.0 end::double as unparsed from supplier")
def q_rapid_population(spark, d):
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, "few people in MMI VI").when(k % 4 == 1, F.concat(k.cast("string"), F.lit(" thousand people"))).when(k % 4 == 3, "unknown")
    r = V.view(spark, d, "select * from supplier").select("s_suppkey", X.rapid_population(text).alias("r"))
    return r.select("s_suppkey", "r.people", F.round("r.log", 6).alias("log"), "r.missing", "r.unparsed")


@query("select o_orderkey, case when o_custkey % 200 > 100 or 100 * (o_orderkey % 2000) > 80000 then 'orange_or_red' else 'green' end as alert from orders")
def q_flood_rule(spark, d):
    return V.view(spark, d, "select * from orders").select("o_orderkey", X.flood_severity(F.col("o_custkey") % 200, 100 * (F.col("o_orderkey") % 2000)).alias("alert"))


def _timed(spark, d, text, type_="EQ"):
    e = V.view(spark, d, "select * from orders").withColumn("base", F.to_date("o_orderdate")).withColumn("type", F.lit(type_) if isinstance(type_, str) else type_).withColumn("text", text)
    return when.event_time(e, "text", "base", "type").select("o_orderkey", "event_date", "granularity", "time_type", "method")


@query("select o_orderkey, cast(o_orderdate as date) - 3 as event_date, 'day' as granularity, 'event_date' as time_type, 'step1_absolute' as method from orders")
def q_time_absolute(spark, d):
    day = F.date_sub(F.to_date("o_orderdate"), 3)
    return _timed(spark, d, F.concat(F.lit("Officials met. A quake struck on "), F.date_format(day, "MMMM d, yyyy"), F.lit(". Many fled.")))


@query("select o_orderkey, cast(o_orderdate as date) - cast(1 + o_orderkey % 9 as int) as event_date, 'day' as granularity, 'event_date' as time_type, 'step2_trigger_relative' as method from orders")
def q_time_relative(spark, d):
    return _timed(spark, d, F.concat(F.lit("A quake struck "), (1 + F.col("o_orderkey") % 9).cast("string"), F.lit(" days ago. Many fled.")))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) end as event_date, case when o_orderkey % 2 = 0 then 'day' else 'unknown' end as granularity, case when o_orderkey % 2 = 0 then 'event_date' else 'unknown' end as time_type, case when o_orderkey % 2 = 0 then 'step5_fallback' else 'none' end as method from orders")
def q_time_fallback(spark, d):
    return _timed(spark, d, F.when(F.col("o_orderkey") % 2 == 0, "People wait for news.").otherwise("The recovery is under way. Schools reopened."))


_MAY, _MARCH = ("case when make_date(year(b), {m}, 1) > b then make_date(year(b) - 1, {m}, 1) else make_date(year(b), {m}, 1) end".format(m=m) for m in (5, 3))
#: Hazard, text (with {a}: the date 20 days before the article's, {y}: the day before, as month and day, {w}: 1 to 4), and what is wanted: date, granularity, kind, method.
TIMES = [
    ("DR", "It hasn't rained since 2022.", "date '2022-01-01'", "year", "date_range", "step3_since_year"),
    ("DR", "Fields are dry since May.", _MAY, "month", "date_range", "step3_since_month"),
    ("DR", "The driest year since 1950. Wells are empty.", "cast(null as date)", "unknown", "unknown", "none"),
    ("FL", "Rain fell this week.", "cast(date_trunc('week', b) as date)", "day", "event_date", "step4_vague"),
    ("FL", "Rain fell last week.", "cast(date_trunc('week', b) as date) - 7", "day", "event_date", "step4_vague"),
    ("FL", "Rain fell in recent days.", "cast(date_trunc('month', b) as date)", "month", "event_date", "step4_vague"),
    ("TC", "A storm hit the coast in March.", _MARCH, "month", "event_date", "step1_month_only"),
    ("EQ", "Quake kills ten [SEP] It came yesterday.", "b - 1", "day", "event_date", "step2_trigger_relative"),
    ("FL", "Markets were calm. It happened on {a}.", "b - 20", "day", "event_date", "step1_absolute"),
    ("FL", "Cleanup began on {y}.", "cast(null as date)", "unknown", "unknown", "none"),
    ("FL", "The storm struck in the wake of rain {w} weeks ago.", "b - cast(7 * (1 + o_orderkey % 4) as int)", "day", "event_date", "step2_trigger_relative"),
    ("FL", "Recovery goes on after what hit us in May.", _MAY, "month", "event_date", "step1_month_only"),
    ("EQ", "Anniversary mass. A quake struck {w} weeks ago.", "b - cast(7 * (1 + o_orderkey % 4) as int)", "day", "event_date", "step2_trigger_relative"),
    ("FL", "The rain came on {a}. A flood hit on 1880-01-05.", "b - 20", "day", "event_date", "step1_absolute"),
    ("DR", "No rain at all.", "cast(null as date)", "unknown", "unknown", "none"),
    ("WF", "Quiet day. Nothing new. The sky is blue. The flames struck.", "b", "day", "event_date", "step5_fallback"),
]


def _time(k: int, quoted: bool = True) -> str:
    return f"case o_orderkey % {len(TIMES)} " + " ".join(f"when {i} then " + (f"'{t[k]}'" if quoted else t[k]) for i, t in enumerate(TIMES)) + " end"


@query(f"select o_orderkey, {_time(2, False)} as event_date, {_time(3)} as granularity, {_time(4)} as time_type, {_time(5)} as method from (select o_orderkey, cast(o_orderdate as date) as b from orders)")
def q_time_cascade(spark, d):
    base = F.to_date("o_orderdate")
    text = F.expr(_time(1).replace("hasn't", "has not"))
    for mark, value in (("{a}", F.date_format(F.date_sub(base, 20), "yyyy-MM-dd")), ("{y}", F.date_format(F.date_sub(base, 1), "MMMM d")), ("{w}", (1 + F.col("o_orderkey") % 4).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return _timed(spark, d, text, F.expr(_time(0)))


@query("select o_orderkey, case when cast(o_orderdate as timestamp) <= timestamp '1998-04-30' then 'train' when cast(o_orderdate as timestamp) <= timestamp '1999-07-31' then 'val' else 'test' end as split from orders")
def q_time_split(spark, d):
    return T.time_split(V.view(spark, d, "select * from orders"), F.col("o_orderdate").cast("timestamp"), "1998-04-30", "1999-07-31").select("o_orderkey", "split")


@query("with s as (select o_custkey, case when cast(o_orderdate as timestamp) <= timestamp '1998-04-30' then 'train' when cast(o_orderdate as timestamp) <= timestamp '1999-07-31' then 'val' else 'test' end as split from orders) select o_custkey, count(distinct split) as n_splits from s group by 1 having count(distinct split) > 1")
def q_leakage(spark, d):
    return T.leaked_keys(T.time_split(V.view(spark, d, "select * from orders"), F.col("o_orderdate").cast("timestamp"), "1998-04-30", "1999-07-31"), ["o_custkey"])


@query("select o_orderpriority, o_orderkey, rn from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders) where rn <= 30")
def q_stratified_cap(spark, d):
    return T.capped(V.view(spark, d, "select * from orders"), ["o_orderpriority"], ["o_orderkey"], 30).select("o_orderpriority", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('42|' || o_orderkey), o_orderkey) as rn, count(*) over (partition by o_orderpriority) as n from orders) select o_orderkey, o_orderpriority, case when rn <= ceil(n * 0.2) then 'test' when rn <= ceil(n * 0.2) + ceil(n * 0.1) then 'val' else 'train' end as split from r")
def q_random_split(spark, d):
    return T.random_split(V.view(spark, d, "select * from orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "split")


@query("with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('42|' || o_orderkey), o_orderkey) as rn from orders) select o_orderkey, (rn - 1) % 5 as fold from r")
def q_folds(spark, d):
    return T.folds(V.view(spark, d, "select * from orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", F.col("fold").cast("long").alias("fold"))


@query("with a as (select *, o_orderkey % 10 = 0 as t from orders), have as (select o_orderstatus, count(*) as c from a where t group by 1), r as (select *, row_number() over (partition by o_orderstatus order by md5('42|' || o_orderkey), o_orderkey) as rn from a where not t) select o_orderkey, o_orderstatus, false as _augmented from a where t union all select o_orderkey, o_orderstatus, true from r left join have using (o_orderstatus) where rn <= 500 - coalesce(c, 0)")
def q_top_up(spark, d):
    o = V.view(spark, d, "select o_orderkey, o_orderstatus from orders")
    return T.top_up(o.filter("o_orderkey % 10 = 0"), o.filter("o_orderkey % 10 <> 0"), "o_orderstatus", "o_orderkey", 500)


@query("with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('42|' || o_orderkey), o_orderkey) as rn from orders) select o_orderkey, o_orderpriority, row_number() over (order by md5('43|' || o_orderkey), o_orderkey) as shuffled from r where rn <= 40")
def q_sampled(spark, d):
    return T.sampled(V.view(spark, d, "select o_orderkey, o_orderpriority from orders"), "o_orderpriority", "o_orderkey", 40)


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1")
def q_dedupe_first(spark, d):
    return T.keep_first(V.view(spark, d, "select * from events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where quality = 1)")
def q_pending(spark, d):
    done = V.view(spark, d, "select * from labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("label"))
    return T.pending(V.view(spark, d, "select * from documents").select("doc_id", "lang"), done, "doc_id", "label")


@query("select event_type, count(*) as n from events group by 1")
def q_union_splits(spark, d):
    e = V.view(spark, d, "select * from events")
    return e.filter("event_id % 3 <=> 0").unionByName(e.filter("not event_id % 3 <=> 0").drop("props"), allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"))


PRED = "with p as (select l_returnflag as label, case when l_quantity > 30 then 'A' when l_quantity > 15 then 'N' else 'R' end as pred from lineitem) "


def _pred(spark, d):
    return V.view(spark, d, "select * from lineitem").select(F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") > 30, "A").when(F.col("l_quantity") > 15, "N").otherwise("R").alias("pred"))


@query(PRED + "select label, pred, count(*) as n from p group by all")
def q_confusion(spark, d):
    return T.confusion(_pred(spark, d))


@query(PRED + ", c as (select distinct label as c from p union select distinct pred from p), g as (select c, (select count(*) from p where label = c) as support, (select count(*) from p where pred = c) as predicted, (select count(*) from p where label = c and pred = c) as tp from c) select c as label, round(coalesce(tp / nullif(predicted, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall, round(coalesce(2 * (tp / predicted) * (tp / support) / nullif(tp / predicted + tp / support, 0), 0), 6) as f1, support from g")
def q_report(spark, d):
    return T.classification_report(_pred(spark, d))


@query("with s as (select l_quantity as s, l_returnflag = 'R' as y from lineitem), t as (select s, count(*) filter (y) as tp, count(*) filter (not y) as fp from s group by 1), c as (select *, sum(tp) over (order by s desc) as ctp, sum(fp) over (order by s desc) as cfp from t) select cast(sum(tp) as bigint) as n_pos, cast(sum(fp) as bigint) as n_neg, round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 6) as roc_auc, round(sum(tp * ctp / (ctp + cfp)) / sum(tp), 6) as pr_auc from c")
def q_ranking(spark, d):
    return T.ranking_metrics(V.view(spark, d, "select * from lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), "l_quantity", "y")


@query("with e as (select l_returnflag as field, l_quantity as g, l_quantity + l_linenumber - 2 as p from lineitem), r as (select *, abs(p - g) / g as e from e) select field, count(*) as n, 1.0::double as coverage, round(count(*) filter (e <= 0.05) / count(*), 6) as within_5, round(count(*) filter (e <= 0.2) / count(*), 6) as within_20, round(count(*) filter (e <= 0.5) / count(*), 6) as within_50, round(median(e), 6) as median_error from r group by 1")
def q_thresholds(spark, d):
    x = V.view(spark, d, "select * from lineitem").select(F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("g"), (F.col("l_quantity") + F.col("l_linenumber") - 2).alias("p"))
    return T.threshold_accuracy(x, "field", "g", "p")


@query("select o_orderpriority, count(*) as n, round((select count(*) from orders) / ((select count(distinct o_orderpriority) from orders) * count(*)), 6) as weight from orders group by 1")
def q_class_weights(spark, d):
    return T.class_weights(V.view(spark, d, "select * from orders"), "o_orderpriority")


@query(WITH.rstrip(", ") + " select 'country_iso2' as \"column\", round(avg(case when country_iso2 is null then 1.0 else 0.0 end), 6) as null_rate from art union all select 'location_text', round(avg(case when location_text is null then 1.0 else 0.0 end), 6) from art")
def q_null_rates(spark, d):
    return T.null_rates(V.view(spark, d, V.ART), ["country_iso2", "location_text"])


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, concat('{\"k\":', cast(cast(json_extract(props, '$.k') as bigint) as varchar), '}') as again from events")
def q_json_features(spark, d):
    e = V.view(spark, d, "select * from events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", "p.k", F.to_json("p").alias("again"))


@query("select o_orderkey, greatest(0, date_diff('day', cast(o_orderdate as date), date '1998-01-01')) as days, case o_orderkey % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 1 end as level from orders")
def q_duration_level(spark, d):
    o = V.view(spark, d, "select * from orders")
    word = F.element_at(F.array(*map(F.lit, ["Minor drought", " MEDIUM", "a severe storm", "extreme (red)", "extreme, once minor", "Green alert"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", X.duration_days(F.col("o_orderdate"), F.lit("1998-01-01")).cast("long").alias("days"), X.severity_level(word).alias("level"))


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'flood' when 1 then 'drought' else 'error' end as label from supplier")
def q_parse_label(spark, d):
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, "<think>drought?</think>LABEL: flood").when(k == 1, "not a flood, it is a drought.").otherwise("unsure")
    return V.view(spark, d, "select * from supplier").select("s_suppkey", R.parse_label(text, ["flood", "drought"]).alias("label"))


NAMES = ["Algeria", "Argentina", "Brazil", "Canada", "Egypt", "Ethiopia", "France", "Germany", "India", "Indonesia", "Iran", "Iraq", "Japan", "Jordan", "Kenya", "Morocco", "Mozambique", "Peru", "China", "Romania", "Saudi Arabia", "Vietnam", "Russia", "United Kingdom", "United States"]
NATIONS = "['DZ','AR','BR','CA','EG','ET','FR','DE','IN','ID','IR','IQ','JP','JO','KE','MA','MZ','PE','CN','RO','SA','VN','RU','GB','US'][n_nationkey + 1]"
NAMED = "case n_nationkey " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(NAMES)) + " end"
TITLED = f"select s_suppkey, n_nationkey, {NAMED} as name from supplier join nation on n_nationkey = s_nationkey"


@query(f"with t as ({TITLED}) select s_suppkey, case when s_suppkey % 5 = 3 then null else name end as location_text, case when s_suppkey % 5 = 3 then null else {NATIONS} end as country_iso2, case when s_suppkey % 7 = 0 then 12.5::double end as lat, case when s_suppkey % 7 = 0 then -45.25::double end as lon, case when s_suppkey % 7 = 0 then 'coords_text' when s_suppkey % 5 = 3 then 'none' else 'location' end as loc_confidence from t")
def q_location(spark, d):
    t = V.view(spark, d, TITLED)
    k = F.col("s_suppkey") % 5
    title = F.when(k == 0, F.concat(F.lit("Flood hits "), F.col("name"))).otherwise("News of the day")
    body = (
        F.when(k == 0, "Officials met. Help from Norway is on its way.").when(k == 1, F.concat(F.lit("OSLO (Agency) - Aid left Norway today. A quake struck northern "), F.col("name"), F.lit(" at night. More follows.")))
        .when(k == 2, F.concat(F.lit("The "), F.col("name"), F.lit(" saw rain. It was dry elsewhere."))).when(k == 3, "It rained. It stopped. It rained again. Norway was dry.").otherwise(F.concat(F.lit("The rain left "), F.col("name"), F.lit(", say Swedish papers. Sweden was dry.")))
    )
    body = F.when(F.col("s_suppkey") % 7 == 0, F.concat(body, F.lit(" It lay at 12.5N, 45.25W."))).otherwise(body)
    a = t.select("s_suppkey", title.alias("title"), body.alias("text"))
    return where.extract_location(a, key="s_suppkey")


CITIES = "select concat('Port ', s_name) as name, concat('Old ', s_name, ',12,', case when s_suppkey % 10 = 0 then 'Shared' else 'x' end) as alternatenames, cast(s_acctbal as double) as population, 'NO' as iso2, s_suppkey % 90 as lat, s_suppkey % 180 as lon from supplier"


@query("with c as (" + CITIES + "), n as (select lower(name) as name, population, lat, lon from c union all select 'old ' || lower(substr(name, 6)), population, lat, lon from c union all select 'shared', population, lat, lon from c where alternatenames like '%Shared') select name, 'NO' as iso2, cast(arg_max(lat, (population, lat, lon)) as double) as lat, cast(arg_max(lon, (population, lat, lon)) as double) as lon from n group by 1")
def q_city_index(spark, d):
    return where.city_index(V.view(spark, d, CITIES))


@query(f"with t as ({TITLED}) select s_suppkey, case s_suppkey % 6 when 3 then 'NA' when 4 then null when 5 then 'QQ' else {NATIONS} end as iso2 from t")
def q_resolve_iso2(spark, d):
    k = F.col("s_suppkey") % 6
    t = V.view(spark, d, TITLED)
    place = F.when(k == 0, F.concat(F.lit("near "), F.lower("name"), F.lit(", the coast"))).when(k == 1, F.concat(F.col("name"), F.lit("."))).when(k == 2, F.concat(F.lit("Some town, "), F.col("name"), F.lit(" Norway"))).when(k == 3, "Norway").when(k == 4, "nowhere")
    given = F.when(k == 3, "na").when(k == 5, "qq").when(k == 1, "ZZ")
    return where.resolve_iso2(t.select("s_suppkey", given.alias("country_iso2"), place.alias("location_text")), "s_suppkey").select("s_suppkey", "iso2")


@query(f"select n_nationkey, {NATIONS} as iso2, case when n_nationkey in (21, 22, 23, 24) then {NATIONS} end as by_alias from nation")
def q_catalogue_countries(spark, d):
    n = V.view(spark, d, f"select n_nationkey, {NAMED} as country from nation")
    few = where.alias_table(spark, {"vietnam": "VN", "russia": "RU", "united kingdom": "GB", "united states": "US"})
    by_alias = few.select(F.initcap("name").alias("country"), F.col("iso2").alias("by_alias"))
    return where.catalogue_countries(n, few).join(by_alias, "country", "left").select("n_nationkey", "iso2", "by_alias")


EVENTS = GREEDY.rstrip() + f""", art2 as (select g.*, a.idx, a.event_date, a.label, a.country_iso2, a.location_text, a.text, (a.pos % 17 = 0) as un from greedy g join art a using (pos)),
 lc as (select type, country, cluster, location_text as v, count(*) as n, min(seq) as s from art2 where location_text is not null group by all),
 lm as (select type, country, cluster, arg_min(v, (-n, s)) as place from lc group by all),
 ev0 as (select type, country, cluster, min(case when not un then event_date end) as event_date, any_value(country_iso2) as primary_country, count(*) as article_count, min(pos) as first_pos,
   max(case when label in ('earthquake', 'flood') then cast(regexp_extract(text, 'killed ([0-9]+)', 1) as double) end) as dead, max(case when label = 'flood' then cast(regexp_extract(text, '([0-9]+) people were displaced', 1) as double) end) as displaced from art2 group by all),
 grp as (select type, country, min(first_pos) as gf from ev0 group by all),
 ev1 as (select e.*, place, printf('%s_%04d', e.type, row_number() over (order by gf, e.type, e.country, cluster) - 1) as event_id from ev0 e join grp using (type, country) left join lm using (type, country, cluster)),
 near as (select event_id, eventid as g_pos, alertlevel as alert, abs(date_diff('day', fromdate, cast(event_date as date))) as gap from ev1 join cat on type = eventtype and primary_country = iso2 and abs(date_diff('day', fromdate, cast(event_date as date))) <= 7),
 hit as (select event_id, arg_min(g_pos, (gap, g_pos)) as g_pos, arg_min(alert, (gap, g_pos)) as alert from near group by 1),
 ev2 as (select ev1.*, g_pos, alert, coalesce(primary_country, case list_filter(string_split(coalesce(place, ''), ' '), lambda w: w in ('peru', 'indian'))[1] when 'peru' then 'PE' when 'indian' then 'IN' end) as iso2 from ev1 left join hit using (event_id)),
 {LINKED},
 lk as (select ev2.*, {SECTORS} as s from ev2 left join prior using (type) left join kb using (iso2) left join named using (type)) """


@query(EVENTS + f"""select event_id, type, event_date, primary_country, article_count, case when alert in ('orange', 'red') then 'orange_or_red' when g_pos is not null then 'green' when type = 'FL' then case when dead > 100 or displaced > 80000 then 'orange_or_red' else 'green' end end as predicted_alert,
 case when g_pos is null then 'model' else 'catalogue' end as severity_source, case when g_pos is null then dead end as dead, case when g_pos is null then displaced end as displaced, false as low_confidence, iso2, array_to_string({FUNDS}, ',') as sector_etfs from lk, fund""")
def q_events(spark, d):
    got = P.build_events(_undated(spark, d), _cat(spark, d))
    return got.select("event_id", "type", "event_date", "primary_country", "article_count", "predicted_alert", "severity_source", "dead", "displaced", "low_confidence", "iso2", F.array_join("sector_etfs", ",").alias("sector_etfs"))


DOC = """case s_suppkey % 4
 when 0 then concat('{{"properties":{{"eventid":" ', s_suppkey, '","eventtype":"dr","alertlevel":"Green ","country":"Kenya","fromdate":"2025-01-01T00:00:00","todate":"2025-01-', cast(10 + s_suppkey % 10 as {text}), '","severitydata":{{"severity":"1,', cast(100 + s_suppkey % 900 as {text}), '.5","severitytext":"Medium impact"}},"affectedcountries":[{{"iso3":"KEN"}},{{"iso3":"SOM"}}],"url":{{"details":"http://x/', s_suppkey, '"}}}}}}')
 when 1 then concat('{{"properties":{{"eventid":', s_suppkey, ',"eventtype":"FL","alertlevel":"RED","humanimpact":{{"killed":"', s_suppkey, '","homeless":"2,000"}},"severitydata":{{"severitytext":"extreme","dead":"9"}}}}}}')
 when 2 then concat('{{"properties":{{"eventid":', s_suppkey, ',"eventtype":"WF","alertlevel":"orange","fromdate":"2025-02-05","todate":"2025-02-01","affectedcountries":[]}}}}')
 else 'not json' end"""


@query("select s_suppkey as n, cast(case when s_suppkey % 4 < 3 then s_suppkey end as varchar) as eventid, case s_suppkey % 4 when 0 then 'DR' when 1 then 'FL' when 2 then 'WF' end as eventtype, case s_suppkey % 4 when 0 then 'green' when 1 then 'red' when 2 then 'orange' end as alertlevel, case s_suppkey % 4 when 0 then 9.0 + s_suppkey % 10 when 2 then 0 end::double as duration_days, case when s_suppkey % 4 = 0 then 1100.5 + s_suppkey % 900 end::double as affected_area_km2, case when s_suppkey % 4 = 0 then 2 end::double as affected_country_count, case when s_suppkey % 4 = 1 then s_suppkey end::double as dead, case when s_suppkey % 4 = 1 then 2000 end::double as displaced, case s_suppkey % 4 when 0 then 2 when 1 then 4 end::double as severity_level, case when s_suppkey % 4 = 0 then 'http://x/' || s_suppkey end as details_url from supplier")
def q_feature_rows(spark, d):
    docs = V.view(spark, d, f"select s_suppkey as n, {DOC.format(text='string')} as feature from supplier")
    return R.features(docs).select("n", "eventid", "eventtype", "alertlevel", "duration_days", "affected_area_km2", "affected_country_count", "dead", "displaced", "severity_level", "details_url")


IMPACT = "concat('{\"datums\":[{\"datum\":[{\"scalars\":{\"scalar\":[{\"name\":\"sumpop_1\",\"value\":\"', s_suppkey, '\"},{\"name\":\"POPAFFECTED\",\"value\":\"7', s_suppkey, '\"},{\"name\":\"other\",\"value\":\"999999\"}]}}]},{\"datum\":[{},{\"scalars\":{\"scalar\":[{\"name\":\"SUMPOP2\",\"value\":\"50.9\"},{\"name\":\"SUMPOP3\",\"value\":\"none\"}]}}]}]}')"


@query("select s_suppkey, greatest(s_suppkey, 50)::double as exposed, cast('7' || s_suppkey as double) as affected, s_suppkey / 8 as surge, case s_suppkey % 3 when 0 then 'exposed:a,exposed:b,surge:last' when 1 then 'exposed:a,exposed:b,surge:first,surge:second' else 'affected:c' end as urls, case when s_suppkey % 3 < 2 then 120.5 end::double as wind, case when s_suppkey % 3 = 2 then 120.5 end::double as burned from supplier".replace("s_suppkey / 8 as surge", "cast(s_suppkey as double) / 8 as surge"))
def q_details(spark, d):
    marked = F.when(F.col("s_suppkey") % 3 == 0, "true").otherwise("false")
    doc = F.concat(F.lit('{"properties":{"severitydata":{"severity":"120.5"},"impacts":[{"resource":{"buffer74":" a","buffer39":"b"}},{"resource":{"impact":"c"}},{"resource":{"impact":"d"}}],"cyclonesurge":[{"data":[{"last":false,"url":"first"},{"last":'), marked, F.lit(',"url":"'), F.when(F.col("s_suppkey") % 3 == 0, "last").otherwise("second"), F.lit('"}]}]}}'))
    kind = F.when(F.col("s_suppkey") % 3 == 2, "WF").otherwise("TC")
    height = F.concat(F.lit('{"properties":{"maxheight":"'), (F.col("s_suppkey") / 8).cast("string"), F.lit('"}}'))
    t = V.view(spark, d, f"select s_suppkey, {IMPACT} as impact from supplier").withColumn("d", R.details(kind, doc))
    urls = F.array_join(F.transform(R.impact_urls(kind, doc), lambda u: F.concat(u["what"], F.lit(":"), u["url"])), ",")
    most = lambda what: R.largest_population(R.scalars_of(F.col("impact")), F.lit(what))
    return t.select("s_suppkey", most("exposed").alias("exposed"), most("affected").alias("affected"), R.surge_height(height).alias("surge"), urls.alias("urls"), "d.wind", "d.burned")


ANSWER = """concat('<think>LABEL: no</think>', case when s_suppkey % 3 = 0 then 'so the LOCATION: ' else '' end, case when s_suppkey % 3 = 0 then 'here' else 'I think' end, '\n LOCATION: nowhere\nLOCATION: Place ', s_suppkey, '\nCOUNTRY: ', case when s_suppkey % 2 = 0 then 'phl' else 'N/A' end, '\nLAT: ', s_suppkey, '.12345N\nLON: none\nEVENT_DATE_RAW: last   month\nEVENT_DATE_ISO: ', case when s_suppkey % 2 = 0 then '2025-03' else 'March' end, '\nGRANULARITY: Month\nTIME_TYPE: sometime\nDEAD: 1,', cast(200 + s_suppkey % 700 as {text}), ' people\nDISPLACED: NA\nMAGNITUDE: 6.1\nNOTE: seen')"""


@query("select s_suppkey, 'Place ' || s_suppkey as location_text, case when s_suppkey % 2 = 0 then 'PH' else 'error' end as country_iso2, round(s_suppkey + 0.12345, 4) as lat, 'last month' as event_date_raw, case when s_suppkey % 2 = 0 then '2025-03' end as event_date_iso, 'month' as granularity, 'unknown' as time_type, case when s_suppkey % 3 > 0 then 1200 + s_suppkey % 700 end::double as dead, case when s_suppkey % 3 = 0 then 6.1 end::double as magnitude, 'seen' as source_note from supplier")
def q_parse_answers(spark, d):
    a = V.view(spark, d, f"select s_suppkey, {ANSWER.format(text='string')} as answer from supplier")
    label = F.when(F.col("s_suppkey") % 3 == 0, "earthquake").otherwise("flood")
    got = a.select("s_suppkey", F.struct(*R.parse_place(F.col("answer"))).alias("p"), F.struct(*R.parse_time(F.col("answer"))).alias("t"), F.struct(*R.parse_numbers(F.col("answer"), label)).alias("v"))
    return got.select("s_suppkey", "p.location_text", "p.country_iso2", "p.lat", "t.event_date_raw", "t.event_date_iso", "t.granularity", "t.time_type", "v.dead", "v.magnitude", "p.source_note")


@query("select s_suppkey, 'a,b ' || s_suppkey as joined, case when s_suppkey % 5 > 0 then round(abs(s_acctbal - s_suppkey % 5) / (s_suppkey % 5), 4) end as error, case when s_nationkey = 3 then 'UNKNOWN_DATE' else strftime(date '2024-12-25' + cast(s_suppkey % 400 as int), '%G-W%V') end as week, least(7.0, greatest(2.0, s_suppkey % 10))::double as clamped from supplier")
def q_small_functions(spark, d):
    s = V.view(spark, d, "select * from supplier")
    k = F.col("s_suppkey")
    items = R.python_list(F.concat(F.lit("['a', 'b "), k.cast("string"), F.lit("']")))
    day = F.when(F.col("s_nationkey") != 3, F.date_add(F.lit("2024-12-25").cast("date"), (k % 400).cast("int")))
    return s.select("s_suppkey", F.array_join(items, ",").alias("joined"), F.round(X.relative_error(k % 5, F.col("s_acctbal")), 4).alias("error"), EV.iso_week(day).alias("week"), X.clamp((k % 10).cast("double"), 2.0, 7.0).alias("clamped"))


@query("select s_suppkey, case s_suppkey % 4 when 0 then 'energy,insurance' when 1 then 'utilities' when 2 then '' else 'mining' end as sectors from supplier")
def q_company_sectors(spark, d):
    names = F.element_at(F.array(F.array(F.lit("Royal Dutch Shell plc"), F.lit(" Munich RE"), F.lit("Allianz SE")), F.array(F.lit("PG&E Corp"), F.lit("Acme")), F.array(F.lit("Nobody")), F.array(F.lit("Rio Tinto"), F.lit("VALE S.A."))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return V.view(spark, d, "select * from supplier").select("s_suppkey", F.array_join(X.company_sectors(names), ",").alias("sectors"))


PLACES = """select o_orderkey, o_orderpriority as label, case when o_orderkey % 4 = 0 then null else 'JP' end as gt_country, case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then 'us' else 'jp' end as pred_country,
 case when o_orderkey % 7 = 0 then null else 'x' end as pred_location, 10.0 as gt_lat, 20.0 as gt_lon, case when o_orderkey % 2 = 0 then 10.0 + o_orderkey % 9 end as pred_lat, 20.0 as pred_lon, case o_orderkey % 6 when 0 then 'coords_text' when 1 then 'none' else 'location' end as confidence,
 case o_orderkey % 5 when 0 then null when 1 then '1995-03' else '1995-03-05' end as gt_date, case when o_orderkey % 3 = 0 then null else cast('1995-03-01' as date) end as pred_date from orders"""


@query(f"with p as ({PLACES}), q as (select *, gt_country is not null and pred_country is not null as duo, case when confidence = 'coords_text' and pred_lat is not null then 2 * 6371.0 * asin(sqrt(pow(sin(radians(pred_lat - 10.0) / 2), 2))) end as km from p) select label, count(*) as n, round(count(*) filter (duo and upper(pred_country) = 'JP') / count(*) filter (duo), 6) as country_accuracy, round(count(pred_location) / count(*), 6) as coverage, count(km) as coord_pairs, round(median(km), 4) as median_km, round(count(*) filter (km < 100) / count(km), 6) as within_100, round(count(*) filter (km < 500) / count(km), 6) as within_500, count(*) filter (confidence = 'coords_text') as n_coords_text, count(*) filter (confidence = 'location') as n_location, count(*) filter (confidence = 'none') as n_none from q group by grouping sets ((), (label))")
def q_eval_places(spark, d):
    return EV.compare_places(V.view(spark, d, PLACES), "label")


@query(f"with p as ({PLACES}), q as (select *, case o_orderkey % 5 when 0 then null when 1 then date '1995-03-01' else date '1995-03-05' end as g from p), r as (select *, abs(date_diff('day', g, pred_date)) as e, g is not null and pred_date is not null as duo from q) select label, count(*) as n, count(g) as n_dated, round(count(*) filter (duo) / count(g), 6) as coverage, count(*) filter (duo) as comparable, round(count(*) filter (duo and e = 0) / count(*) filter (duo), 6) as exact, round(count(*) filter (e <= 1) / count(*) filter (duo), 6) as within_1d, round(count(*) filter (e <= 7) / count(*) filter (duo), 6) as within_7d, round(median(e), 4) as median_days, count(*) filter (g is null and pred_date is null) as both_null from r group by grouping sets ((), (label))")
def q_eval_times(spark, d):
    return EV.compare_times(V.view(spark, d, PLACES), "label")


@query(PRED + ", c as (select * from (values (0, 'N'), (1, 'R'), (2, 'A'), (3, 'Z')) v(nr, c)), g as (select nr, c, (select count(*) from p where label = c) as support, (select count(*) from p where pred = c) as predicted, (select count(*) from p where label = c and pred = c) as tp from c), f as (select nr, c as label, round(coalesce(tp / nullif(predicted, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) as f1, support from g) select * from f union all select 4, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f union all select 5, 'accuracy', round(count(*) filter (label = pred) / count(*), 6), round(count(*) filter (label = pred) / count(*), 6), round(count(*) filter (label = pred) / count(*), 6), count(*) from p")
def q_full_report(spark, d):
    return EV.full_report(_pred(spark, d), ["N", "R", "A", "Z"])


@query(PRED + "select round(2 * count(*) filter (label = 'R' and pred = 'R') / (count(*) filter (label = 'R') + count(*) filter (pred = 'R')), 6) as f1 from p")
def q_positive_f1(spark, d):
    return EV.positive_f1(_pred(spark, d), "R")


@query("select o_orderstatus, count(*) as n, round(count(*) / (select count(*) from orders), 6) as share from orders group by 1")
def q_breakdown(spark, d):
    return EV.breakdown(V.view(spark, d, "select o_orderstatus from orders"), "o_orderstatus")


@query("select l.doc_id, case when l.quality = 1 then 'good' else 'error' end as label_gt, d.lang as label_article, d.source from labels l join documents d using (doc_id) where l.quality = 1")
def q_join_labels(spark, d):
    labels = EV.valid_labels(V.view(spark, d, "select doc_id, case when quality = 1 then 'good' else 'error' end as label from labels"), "label")
    return EV.join_labels(labels, V.view(spark, d, "select doc_id, lang as label, source from documents"), "doc_id")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey between 100 and 5099 and o_orderstatus <> 'P' union all select o_orderkey, o_orderstatus from (select * from orders order by o_orderkey limit 50)")
def q_slices(spark, d):
    o = V.view(spark, d, "select o_orderkey, o_orderstatus from orders")
    return EV.row_slice(o, 100, 5100, "o_orderkey", "o_orderstatus", "P").unionAll(o.orderBy("o_orderkey").limit(50))


@query("select count(*) filter (p_size % 3 = 0) as green, count(*) filter (p_size % 3 > 0) as orange_or_red from part")
def q_label_distribution(spark, d):
    return EV.label_distribution(V.view(spark, d, V.CAT_SPARK))


@query(EVENTS + f"select count(*) as n, count(iso2) as with_country, count(*) filter (len({FUNDS}) > 0) as with_funds, count(*) filter (len({FUNDS}) > 0 and event_date is not null) as tradeable, count(g_pos) as matched from lk, fund")
def q_coverage(spark, d):
    return EV.coverage_counts(P.build_events(_undated(spark, d), _cat(spark, d)))


@query()
def q_severity_forest(spark, d):
    p = severity.with_target(V.view(spark, d, V.CAT_SPARK)).select("eventid", "eventtype", "magnitude", "positive")
    return models.severity_by_type(p).select("eventid", F.round("prob", 4).alias("prob"), "predicted_alert")


@query()
def q_text_classifier(spark, d):
    """Trained on the train and val rows, judged on the test rows."""
    a = T.random_split(V.view(spark, d, V.ART).select("idx", "label", "text"), "label", "idx")
    model = models.train_text(a.filter("split <> 'test'"))
    return models.label_predictions(model, a.filter("split = 'test'")).groupBy("label", "pred").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_group_ttest(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "W", "flagship"]
