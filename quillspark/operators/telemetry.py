"""Telemetry over events, in batch: windows, sessions, anomalies and rates. All windows are by user or by type and day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.named import named
from ..sources.tables import table


@named("events_tumbling", "select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(spark, folder):
    e = table(spark, folder, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")




@named("events_sessions", """with g as (select user_id, ts, value, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as session from g)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, count(*) as n, round(sum(value), 4) as total from s group by user_id, session""")
def events_sessions(spark, folder):
    """Sessions end after 30 minutes without an event."""
    e = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n", "total")


@named("events_anomalies", """with w as (select event_id, user_id, value, avg(value) over h as m, coalesce(nullif(stddev_pop(value) over h, 0), 0.01) as sd, count(*) over h as n from events window h as (partition by user_id order by ts, event_id rows between 99 preceding and current row))
    select event_id, user_id, round((value - m) / sd, 4) as z, case when (value - m) / sd > 4 then 'critical' when (value - m) / sd > 3 then 'warning' else 'info' end as severity from w where n >= 10 and (value - m) / sd > 2""")
def events_anomalies(spark, folder):
    """Values far above the user's last 100, the value itself included."""
    h = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    sd = F.stddev_pop("value").over(h)
    e = table(spark, folder, "events").select("event_id", "user_id", ((F.col("value") - F.avg("value").over(h)) / F.when(sd == 0, 0.01).otherwise(sd)).alias("z"), F.count("*").over(h).alias("n"))
    return e.where("n >= 10 and z > 2").select("event_id", "user_id", F.round("z", 4).alias("z"), F.when(F.col("z") > 4, "critical").when(F.col("z") > 3, "warning").otherwise("info").alias("severity"))


@named("events_bursts", "select event_id, user_id, n from (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as n from events) where n >= 3")
def events_bursts(spark, folder):
    """Events with three or more of the user's in the hour up to them, to the microsecond."""
    n = F.expr("count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row)")
    return table(spark, folder, "events").select("event_id", "user_id", n.alias("n")).where("n >= 3")


@named("events_off_hours", "select user_id, count(*) as n from events where hour(ts) < 6 or hour(ts) > 23 group by 1")
def events_off_hours(spark, folder):
    return table(spark, folder, "events").where((F.hour("ts") < 6) | (F.hour("ts") > 23)).groupBy("user_id").agg(F.count("*").alias("n"))


@named("events_next_type", "select a as event_type, b as next_type, count(*) as n from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null group by all")
def events_next_type(spark, folder):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, folder, "events").select("event_type", nxt.alias("next_type")).where("next_type is not null").groupBy("event_type", "next_type").agg(F.count("*").alias("n"))


@named("events_props", "select event_type, sum(json_extract(props, '$.k')::bigint)::bigint as k from events group by event_type")
def events_props(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@named("events_forecast", "with d as (select event_type, count(*) as n, count(distinct date_trunc('hour', ts)) as hours from events group by 1) select event_type, n, round(n + n / hours * 24, 4) as tomorrow from d")
def events_forecast(spark, folder):
    d = table(spark, folder, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("c")).groupBy("event_type").agg(F.sum("c").alias("n"), F.count("*").alias("hours"))
    return d.select("event_type", "n", F.round(F.col("n") + F.col("n") / F.col("hours") * 24, 4).alias("tomorrow"))


@named("events_chain", """with h as (select user_id, ts::date as day, ts, event_id, sha256(event_id || ',' || event_type || ',' || props) as h from events),
    d as (select user_id, day, count(*) as n, list_reduce(list_prepend('', list(h order by ts, event_id)), lambda a, x: sha256(a || x)) as h from h group by all)
    select user_id, sum(n)::bigint as n, list_reduce(list_prepend('', list(h order by day)), lambda a, x: sha256(a || x)) as head from d group by user_id""")
def events_chain(spark, folder):
    """The head of each user's chain of hashes: changing, losing or swapping any event changes it. Events are chained by day and days by
    user, so days are folded in parallel and no list holds more than a user's events of one day."""
    chained = lambda rows: F.aggregate(F.array_sort(rows), F.lit(""), lambda a, r: F.sha2(F.concat(a, r["h"]), 256))
    h = F.sha2(F.concat_ws(",", "event_id", "event_type", "props"), 256)
    e = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", h.alias("h")).alias("row"))
    days = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), chained(F.collect_list("row")).alias("h"))
    return days.groupBy("user_id").agg(F.sum("n").alias("n"), chained(F.collect_list(F.struct("day", "h"))).alias("head"))
