"""The telemetry operators as Structured Streaming; each query runs over all there is and stops, and gives its final table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.named import named
from ..sources.files import scratch
from ..sources.tables import table


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    kind = table(spark, folder, "events").schema
    return spark.readStream.schema(kind).parquet(f"{folder}/events.parquet*").withColumn("t", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs df over all that is available into a table in the shared folder, and reads it."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


@named("stream_clicks", "select event_id, user_id, value from events where event_type = 'click'")
def stream_clicks(spark, folder):
    """A subscription to one kind of event."""
    return finished(events_stream(spark, folder).where("event_type = 'click'").select("event_id", "user_id", "value"))


@named("stream_distinct", "select distinct event_id from events")
def stream_distinct(spark, folder):
    """Each event once, however often it is delivered; state is bounded by the watermark."""
    return finished(events_stream(spark, folder).withWatermark("t", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


def settled(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregation in update mode and reads the last value of each key: batches are written apart, numbered, and a rerun
    of a batch replaces it."""
    spark, at = df.sparkSession, scratch(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    values = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


@named("stream_hourly", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_hourly(spark, folder):
    """Counts and sums by hour; the watermark lets go of hours that are a month past."""
    e = events_stream(spark, folder).withWatermark("t", "31 days").groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    start = F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start")
    return settled(e.select(start, "event_type", "n", F.round("total", 4).alias("total")), ["start", "event_type"])


def stateful(events: DataFrame, key: str, first: tuple, step, given: Column | None = None) -> DataFrame:
    """(key, event_id, result) of the events that have a result. step(state, microseconds, given) gives the new state and a whole number,
    or None for no result; a key's state is one tuple of whole numbers. A batch's events of a key are ordered in its task, three numbers
    each; maxFilesPerTrigger of the source bounds a batch."""
    state_type = ", ".join(f"s{i} bigint" for i in range(len(first)))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        now, found = tuple(state.get) if state.exists else first, []
        for at, event, x in zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["given"].tolist(), strict=True):
            now, result = step(now, at, x)
            if result is not None:
                found.append((event, result))
        state.update(now)
        yield pd.DataFrame(found, columns=["event_id", "result"], dtype="int64").assign(**{key: group[0]})[[key, "event_id", "result"]]

    sent = events.select(key, "event_id", F.unix_micros("t").alias("at"), (F.lit(0) if given is None else given).cast("long").alias("given"))
    return sent.groupBy(key).applyInPandasWithState(run, f"{key} bigint, event_id bigint, result bigint", state_type, "append", GroupStateTimeout.NoTimeout)


@named("stream_cooldown", """with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type = 'error'),
    r as (select user_id, event_id, i, us as last, true as ok from e where i = 1 union all
    select e.user_id, e.event_id, e.i, case when e.us - r.last >= 172800000000 then e.us else r.last end, e.us - r.last >= 172800000000 from r join e on e.user_id = r.user_id and e.i = r.i + 1)
    select user_id, event_id from r where ok""")
def stream_cooldown(spark, folder, wait: int = 172_800_000_000):
    """Alerts of a user, but none within two days of the last one that went out."""
    def step(now: tuple, at: int, _: int) -> tuple:
        quiet = now[0] >= 0 and at - now[0] < wait
        return (now, None) if quiet else ((at,), 1)

    return finished(stateful(events_stream(spark, folder).where("event_type = 'error'"), "user_id", (-1,), step).drop("result"))


@named("stream_bucket", """with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, event_id, i, us, 259200000000 - 86400000000 as held, true as ok from e where i = 1 union all
    select user_id, event_id, i, us, case when held >= 86400000000 then held - 86400000000 else held end, held >= 86400000000 from (select e.user_id, e.event_id, e.i, e.us, least(259200000000, s.held + e.us - s.us) as held from s join e on e.user_id = s.user_id and e.i = s.i + 1))
    select user_id, event_id from s where ok""")
def stream_bucket(spark, folder, every: int = 86_400_000_000, burst: int = 3):
    """A token bucket per user: one token a day, three at most, each event that passes takes one."""
    def step(now: tuple, at: int, _: int) -> tuple:
        held = min(burst * every, now[0] + at - now[1]) if now[1] >= 0 else burst * every
        return ((held - every, at), 1) if held >= every else ((held, at), None)

    return finished(stateful(events_stream(spark, folder), "user_id", (0, -1), step).drop("result"))


REFUSED, CLOSED, OPEN, HALF_OPEN = range(4)


@named("stream_breaker", """with recursive e as (select user_id, event_id, epoch_us(ts) as us, event_type = 'error' as failed, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, null::bigint as event_id, 0::bigint as i, 0::bigint as result, 1::bigint as mode, -1::bigint as opened, -1::bigint as a, -1::bigint as b from (select distinct user_id from events) union all
    select user_id, event_id, i, case when now = 2 then 0 when trips then 2 when heals then 1 else now end, case when trips then 2 when heals then 1 else now end, case when trips then us else opened end,
    case when now = 2 then a when failed then us when heals then -1 else a end, case when now = 2 then b when failed then a when heals then -1 else b end
    from (select *, now <> 2 and failed and b >= 0 and us - b < 172800000000 as trips, now = 3 and not failed as heals
    from (select e.*, s.opened, s.a, s.b, case when s.mode = 2 and e.us - s.opened > 86400000000 then 3 else s.mode end as now from s join e on e.user_id = s.user_id and e.i = s.i + 1)))
    select user_id, event_id, result as state from s where i > 0""")
def stream_breaker(spark, folder, failures: int = 3, within: int = 172_800_000_000, cooldown: int = 86_400_000_000):
    """A circuit breaker per user, errors being failures: what each event meets. 0: refused; else the state that it leaves, 1 closed, 2 open,
    3 half open. So many failures in a span open it; after the cooldown one is let through, and a success closes it."""
    def step(now: tuple, at: int, failed: int) -> tuple:
        mode, opened, *recent = now
        if mode == OPEN:
            if at - opened <= cooldown:
                return now, REFUSED
            mode = HALF_OPEN
        if failed:
            if recent[-1] >= 0 and at - recent[-1] < within:
                mode, opened = OPEN, at
            recent = [at, *recent[:-1]]
        elif mode == HALF_OPEN:
            mode, recent = CLOSED, [-1] * len(recent)
        return (mode, opened, *recent), mode

    found = stateful(events_stream(spark, folder), "user_id", (CLOSED, -1, *[-1] * (failures - 1)), step, F.col("event_type") == "error")
    return finished(found.withColumnRenamed("result", "state"))


#: The grade of a review by what happened, and what each grade from 0 to 5 does to the ease, in hundredths.
GRADES = {"error": 0, "view": 2, "click": 3, "signup": 4, "purchase": 5}
EASE = (-80, -54, -32, -14, 0, 10)


@named("stream_reviews", """with recursive e as (select user_id, event_id, case event_type when 'error' then 0 when 'view' then 2 when 'click' then 3 when 'signup' then 4 else 5 end as grade, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, null::bigint as event_id, 0::bigint as i, 0::bigint as reps, 0::bigint as days, 250::bigint as ease from (select distinct user_id from events) union all
    select e.user_id, e.event_id, e.i, case when grade >= 3 then reps + 1 else 0 end,
    case when grade < 3 or reps = 0 then 1 when reps = 1 then 6 else least(36500, days * ease // 100 + (days * ease % 100 > 50 or (days * ease % 100 = 50 and days * ease // 100 % 2 = 1))::int) end,
    greatest(130, ease + case grade when 0 then -80 when 2 then -32 when 3 then -14 when 4 then 0 else 10 end) from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, event_id, days from s where i > 0""")
def stream_reviews(spark, folder, longest: int = 36_500):
    """Days until the next review, after each: 1, then 6, then times the ease, which each grade moves; a grade below 3 starts anew. Ease is
    kept in hundredths, halves of days go to even, and a hundred years is the longest wait."""
    def step(now: tuple, at: int, grade: int) -> tuple:
        reps, days, ease = now
        if grade < 3:
            reps, days = 0, 1
        else:
            whole, part = divmod(days * ease, 100)
            days = (1, 6)[reps] if reps < 2 else min(longest, whole + (part > 50 or (part == 50 and whole % 2 == 1)))
            reps += 1
        return (reps, days, max(130, ease + EASE[grade])), days

    grade = F.lit(None)
    for kind, g in GRADES.items():
        grade = F.when(F.col("event_type") == kind, g).otherwise(grade)
    return finished(stateful(events_stream(spark, folder), "user_id", (0, 0, 250), step, grade).withColumnRenamed("result", "days"))


@named("stream_due", """with recursive e as (select user_id, ts, case event_type when 'error' then 0 when 'view' then 2 when 'click' then 3 when 'signup' then 4 else 5 end as grade, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, null::timestamp as ts, 0::bigint as i, 0::bigint as reps, 0::bigint as days, 250::bigint as ease from (select distinct user_id from events) union all
    select e.user_id, e.ts, e.i, case when grade >= 3 then reps + 1 else 0 end,
    case when grade < 3 or reps = 0 then 1 when reps = 1 then 6 else least(36500, days * ease // 100 + (days * ease % 100 > 50 or (days * ease % 100 = 50 and days * ease // 100 % 2 = 1))::int) end,
    greatest(130, ease + case grade when 0 then -80 when 2 then -32 when 3 then -14 when 4 then 0 else 10 end) from s join e on e.user_id = s.user_id and e.i = s.i + 1),
    last as (select user_id, max(ts) as ts, arg_max(days, i) as days from s where i > 0 group by user_id)
    select user_id, days from last where ts + to_days(days::int) <= (select max(ts) from events)""")
def stream_due(spark, folder):
    """Users whose next review is due at the time of the last event."""
    e = table(spark, folder, "events").select("event_id", "ts")
    last = stream_reviews(spark, folder).join(e, "event_id").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "days")).alias("last"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return last.join(now).where(F.expr("last.ts + make_interval(0, 0, 0, cast(last.days as int)) <= now")).select("user_id", "last.days")


@named("stream_rate_limit", """with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (select user_id, null::bigint as event_id, 0::bigint as i, false as ok, -1::bigint as a, -1::bigint as b, -1::bigint as c from (select distinct user_id from events) union all
    select user_id, event_id, i, free, case when free then us else a end, case when free then a else b end, case when free then b else c end
    from (select e.*, s.a, s.b, s.c, s.c < 0 or e.us - s.c >= 172800000000 as free from s join e on e.user_id = s.user_id and e.i = s.i + 1))
    select user_id, event_id from s where ok""")
def stream_rate_limit(spark, folder, most: int = 3, within: int = 172_800_000_000):
    """Events of a user that a sliding window lets through: at most three in any two days. What is refused does not count."""
    def step(now: tuple, at: int, _: int) -> tuple:
        free = now[-1] < 0 or at - now[-1] >= within
        return ((at, *now[:-1]), 1) if free else (now, None)

    return finished(stateful(events_stream(spark, folder), "user_id", (-1,) * most, step).drop("result"))


@named("stream_budget", """with recursive e as (select user_id, event_id, epoch_us(ts) as us, ceil(value)::bigint as cost, row_number() over (partition by user_id order by ts, event_id) as i from events where value >= 0),
    s as (select user_id, null::bigint as event_id, 0::bigint as i, -1::bigint as start, 0::bigint as used, 0::bigint as room from (select distinct user_id from e) union all
    select user_id, event_id, i, start, case when fits then used + cost else used end, case when fits then 100 - used - cost end
    from (select *, used + cost <= 100 as fits from (select user_id, event_id, i, cost, case when fresh then us else start end as start, case when fresh then 0 else used end as used
    from (select e.*, s.start, s.used, s.start < 0 or e.us - s.start >= 86400000000 as fresh from s join e on e.user_id = s.user_id and e.i = s.i + 1))))
    select user_id, event_id, room from s where i > 0 and room is not null""")
def stream_budget(spark, folder, budget: int = 100, lasts: int = 86_400_000_000):
    """Events that a user's budget pays for, and what is left of it. A budget starts with the first use and is new a day later."""
    def step(now: tuple, at: int, cost: int) -> tuple:
        start, used = (at, 0) if now[0] < 0 or at - now[0] >= lasts else now
        return ((start, used + cost), budget - used - cost) if used + cost <= budget else ((start, used), None)

    events = events_stream(spark, folder).where("value >= 0")
    return finished(stateful(events, "user_id", (-1, 0), step, F.ceil("value")).withColumnRenamed("result", "room"))
