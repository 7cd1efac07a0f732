"""Windows over events and incremental operators, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.sources import tables as S
from tessella.streaming import streams as Z


def _events(t: Tables) -> DataFrame:
    return Z.event_time(t("events"), "ts")


def _days(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "end": F.date_format("end", "yyyy-MM-dd HH:mm:ss")})


@query("q_tumbling", "Z07 A14", "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, strftime(time_bucket(interval '1 hour', ts) + interval '1 hour', '%Y-%m-%d %H:%M:%S') as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def q_tumbling(t: Tables) -> DataFrame:
    return _days(Z.tumbling(_events(t), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]))


@query("q_sliding", "Z07", "select strftime(s, '%Y-%m-%d %H:%M:%S') as start, strftime(s + interval '2 hours', '%Y-%m-%d %H:%M:%S') as \"end\", event_type, count(*) as n from (select event_type, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) group by s, event_type")
def q_sliding(t: Tables) -> DataFrame:
    return _days(Z.tumbling(_events(t), "ts", "2 hours", ["event_type"], [F.count("*").alias("n")], slide="1 hour"))


@query("q_session", "Z07", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as s from events), n as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g) select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval '30 minutes', '%Y-%m-%d %H:%M:%S') as \"end\", user_id, count(*) as n from n group by user_id, k")
def q_session(t: Tables) -> DataFrame:
    return _days(Z.sessions(_events(t), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")]))


@query("q_once", "Z01", "select distinct user_id, event_type from events")
def q_once(t: Tables) -> DataFrame:
    return Z.once(_events(t), ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("q_since", "Z03", "select news_id from finance_news where spider_time >= (select max(spider_time) - interval '30 days' from finance_news)")
def q_since(t: Tables) -> DataFrame:
    n = t("finance_news")
    mark = n.agg((F.max("spider_time") - F.expr("interval 30 days")).alias("m")).first()[0]
    return Z.since(n, "spider_time", mark).select("news_id")


@query("q_event_log", "Z06 M12", "select event_id as request_id, 'start' as event, null::double as seconds from events union all select event_id, 'finish', value from events".replace("value from events", "round(value, 3) from events"))
def q_event_log(t: Tables) -> DataFrame:
    e = _events(t).select(F.col("event_id").alias("request_id"), "ts", F.timestamp_millis(F.unix_millis("ts") + F.round(F.col("value") * 1000).cast("bigint")).alias("done"))
    return Z.event_log(e, "ts", "done").select("request_id", "event", F.round("seconds", 3).alias("seconds"))


@query("q_request_log", "S32 F07", "select line_no, user_id, kind from (select event_id as line_no, cast(user_id as varchar) as user_id, event_type as kind from events) where kind in ('click', 'view')")
def q_request_log(t: Tables) -> DataFrame:
    lines = t("events").select(F.col("event_id").alias("line_no"), F.concat(F.lit("INFO request user="), F.col("user_id").cast("string"), F.lit(" kind="), "event_type").alias("value"))
    return S.request_log(lines, "INFO request", r"user=(\d+) kind=(click|view)", ["user_id", "kind"]).where("kind is not null")
