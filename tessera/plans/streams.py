"""Queries: event windows. The same operators run over streams (see the tests); here over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.corpus import Corpus
from tessera.plans.registry import query
from tessera.streaming import events as streaming


def shown(df, *columns: str):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in columns else F.col(c) for c in df.columns]).withColumns({c: F.round(c, 4) for c in ("total",) if c in df.columns})


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_events(spark, sf):
    return shown(streaming.tumbling(Corpus(spark, sf).events), "window_start")


@query("with h as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w, event_type, value from events) select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from h group by 1, 2")
def sliding_events(spark, sf):
    return shown(streaming.tumbling(Corpus(spark, sf).events, size="2 hours", slide="1 hour"), "window_start")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as session_end, count(*) as n from s group by user_id, k""")
def session_events(spark, sf):
    return shown(streaming.sessions(Corpus(spark, sf).events), "session_start", "session_end")
