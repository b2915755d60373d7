"""Queries over sessions, messages, feedback and the knowledge base: the dashboards of a chat service."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import analytics as A
from quern.sources import table

#: The "now" of all queries.
AS_OF = datetime(2025, 12, 31)
#: The day up to which the events run.
EVENTS_AS_OF = datetime(2024, 1, 31)
# Topics and the words that show them.
TOPICS = {
    "prayer": ["namaz", "prayer"], "fasting": ["oruc", "oruç", "fast"], "ablution": ["dəstəmaz", "abdest", "ablution"], "alms": ["zəkat", "zekât", "alms"],
    "pilgrimage": ["həcc", "hac ibadeti", "pilgrimage"], "law": ["məhkəmə", "mahkeme", "court"], "health": ["həkim", "doktor", "medicine"],
    "school": ["dərs", "ders", "lecture"], "football": ["futbol", "football"], "search": ["axtarış", "arama", "search"], "history": ["qala", "kale", "fortress"], "none": ["qqqq"],
}

_hour = lambda src, ts, as_of, days: f"""
select printf('%02d:00', h) as bin, count(t) as n from range(24) r(h) left join
(select {ts} as t from {src} where {ts} >= timestamp '{as_of}' - interval {days} day and {ts} < timestamp '{as_of}') x on hour(t) = h group by h"""  # noqa: E731
_IN = lambda c, ws: "(" + " or ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"

QUERIES, ORACLE = {}, {}


def _counts(sql: str) -> str:
    """count_if(x) as a 64-bit count."""
    while (a := sql.find("count_if(")) >= 0:
        depth, b = 1, a + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = f"{sql[:a]}count(case when {sql[a + len('count_if('):b - 1]} then 1 end){sql[b:]}"
    return sql


def _add(name: str, f, sql: str) -> None:  # noqa: ANN001
    QUERIES[name], ORACLE[name] = f, _counts(sql)


_add("a_hourly", lambda s, d: A.hourly(table(s, d, "messages"), "created_at", AS_OF), _hour("messages", "created_at", AS_OF, 7))
_add("a_hourly_events", lambda s, d: A.hourly(table(s, d, "events"), "ts", EVENTS_AS_OF), _hour("events", "ts", EVENTS_AS_OF, 7))
_add(
    "a_daily_msgs",
    lambda s, d: A.daily(table(s, d, "messages"), "created_at", AS_OF),
    f"""select strftime(g, '%Y-%m-%d') as bin, count(m.id) as n
    from generate_series(timestamp '{AS_OF}' - interval 30 day, timestamp '{AS_OF}' - interval 1 day, interval 1 day) s(g)
    left join messages m on m.created_at >= g and m.created_at < g + interval 1 day group by g""",
)
_add(
    "a_weekly_users",
    lambda s, d: A.weekly(table(s, d, "chat_sessions"), "created_at", AS_OF, F.countDistinct("user_id")),
    f"""select strftime(g, '%Y-%m-%d') as bin, count(distinct c.user_id) as n
    from generate_series(date_trunc('week', timestamp '{AS_OF}') - interval 56 day, date_trunc('week', timestamp '{AS_OF}') - interval 7 day, interval 7 day) s(g)
    left join chat_sessions c on c.created_at >= g and c.created_at < g + interval 7 day group by g""",
)
_add(
    "a_monthly_sessions",
    lambda s, d: A.monthly(table(s, d, "chat_sessions"), "created_at", AS_OF),
    f"""select strftime(g, '%Y-%m') as bin, count(c.id) as n
    from generate_series(date_trunc('month', timestamp '{AS_OF}') - interval 6 month, date_trunc('month', timestamp '{AS_OF}') - interval 1 month, interval 1 month) s(g)
    left join chat_sessions c on date_trunc('month', c.created_at) = g group by g""",
)
_add(
    "a_growth_pct",
    lambda s, d: A.growth(table(s, d, "messages"), "created_at", AS_OF),
    f"""with c as (select count_if(created_at >= date_trunc('week', timestamp '{AS_OF}') and created_at < timestamp '{AS_OF}') a,
    count_if(created_at >= date_trunc('week', timestamp '{AS_OF}') - interval 7 day and created_at < date_trunc('week', timestamp '{AS_OF}')) b from messages)
    select a as this_week, b as last_week, case when b > 0 then round((a - b) * 100.0 / b, 1) when a > 0 then 100.0 else 0.0 end as growth_pct from c""",
)
_add(
    "a_avg_duration",
    lambda s, d: A.average_duration(table(s, d, "chat_sessions"), "created_at", "ended_at"),
    """select coalesce(round(avg(d), 1), 0.0) as avg_minutes, count(*) as n from (select datesub('minute', created_at, ended_at) d from chat_sessions) where d > 0 and d < 1440""",
)
_add(
    "a_duration_hist",
    lambda s, d: A.duration_histogram(table(s, d, "chat_sessions"), "created_at", "ended_at"),
    """with d as (select datesub('minute', created_at, ended_at) d from chat_sessions), b(bin, lo, hi) as (values ('0-5', 0, 5), ('5-15', 5, 15), ('15-30', 15, 30), ('30-60', 30, 60), ('60+', 60, 121))
    select bin, count(d) as n from b left join d on d >= lo and d < hi group by bin""",
)
_GAPS = """with p as (select chat_session_id, role, lead(role) over w as nxt, datesub('second', created_at, lead(created_at) over w) as gap
from messages window w as (partition by chat_session_id order by created_at, id)), g as (select chat_session_id, gap from p where role = 'user' and nxt = 'assistant' and gap > 0 and gap < 300)"""
_gaps = lambda s, d: A.response_gaps(table(s, d, "messages"), "chat_session_id", "role", "created_at", "id")
_add(
    "a_response_times",
    lambda s, d: A.gap_stats(_gaps(s, d)),
    _GAPS + " select round(avg(gap), 3) as avg_gap, quantile_cont(gap, 0.5) as median_gap, min(gap) as min_gap, max(gap) as max_gap, count(*) as n from g",
)
_add(
    "w_pair_gap",
    lambda s, d: _gaps(s, d).groupBy("chat_session_id").agg(F.count("*").alias("n"), F.sum("gap").cast("bigint").alias("seconds")),
    _GAPS + " select chat_session_id, count(*) as n, cast(sum(gap) as bigint) as seconds from g group by 1",
)
_add(
    "a_topics",
    lambda s, d: A.topic_hits(table(s, d, "messages").where("role = 'user'"), "content", TOPICS),
    "with h as (" + " union all ".join(f"select '{t}' as topic, count_if({_IN('content', ws)}) as hits from messages where role = 'user'" for t, ws in TOPICS.items())
    + ") select topic, hits, round(hits * 100.0 / sum(hits) over (), 1) as pct from h where hits > 0 order by hits desc, topic limit 10",
)
_add(
    "a_common_questions",
    lambda s, d: A.common_questions(table(s, d, "messages").where("role = 'user'"), "content", "id"),
    """with q as (select id, content, string_split(lower(content), ' ') w from messages where role = 'user' and contains(content, '?'))
    select array_to_string(w[1:3], ' ') as question, count(*) as n, arg_min(content, id) as example from q where len(w) >= 3 group by 1 order by n desc, question limit 10""",
)
_add(
    "a_most_active_users",
    lambda s, d: A.most_active(table(s, d, "chat_sessions"), table(s, d, "messages")),
    """with m as (select chat_session_id, count(*) m from messages group by 1), o as (select distinct id, user_id from chat_sessions where user_id is not null),
    b as (select user_id, count(*) as sessions, coalesce(sum(m), 0) as messages from o left join m on chat_session_id = id group by 1 order by messages desc, user_id limit 10)
    select row_number() over (order by messages desc, user_id) as rank, user_id, sessions, cast(messages as bigint) as messages from b""",
)
_add(
    "a_chat_stats",
    lambda s, d: A.counts_where(
        table(s, d, "chat_sessions"), total="true", active="is_active", guests="user_id is null", users="user_id is not null", today=f"to_date(created_at) = date '{AS_OF:%Y-%m-%d}'",
        this_week=f"created_at >= date_trunc('week', timestamp '{AS_OF}') and created_at < timestamp '{AS_OF}' + interval 1 day",
        this_month=f"year(created_at) = {AS_OF.year} and month(created_at) = {AS_OF.month}", this_month_any_year=f"month(created_at) = {AS_OF.month}",
    ),
    f"""select count(*) as total, count_if(is_active) as active, count_if(user_id is null) as guests, count_if(user_id is not null) as users,
    count_if(cast(created_at as date) = date '{AS_OF:%Y-%m-%d}') as today, count_if(created_at >= date_trunc('week', timestamp '{AS_OF}') and created_at < timestamp '{AS_OF}' + interval 1 day) as this_week,
    count_if(year(created_at) = {AS_OF.year} and month(created_at) = {AS_OF.month}) as this_month, count_if(month(created_at) = {AS_OF.month}) as this_month_any_year from chat_sessions""",
)
_add("a_count", lambda s, d: table(s, d, "messages").agg(F.count("*").alias("n")), "select count(*) as n from messages")
_add(
    "a_count_where",
    lambda s, d: A.counts_where(table(s, d, "knowledge_base"), total="true", active="is_active", pending="indexing_status = 'pending'", failed="indexing_status = 'failed'", url="source_url is not null and source_url != ''", qa="category = 'qa'"),
    "select count(*) as total, count_if(is_active) as active, count_if(indexing_status = 'pending') as pending, count_if(indexing_status = 'failed') as failed, count_if(source_url is not null and source_url != '') as url, count_if(category = 'qa') as qa from knowledge_base",
)
_add(
    "a_feedback_stats",
    lambda s, d: A.counts_where(table(s, d, "chat_feedback").where("created_at >= timestamp '2025-01-01' and created_at < timestamp '2025-07-01'"), total="true", likes="feedback_type = 'like'", dislikes="feedback_type = 'dislike'", reports="feedback_type = 'report'", guests="user_type = 'guest'", users="user_type = 'user'"),
    "select count(*) as total, count_if(feedback_type = 'like') as likes, count_if(feedback_type = 'dislike') as dislikes, count_if(feedback_type = 'report') as reports, count_if(user_type = 'guest') as guests, count_if(user_type = 'user') as users from chat_feedback where created_at >= timestamp '2025-01-01' and created_at < timestamp '2025-07-01'",
)
_add(
    "a_positive_pct",
    lambda s, d: A.counts_where(table(s, d, "chat_feedback"), likes="feedback_type = 'like'", dislikes="feedback_type = 'dislike'").withColumn("positive_pct", A.percent(F.col("likes"), F.col("likes") + F.col("dislikes"))),
    "select likes, dislikes, case when likes + dislikes > 0 then round(likes * 100.0 / (likes + dislikes), 1) else 0.0 end as positive_pct from (select count_if(feedback_type = 'like') likes, count_if(feedback_type = 'dislike') dislikes from chat_feedback)",
)
_add(
    "a_daily_feedback",
    lambda s, d: table(s, d, "chat_feedback").where(f"created_at >= timestamp '{AS_OF}' - interval 30 day").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "feedback_type").agg(F.count("*").alias("n")),
    f"select strftime(created_at, '%Y-%m-%d') as day, feedback_type, count(*) as n from chat_feedback where created_at >= timestamp '{AS_OF}' - interval 30 day group by all",
)
_add(
    "a_top_days",
    lambda s, d: table(s, d, "chat_feedback").groupBy(F.to_date("created_at").alias("x")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(5).select(F.date_format("x", "dd.MM.yyyy").alias("day"), "n"),
    "select strftime(x, '%d.%m.%Y') as day, n from (select cast(created_at as date) x, count(*) n from chat_feedback group by 1 order by n desc, x limit 5)",
)
_add(
    "a_token_sum",
    lambda s, d: table(s, d, "messages").where(f"role = 'assistant' and created_at >= timestamp '{AS_OF:%Y-%m-%d}' - interval 1 day").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens")),
    f"select count(*) as n, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens from messages where role = 'assistant' and cast(created_at as date) >= date '{AS_OF:%Y-%m-%d}' - interval 1 day",
)
_add(
    "a_error_rate",
    lambda s, d: A.counts_where(table(s, d, "events"), errors="event_type = 'error'", total="true").withColumn("error_pct", A.percent(F.col("errors"), F.col("total"), 2)),
    "select errors, total, round(errors * 100.0 / total, 2) as error_pct from (select count_if(event_type = 'error') errors, count(*) total from events)",
)
_add(
    "a_quality_dist",
    lambda s, d: table(s, d, "knowledge_base").groupBy(F.coalesce(F.get_json_object("metadata", "$.quality"), F.lit("unknown")).alias("quality")).agg(F.count("*").alias("n")),
    "select coalesce(case when json_valid(metadata) then json_extract_string(metadata, '$.quality') end, 'unknown') as quality, count(*) as n from knowledge_base group by 1",
)
_add(
    "a_kb_stats",
    lambda s, d: A.counts_where(table(s, d, "knowledge_base"), total="true", active="is_active", url="source_url like 'http%'", manual="coalesce(source_url, '') = '' and coalesce(category, '') != 'qa'", mojibake=r"content rlike '[ÃÅÄ][\u0080-¿]'"),
    r"select count(*) as total, count_if(is_active) as active, count_if(source_url like 'http%') as url, count_if(coalesce(source_url, '') = '' and coalesce(category, '') != 'qa') as manual, count_if(regexp_matches(content, '[ÃÅÄ][\x{80}-\x{bf}]')) as mojibake from knowledge_base",
)
_CLASS = "case when source_url is not null and source_url != '' then 'url' when category = 'qa' then 'qa' else 'manual' end"
_add(
    "a_source_breakdown",
    lambda s, d: table(s, d, "knowledge_base").groupBy(F.expr(_CLASS).alias("source_type")).agg(F.count("*").alias("n"), F.avg(F.length("content")).alias("avg_chars")).withColumn("avg_chars", F.round("avg_chars", 3)),
    f"select {_CLASS} as source_type, count(*) as n, round(avg(length(content)), 3) as avg_chars from knowledge_base group by 1",
)
_add(
    "a_distinct_ips",
    lambda s, d: table(s, d, "chat_sessions").where("ip_address is not null and not is_active").select("id", "ip_address").distinct().orderBy("id", "ip_address").limit(5).select("ip_address").distinct(),
    "select distinct ip_address from (select distinct id, ip_address from chat_sessions where ip_address is not null and not is_active order by id, ip_address limit 5)",
)
_add(
    "w_pct_total",
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("pct", F.expr("round(n * 100.0 / sum(n) over (), 2)").cast("double")),
    "select event_type, count(*) as n, cast(round(count(*) * 100.0 / sum(count(*)) over (), 2) as double) as pct from events group by 1",
)
_add(
    "w_rank_users",
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(100).withColumn("rank", F.expr("row_number() over (order by n desc, user_id)").cast("bigint")),
    "select user_id, count(*) as n, row_number() over (order by count(*) desc, user_id) as rank from events group by 1 order by n desc, user_id limit 100",
)
_add(
    "st_usage_periods",
    lambda s, d: table(s, d, "messages").where("chat_session_id is not null").groupBy(F.date_format("created_at", "yyyy-MM").alias("period"), "chat_session_id").agg(F.count("*").alias("messages"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("characters")),
    "select strftime(created_at, '%Y-%m') as period, chat_session_id, count(*) as messages, cast(coalesce(sum(length(content)), 0) as bigint) as characters from messages where chat_session_id is not null group by all",
)
_add(
    "st_dup_ip",
    lambda s, d: table(s, d, "chat_sessions").where("ip_address is not null and user_id is not null").groupBy("ip_address").agg(F.countDistinct("user_id").alias("users"), F.min_by("user_id", F.struct("created_at", "id")).alias("first_user")).where("users > 1"),
    "select ip_address, count(distinct user_id) as users, arg_min(user_id, (created_at, id)) as first_user from chat_sessions where ip_address is not null and user_id is not null group by 1 having count(distinct user_id) > 1",
)
