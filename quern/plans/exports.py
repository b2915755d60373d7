"""Queries for exports, imports and windowed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.sources import shared_dir, table
from quern.sources.sinks import export_csv, export_json, import_json, range_or_newest
from quern.streaming.windows import activity_sessions, tumbling_counts

QUERIES, ORACLE = {}, {}


_KB = "id bigint, title string, content string, source string, source_url string, category string, language string, metadata string, embedding array<float>, is_active boolean, indexing_status string, created_at timestamp, updated_at timestamp"


def exported(s, d):  # noqa: ANN001, ANN201
    """All entries written as JSON, beside an envelope (system_prompt, exported_at, items), and read back."""
    path, kb = shared_dir(s, "kb-json"), table(s, d, "knowledge_base")
    export_json(kb, f"{path}/knowledge_items")
    export_json(kb.agg(F.lit("").alias("system_prompt"), F.current_timestamp().alias("exported_at"), F.count("*").alias("items")), f"{path}/envelope")
    return import_json(s, f"{path}/knowledge_items", _KB)


def _imported(s, d):  # noqa: ANN001, ANN202
    """The entries that aren't active, from their export, written over the active ones by title and category."""
    cols = ["id", "title", "category", "updated_at"]
    target = table(s, d, "knowledge_base").where("is_active").select(*cols)
    return R.upsert(target, exported(s, d).where("not is_active").select(*cols), ["title", "category"], ["updated_at", "id"])


_AT = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
_SQL_AT = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"


def _csv_round_trip(s, d):  # noqa: ANN001, ANN202
    path = shared_dir(s, "feedback-csv")
    mark = "\ufeff"  # spreadsheets take a file with it for UTF-8
    export_csv(table(s, d, "chat_feedback").select(F.col("id").alias(f"{mark}id"), "feedback_type", F.regexp_replace(F.coalesce("message_content", F.lit("")), r"[\r\n]+", " ").alias("text")), path)
    return s.read.schema("id bigint, feedback_type string, text string").option("header", True).option("escape", '"').csv(path).select("id", "feedback_type", F.md5(F.trim(F.coalesce("text", F.lit("")))).alias("hash"))


QUERIES["kb_json_export"] = lambda s, d: exported(s, d).select("id", "title", F.md5("content").alias("hash"), "source", "source_url", "category", "language", "metadata", F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(F.lit(0)).cast("bigint").alias("dimensions"), "is_active", "indexing_status", _AT("created_at"), _AT("updated_at"))
ORACLE["kb_json_export"] = f"select id, title, md5(content) as hash, source, source_url, category, language, metadata, coalesce(len(embedding), 0) as dimensions, is_active, indexing_status, {_SQL_AT.format('created_at')}, {_SQL_AT.format('updated_at')} from knowledge_base"
QUERIES["kb_json_import"] = lambda s, d: _imported(s, d).select("id", "title", "category")
ORACLE["kb_json_import"] = """with n as (select id, title, category from (select *, row_number() over (partition by title, category order by updated_at desc, id desc) n from knowledge_base where not is_active) where n = 1)
select id, title, category from knowledge_base k where is_active and not exists (select 1 from n where n.title is not distinct from k.title and n.category is not distinct from k.category) union all select * from n"""
QUERIES["feedback_csv_export"] = _csv_round_trip
ORACLE["feedback_csv_export"] = r"select id, feedback_type, md5(trim(regexp_replace(coalesce(message_content, ''), '[\r\n]+', ' ', 'g'))) as hash from chat_feedback"
QUERIES["feedback_export_range"] = lambda s, d: range_or_newest(table(s, d, "chat_feedback").select("id", "created_at", "feedback_type").distinct(), "created_at", "id", "2025-02-01", "2025-03-01").select("id", "feedback_type")
ORACLE["feedback_export_range"] = """with f as (select distinct id, feedback_type, created_at from chat_feedback), r as (select id, feedback_type from f where created_at between timestamp '2025-02-01' and timestamp '2025-03-01')
select * from r union all select * from (select id, feedback_type from f where not exists (select 1 from r) order by created_at desc, id desc limit 500)"""
QUERIES["feedback_export_fallback"] = lambda s, d: range_or_newest(table(s, d, "chat_feedback").select("id", "created_at", "feedback_type").distinct(), "created_at", "id", "1999-02-01", "1999-03-01", 500).select("id", "feedback_type")
ORACLE["feedback_export_fallback"] = "select id, feedback_type from (select distinct id, feedback_type, created_at from chat_feedback) order by created_at desc, id desc limit 500"
QUERIES["st_tumbling"] = lambda s, d: tumbling_counts(table(s, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
ORACLE["st_tumbling"] = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all"
QUERIES["st_sessions"] = lambda s, d: activity_sessions(table(s, d, "events"), "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
ORACLE["st_sessions"] = """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end b from events),
s as (select user_id, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g), c as (select user_id, k, count(*) n from s group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from c group by 1"""
