"""Queries for re-indexing, answers made of sentences, page blocks, writes and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.dom import clean_dom
from quern.functions.text import search_form
from quern.operators import ingest as I
from quern.operators import relational as R
from quern.plans import retrieval as P
from quern.sources import table, write_and_read

QUERIES, ORACLE = {}, {}


def _add(name: str, f, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


_kb = lambda s, d: table(s, d, "knowledge_base")
_EMPTY = "kb_id bigint, chunk_index int, content string, char_count int, vector_id string, vector array<double>"


def _reindexed(s, d):  # noqa: ANN001, ANN202
    """The whole index after the entries that are not completed are indexed anew with other chunk sizes."""
    kb = _kb(s, d).select("id", "content", "indexing_status").distinct()
    old = I.reindex(kb, s.createDataFrame([], _EMPTY), 1024, 200)[1]
    status, index = I.reindex(kb.where("indexing_status != 'completed'"), old, 600, 100)
    counts = index.groupBy(F.col("kb_id").alias("id")).agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), F.min("vector_id").alias("first_vector"))
    return counts.join(status.select("id", "indexing_status"), "id", "left")


_add("m_reindex", _reindexed)


def _answers(s, d):  # noqa: ANN001, ANN202
    """Answers to the titles of the pages whose id is divisible by 100, from the chunks of their five best pages."""
    words = F.regexp_extract_all(search_form(F.col("title")), F.lit(r"\p{L}{3,}"), F.lit(0))
    asked = _kb(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), words.alias("words")).dropDuplicates(["query_id"])
    hits = write_and_read(P.QUERIES["l_fulltext"](s, d).select("query_id", F.col("id").alias("kb_id"), "rank"), "hits")
    chunks = P.chunks(s, d, 400, 80).select("kb_id", "chunk_index", "content").join(hits.select("kb_id").distinct(), "kb_id", "left_semi").dropDuplicates(["kb_id", "chunk_index"])
    return I.extractive(asked, hits, chunks).select("query_id", F.length("answer").alias("chars"), F.md5("answer").alias("hash"))


_add("r_extractive", _answers)
_add("h_clean_dom", lambda s, d: _kb(s, d).select("id", F.md5(clean_dom("content")).alias("hash")))
_add(
    "m_upsert_title",
    lambda s, d: R.newest_per_key(_kb(s, d).where("coalesce(source_url, '') = ''").select("title", "updated_at", "id", "metadata"), ["title"], ["updated_at", "id"]).select("title", "id"),
    "select title, id from (select title, id, row_number() over (partition by title order by updated_at desc, id desc) n from knowledge_base where coalesce(source_url, '') = '') where n = 1",
)
_add(
    "m_upsert_url_counted",
    lambda s, d: _kb(s, d).where("source_url like '%://%'").select(F.lower(F.regexp_replace("source_url", r"[?#].*$|/+$", "")).alias("url"), "updated_at", "id", F.get_json_object("metadata", "$.quality").alias("q"))
    .groupBy("url").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"), F.count("*").alias("training_count"), F.max_by("q", F.when(F.col("q").isNotNull(), F.struct("updated_at", "id"))).alias("quality")),
    r"""with r as (select lower(regexp_replace(source_url, '[?#].*$|/+$', '')) as url, updated_at, id, case when json_valid(metadata) then json_extract_string(metadata, '$.quality') end as q from knowledge_base where source_url like '%://%')
    select url, arg_max(id, (updated_at, id)) as id, count(*) as training_count, arg_max(q, (updated_at, id)) filter (q is not null) as quality from r group by 1""",
)
_add(
    "m_bulk_update",
    lambda s, d: R.bulk_update(table(s, d, "orders"), "o_orderstatus = 'O' and o_totalprice > 200000", o_orderstatus=F.lit("P"), o_totalprice="o_totalprice * 0.5").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total")),
    """with u as (select case when o_orderstatus = 'O' and o_totalprice > 200000 then 'P' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'O' and o_totalprice > 200000 then o_totalprice * 0.5 else o_totalprice end as p from orders)
    select o_orderstatus, count(*) as n, cast(round(sum(p), 2) as double) as total from u group by 1""",
)
_add("m_truncate", lambda s, d: R.truncate(table(s, d, "orders")).agg(F.count("*").alias("n")), "select count(*) as n from orders where false")
_feedback = lambda s, d: table(s, d, "chat_feedback").select("id", "created_at", "feedback_type", "user_type").distinct()
_add(
    "s_whitelist",
    lambda s, d: I.ordered_by_choice(_feedback(s, d), "feedback_type", ["created_at", "feedback_type", "user_type"], "created_at", "id").limit(30).select("id", "feedback_type"),
    "select id, feedback_type from (select distinct id, created_at, feedback_type, user_type from chat_feedback) order by feedback_type desc, id desc limit 30",
)
_add(
    "s_whitelist_default",
    lambda s, d: I.ordered_by_choice(_feedback(s, d), "ip_address; drop", ["created_at", "feedback_type", "user_type"], "created_at", "id").limit(30).select("id"),
    "select id from (select distinct id, created_at, feedback_type, user_type from chat_feedback) order by created_at desc, id desc limit 30",
)
_add(
    "a_unread",
    lambda s, d: table(s, d, "chat_feedback").agg(F.count("*").alias("total"), F.count_if(F.col("user_comment").isNull()).alias("unread"), F.count_if(F.col("user_comment").isNull() & (F.col("feedback_type") == "report")).alias("important")),
    "select count(*) as total, count(*) filter (user_comment is null) as unread, count(*) filter (user_comment is null and feedback_type = 'report') as important from chat_feedback",
)
_add(
    "a_js_total_msgs",
    lambda s, d: R.with_count(table(s, d, "chat_sessions").where(F.lower("title").contains("namaz")).select("id").distinct(), "id", table(s, d, "messages"), "chat_session_id", "n").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages")),
    "select count(*) as messages from messages where chat_session_id in (select id from chat_sessions where contains(lower(title), 'namaz'))",
)
_LINE = "'[' || {at} || '] local.' || case event_type when 'error' then 'ERROR' else 'INFO' end || ': event ' || event_id"
_add(
    "log_tail",
    lambda s, d: I.last_errors(table(s, d, "events").select("ts", "event_id", F.expr(_LINE.format(at="date_format(ts, 'yyyy-MM-dd HH:mm:ss')")).alias("line")), ["ts", "event_id"], "line"),
    f"""with e as (select ts, event_id, {_LINE.format(at="strftime(ts, '%Y-%m-%d %H:%M:%S')")} as line from events order by ts desc, event_id desc limit 50)
    select substring(line, 2, 19) as at, line from e where contains(line, 'ERROR') order by ts desc, event_id desc limit 5""",
)
_RUNS = r"case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end"
_add(
    "t_similar_text",
    lambda s, d: I.similar_entries(_kb(s, d)).select("id", "first", F.round("similarity", 6).alias("similarity")),
    f"""with r as (select id, left(title, 50) as p, string_split_regex(lower(trim(content)), '\\s+') as w from knowledge_base where title is not null and content is not null),
    e as (select id, p, {_RUNS} as runs, min(id) over (partition by p) as first from r), j as (select a.id, a.first, len(list_intersect(a.runs, b.runs)) as i, len(a.runs) as x, len(b.runs) as y from e a join e b on b.id = a.first and b.p = a.p where a.id != a.first)
    select id, first, round(i * 1.0 / (x + y - i), 6) as similarity from j where i * 1.0 / (x + y - i) >= 0.8""",
)
