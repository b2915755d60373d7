"""Queries for scans, predicates, joins, order and pages, set operations, windows and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.operators.skew import beside
from quern.sources import table

QUERIES, ORACLE = {}, {}


def _add(name: str, f, sql: str) -> None:  # noqa: ANN001
    QUERIES[name], ORACLE[name] = f, sql


_SESSIONS = "(select distinct id, session_id, user_id, title, is_active, ip_address, created_at from chat_sessions)"


def sessions(s, d):  # noqa: ANN001, ANN201
    """Sessions without the copies that differ in updated_at only."""
    return table(s, d, "chat_sessions").select("id", "session_id", "user_id", "title", "is_active", "ip_address", "created_at").distinct()


# 2.1 scans
_add("scan_table", lambda s, d: table(s, d, "customer").where("c_acctbal > 0"), "select * from customer where c_acctbal > 0")
_add("scan_projected", lambda s, d: table(s, d, "knowledge_base").select("id", "title", "source", "language"), "select id, title, source, language from knowledge_base")
_add("point_lookup", lambda s, d: table(s, d, "orders").where("o_orderkey = 7"), "select * from orders where o_orderkey = 7")
# 2.2 predicates
_add("f_eq", lambda s, d: table(s, d, "messages").where("role = 'user'").select("id"), "select id from messages where role = 'user'")
_add("f_neq", lambda s, d: table(s, d, "messages").where("role != 'user'").select("id", "role"), "select id, role from messages where role != 'user'")
_add("f_range", lambda s, d: table(s, d, "lineitem").where("l_quantity >= 10 and l_quantity < 12 and l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_quantity"), "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity < 12 and l_discount > 0.05")
_add("f_null", lambda s, d: table(s, d, "chat_feedback").where("user_comment is null and message_id is not null").select("id", "message_id"), "select id, message_id from chat_feedback where user_comment is null and message_id is not null")
_add("f_in", lambda s, d: table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n")), "select o_orderpriority, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1")
_add("f_notin", lambda s, d: sessions(s, d).join(table(s, d, "messages").where("chat_session_id is not null").select(F.col("chat_session_id").alias("id")).distinct(), "id", "left_anti").select("id"), f"select id from {_SESSIONS} where id not in (select chat_session_id from messages where chat_session_id is not null)")
_add("f_between", lambda s, d: table(s, d, "chat_feedback").where("created_at between timestamp '2025-03-01' and timestamp '2025-04-01'").select("id", "feedback_type"), "select id, feedback_type from chat_feedback where created_at between timestamp '2025-03-01' and timestamp '2025-04-01'")
_add("f_date", lambda s, d: table(s, d, "messages").where("created_at >= timestamp '2025-06-01' and created_at < timestamp '2025-06-02'").select("id"), "select id from messages where cast(created_at as date) = date '2025-06-01'")
_add("f_yearmonth", lambda s, d: table(s, d, "messages").where("created_at >= timestamp '2025-06-01' and created_at < timestamp '2025-07-01'").agg(F.count("*").alias("n")), "select count(*) as n from messages where year(created_at) = 2025 and month(created_at) = 6")
_add("f_month_any_year", lambda s, d: table(s, d, "messages").where("month(created_at) = 6").agg(F.count("*").alias("n")), "select count(*) as n from messages where month(created_at) = 6")
_add("f_like", lambda s, d: table(s, d, "knowledge_base").where(F.lower("title").contains("namaz") | F.col("source_url").startswith("http://www")).select("id", "title"), "select id, title from knowledge_base where contains(lower(title), 'namaz') or source_url like 'http://www%'")
_add("f_or_group", lambda s, d: table(s, d, "knowledge_base").where("is_active and (category = 'qa' or language = 'tr')").select("id"), "select id from knowledge_base where is_active and (category = 'qa' or language = 'tr')")
_KEYS = ["namaz", "oruc", "search", "пост"]
_add("f_any_like", lambda s, d: table(s, d, "messages").withColumn("t", F.lower("content")).where(F.exists(F.array(*[F.lit(k) for k in _KEYS]), lambda k: F.col("t").contains(k))).select("id"), "select id from messages where " + " or ".join(f"contains(lower(content), '{k}')" for k in _KEYS))
_FIELDS = ["title", "content", "source", "category"]
_any = lambda k: F.exists(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in _FIELDS]), lambda x: x.contains(k))
_add("f_all_like", lambda s, d: table(s, d, "knowledge_base").where(_any("namaz") & _any("oruc")).select("id"), "select id from knowledge_base where " + " and ".join("(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{k}')" for c in _FIELDS) + ")" for k in ("namaz", "oruc")))
_add("f_exists", lambda s, d: sessions(s, d).join(table(s, d, "chat_feedback").where("session_id is not null").select("session_id").distinct(), "session_id", "left_semi").select("id"), f"select id from {_SESSIONS} c where exists (select 1 from chat_feedback f where f.session_id = c.session_id)")
_add("f_valid_url", lambda s, d: table(s, d, "knowledge_base").where("try_parse_url(trim(source_url), 'HOST') is not null").select("id"), r"select id from knowledge_base where regexp_matches(trim(source_url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+')")
_add("p_case", lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end").alias("band")).groupBy("band").agg(F.count("*").alias("n")), "select case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end as band, count(*) as n from orders group by 1")
_add("p_coalesce", lambda s, d: table(s, d, "chat_feedback").select("id", F.expr("coalesce(nullif(trim(user_name), ''), 'Qonaq')").alias("name")), "select id, coalesce(nullif(trim(user_name), ''), 'Qonaq') as name from chat_feedback")
_IP = "case when ip_address is null then '-' when ip_address = '::1' then '127.0.0.1' else regexp_replace(ip_address, '^::ffff:', '') end"
_add("p_ip_norm", lambda s, d: table(s, d, "chat_sessions").select("id", F.expr(_IP).alias("ip")).groupBy("ip").agg(F.countDistinct("id").alias("n")), f"select {_IP} as ip, count(distinct id) as n from chat_sessions group by 1")
_add("p_source_type", lambda s, d: table(s, d, "knowledge_base").select("id", F.expr("coalesce(source_url, '') like '%://%'").alias("is_url"), F.expr("coalesce(category, '') = 'qa'").alias("is_qa")).withColumn("is_manual", F.expr("not is_url and not is_qa")), "select id, coalesce(source_url, '') like '%://%' as is_url, coalesce(category, '') = 'qa' as is_qa, not coalesce(source_url, '') like '%://%' and not coalesce(category, '') = 'qa' as is_manual from knowledge_base")
# 2.3 joins
_add("j_with_count", lambda s, d: R.with_count(sessions(s, d).select("id"), "id", table(s, d, "messages"), "chat_session_id", "messages"), f"select c.id, count(m.id) as messages from {_SESSIONS} c left join messages m on m.chat_session_id = c.id group by 1")
_add("j_eager_nto1", lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name"), "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
_add("j_eager_1ton", lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines")), "o_orderkey", "left").select("o_orderkey", "lines"), "select o_orderkey, string_agg(l_linenumber, ',' order by l_linenumber) as lines from orders left join lineitem on l_orderkey = o_orderkey group by 1")
_add("j_user_limits", lambda s, d: R.page(table(s, d, "customer").join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most")), "c_custkey", "left").select("c_custkey", "c_name", "most"), [F.desc_nulls_last("most"), "c_custkey"], 2, 15), "select c_custkey, c_name, max(o_totalprice) as most from customer left join orders on o_custkey = c_custkey group by 1, 2 order by most desc nulls last, c_custkey limit 15 offset 15")
_add("j_orphans", lambda s, d: table(s, d, "messages").where("chat_session_id is not null").join(table(s, d, "chat_sessions").select(F.col("id").alias("chat_session_id")).distinct(), "chat_session_id", "left_anti").select("id"), "select m.id from messages m left join chat_sessions c on c.id = m.chat_session_id where m.chat_session_id is not null and c.id is null")
_add("j_semi_search", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").where("o_orderstatus = 'P' or c_mktsegment = 'BUILDING'").select("o_orderkey"), "select o_orderkey from orders left join customer on o_custkey = c_custkey where o_orderstatus = 'P' or c_mktsegment = 'BUILDING'")
_add(
    "j_lookup_fallback",
    lambda s, d: (
        # texts meet by their hash; equal hashes of different texts are told apart by the text itself
        lambda f, by_id, by_text: f.join(by_id, "message_id", "left").withColumn("h", F.xxhash64("message_content")).join(by_text, (F.col("h") == F.col("k")) & (F.col("message_content") == F.col("said")), "left").select("id", F.coalesce("direct", "other").alias("resolved"))
    )(
        table(s, d, "chat_feedback").select("id", "message_id", "message_content").distinct(),
        table(s, d, "messages").select(F.col("id").alias("message_id"), F.col("id").alias("direct")).distinct(),
        table(s, d, "messages").where("content is not null").groupBy(F.xxhash64("content").alias("k"), F.col("content").alias("said")).agg(F.min("id").alias("other")),
    ),
    """select f.id, coalesce(a.id, b.id) as resolved from (select distinct id, message_id, message_content from chat_feedback) f
    left join (select distinct id from messages) a on a.id = f.message_id left join (select content, min(id) id from messages group by 1) b on b.content = f.message_content""",
)
_add("j_user_or_deleted", lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_custkey % 3 != 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("Silinmiş istifadəçi")).alias("name")), "select o_orderkey, coalesce(c_name, 'Silinmiş istifadəçi') as name from orders left join (select * from customer where c_custkey % 3 != 0) on o_custkey = c_custkey")
_ORDERED = "partition by chat_session_id order by created_at, id"
_add("j_prev_user_msg", lambda s, d: beside(table(s, d, "messages").distinct(), "chat_session_id", "created_at", "id", F.expr("case when role = 'user' then content end"), "question").where("role = 'assistant'").select("id", "question"), f"select id, question from (select id, role, last_value(case when role = 'user' then content end ignore nulls) over ({_ORDERED} rows between unbounded preceding and 1 preceding) question from (select distinct * from messages)) where role = 'assistant'")
_add("j_adjacent_pairs", lambda s, d: beside(table(s, d, "messages").distinct(), "chat_session_id", "created_at", "id", F.struct("id", "role"), "next", ahead=True).where("role = 'user' and next.role = 'assistant'").select("id", F.col("next.id").alias("answer")), f"select id, answer from (select id, role, lead(id) over ({_ORDERED}) answer, lead(role) over ({_ORDERED}) nxt from (select distinct * from messages)) where role = 'user' and nxt = 'assistant'")
_add("w_recent10", lambda s, d: R.newest_per_key(table(s, d, "messages").where("chat_session_id is not null").select("chat_session_id", "created_at", "id").distinct(), ["chat_session_id"], ["created_at", "id"], 10).select("chat_session_id", "id"), "select chat_session_id, id from (select chat_session_id, id, row_number() over (partition by chat_session_id order by created_at desc, id desc) n from (select distinct chat_session_id, created_at, id from messages where chat_session_id is not null)) where n <= 10")
# 2.6 order and pages
_add("s_order", lambda s, d: table(s, d, "knowledge_categories").orderBy("sort_order", "id").select("id", "category_key"), "select id, category_key from knowledge_categories order by sort_order, id")
_add("s_multi", lambda s, d: table(s, d, "part").orderBy("p_brand", F.desc("p_size"), "p_partkey").select("p_partkey", "p_brand", "p_size").limit(50), "select p_partkey, p_brand, p_size from part order by p_brand, p_size desc, p_partkey limit 50")
_RANK = "case when contains(lower(title), 'namaz') then 1 when contains(lower(content), 'namaz') then 2 else 3 end"
_add("s_case_rank", lambda s, d: table(s, d, "knowledge_base").select("id", "title", F.expr(_RANK).alias("rank")).orderBy("rank", "id").limit(20), f"select id, title, {_RANK} as rank from knowledge_base order by rank, id limit 20")
_PRIO = "case event_type when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"
_add("s_priority", lambda s, d: table(s, d, "events").select("event_id", F.expr(_PRIO).alias("prio"), "ts").orderBy("prio", F.desc("ts"), "event_id").limit(25).select("event_id", "prio"), f"select event_id, {_PRIO} as prio from events order by prio, ts desc, event_id limit 25")
_add("s_topk", lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
_add("s_page", lambda s, d: R.page(table(s, d, "messages").select("id", "created_at").distinct(), [F.desc("created_at"), F.desc("id")], 3, 20).select("id"), "select id from (select distinct id, created_at from messages) order by created_at desc, id desc limit 20 offset 40")
_add("s_page_info", lambda s, d: R.page_info(table(s, d, "messages"), 3, 20), "select count(*) as total, greatest(cast(ceil(count(*) / 20.0) as bigint), 1) as last_page, least(41, count(*)) as first_row, least(60, count(*)) as last_row from messages")
_LIMIT = "case when length(message_content) > 100 then concat(rtrim(substring(message_content, 1, 100)), '...') else message_content end"
_add("s_recent", lambda s, d: table(s, d, "chat_feedback").select("id", "created_at", F.expr(_LIMIT).alias("text")).distinct().orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "text"), f"select id, text from (select distinct id, created_at, {_LIMIT} as text from chat_feedback) order by created_at desc, id desc limit 50")
_add("s_feedback_list", lambda s, d: R.page(table(s, d, "chat_feedback").where("feedback_type = 'like'").select("id", "user_name", "created_at").distinct(), [F.desc("created_at"), F.desc("id")], 1, 20).select("id", "user_name"), "select id, user_name from (select distinct id, user_name, created_at from chat_feedback where feedback_type = 'like') order by created_at desc, id desc limit 20")
_SEARCH = "contains(lower(title), 'oruc') or contains(lower(content), 'oruc') or contains(lower(source), 'oruc') or contains(lower(coalesce(category, '')), 'oruc')"
_add("s_kb_list", lambda s, d: R.page(table(s, d, "knowledge_base").where(_SEARCH), [F.desc("created_at"), F.desc("id")], 1, 10).select("id", "title"), f"select id, title from knowledge_base where {_SEARCH} order by created_at desc, id desc limit 10")
_add("s_transcript", lambda s, d: R.page(table(s, d, "messages").where("chat_session_id = 1").distinct(), ["created_at", "id"], 2, 10).select("id", "role", "content"), "select id, role, content from (select distinct * from messages where chat_session_id = 1) order by created_at, id limit 10 offset 10")
# 2.7 set operations
_add("set_distinct", lambda s, d: table(s, d, "knowledge_base").select("language").distinct(), "select distinct language from knowledge_base")
_add("set_except", lambda s, d: table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti"), "select c_custkey from customer except select o_custkey from orders")
_add("set_intersect", lambda s, d: table(s, d, "messages").select("content").intersect(table(s, d, "chat_feedback").select(F.col("message_content").alias("content"))), "select content from messages intersect select message_content from chat_feedback")
_b = lambda s, d, c: table(s, d, "knowledge_base").where(c).select("id", "title")
_add(
    "l_search_relevant",
    lambda s, d: R.merge_ranked([(_b(s, d, "source_url like 'http%' and contains(lower(title), 'oruc')"), 3), (_b(s, d, "contains(lower(title), 'oruc')"), None), (_b(s, d, "contains(lower(content), 'oruc') and contains(lower(content), 'namaz')"), None)], "id", ["id"], 8),
    """with a as (select id, title from knowledge_base where source_url like 'http%' and contains(lower(title), 'oruc') order by id limit 3),
    u as (select *, 1 as prio from a union all select id, title, 2 from knowledge_base where contains(lower(title), 'oruc') union all select id, title, 3 from knowledge_base where contains(lower(content), 'oruc') and contains(lower(content), 'namaz'))
    select id, title, min(prio) as prio from u group by 1, 2 order by prio, id limit 8""",
)
_add(
    "set_first_tier",
    lambda s, d: R.first_nonempty([_b(s, d, "title = 'no such title'"), _b(s, d, "contains(lower(title), 'zəkat')"), _b(s, d, "true")]),
    """with t as (select id, title, 2 as tier from knowledge_base where contains(lower(title), 'zəkat') union all select id, title, 3 from knowledge_base)
    select * from t where tier = (select min(tier) from t)""",
)
_add("set_map_merge", lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.map_from_entries(F.map_entries(F.map_zip_with(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("seen"), F.lit(1).cast("bigint")), lambda k, a, b: F.coalesce(b, a))))).alias("x")).select("event_id", F.get_json_object("x", "$.seen").cast("bigint").alias("seen"), F.get_json_object("x", "$.k").cast("bigint").alias("k")), "select event_id, cast(1 as bigint) as seen, cast(json_extract(props, '$.k') as bigint) as k from events")
# 2.11 keyed writes
_SRC = "select o_custkey as c_custkey, concat('new ', max(o_orderkey)) as c_name from orders where o_custkey % 10 = 0 or o_custkey > 1000 group by 1"
_src = lambda s, d: table(s, d, "orders").where("o_custkey % 10 = 0 or o_custkey > 1000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("new "), F.max("o_orderkey")).alias("c_name"))
_cust = lambda s, d: table(s, d, "customer").where("c_custkey % 7 != 0").select("c_custkey", "c_name")
_add("m_update_or_create", lambda s, d: R.upsert(_cust(s, d), _src(s, d), ["c_custkey"]), f"with s as ({_SRC}) select * from s union all select c_custkey, c_name from customer where c_custkey % 7 != 0 and c_custkey not in (select c_custkey from s)")
_add("m_first_or_create", lambda s, d: R.insert_missing(_cust(s, d), _src(s, d), ["c_custkey"]), f"with s as ({_SRC}), t as (select c_custkey, c_name from customer where c_custkey % 7 != 0) select * from t union all select * from s where c_custkey not in (select c_custkey from t)")
_add("m_latest_rows", lambda s, d: R.newest_per_key(table(s, d, "chat_sessions"), ["id"], ["updated_at"]).select("id", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")), "select id, title, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated from (select *, row_number() over (partition by id order by updated_at desc) n from chat_sessions) where n = 1")
_add("m_upsert_url", lambda s, d: R.newest_per_key(table(s, d, "knowledge_base").where("source_url like '%://%'").select(F.lower(F.regexp_replace("source_url", r"[?#].*$|/+$", "")).alias("url"), "updated_at", "id", "title"), ["url"], ["updated_at", "id"]).select("url", "id"), r"select url, id from (select lower(regexp_replace(source_url, '[?#].*$|/+$', '')) url, id, row_number() over (partition by lower(regexp_replace(source_url, '[?#].*$|/+$', '')) order by updated_at desc, id desc) n from knowledge_base where source_url like '%://%') where n = 1")
_add("m_delete", lambda s, d: R.delete_matching(table(s, d, "chat_feedback").select("id", "user_comment"), "user_comment like '%?%'"), "select id, user_comment from chat_feedback where not coalesce(user_comment like '%?%', false)")
_add("m_cascade", lambda s, d: R.cascade_delete(table(s, d, "orders"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey", "o_orderstatus = 'F'")[1].groupBy("l_returnflag").agg(F.count("*").alias("n")), "select l_returnflag, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1")
_add("m_increment", lambda s, d: table(s, d, "messages").where("chat_session_id is not null").groupBy("chat_session_id").agg(F.count("*").alias("message_count"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last")), "select chat_session_id, count(*) as message_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last from messages where chat_session_id is not null group by 1")
_add("m_keep_500", lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id"), "select event_id from events order by ts desc, event_id desc limit 500")
_add("st_expire", lambda s, d: table(s, d, "chat_sessions").where("ended_at is null or ended_at > timestamp '2025-06-01'").select("id").distinct(), "select distinct id from chat_sessions where ended_at is null or ended_at > timestamp '2025-06-01'")
