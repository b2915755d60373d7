"""Queries for searches by categories, fallbacks, continuation, concepts and table sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.operators import retrieval as Q
from quern.plans.retrieval import _HITS, _hits
from quern.sources import table

QUERIES, ORACLE = {}, {}


def _add(name: str, f, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def optional(df, **filters):  # noqa: ANN001, ANN201
    """DF with a filter for every parameter that is given."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


_kb = lambda s, d: table(s, d, "knowledge_base")
_add("f_optional", lambda s, d: optional(table(s, d, "chat_feedback"), feedback_type="report", user_type=None).select("id"), "select id from chat_feedback where feedback_type = 'report'")
_add("f_js_search", lambda s, d: R.page(table(s, d, "customer").where(F.lower("c_name").contains("1") & (F.col("c_mktsegment") == "BUILDING")), ["c_name", "c_custkey"], 2, 10).select("c_custkey", "c_name"), "select c_custkey, c_name from customer where contains(lower(c_name), '1') and c_mktsegment = 'BUILDING' order by c_name, c_custkey limit 10 offset 10")
for _name, _cat, _k in (("l_qa", "category = 'qa'", 2), ("l_general", "coalesce(category, '') not in ('qa', 'site', 'page')", 2), ("l_broad", "true", 3)):
    _where = f"is_active and ({_cat}) and (contains(lower(title), 'namaz') or contains(lower(content), 'namaz'))"
    _tier = "case when contains(lower(title), 'namaz') then 1 else 2 end"
    _add(_name, lambda s, d, w=_where, k=_k: _kb(s, d).where(w).select("id", "title", F.expr(_tier).alias("tier")).orderBy("tier", "id").limit(k), f"select id, title, {_tier} as tier from knowledge_base where {_where} order by tier, id limit {_k}")


def _last_resort(s, d):  # noqa: ANN001, ANN202
    """Without a usable hit: the first six vectors of the two labels that score most, per question."""
    best = Q.dominant(_hits(s, d), of="label", top=2).select("question_id", "label")
    first = R.newest_per_key(table(s, d, "embeddings").select("label", (-F.col("vec_id")).alias("v")), ["label"], ["v"], 6).select("label", (-F.col("v")).alias("vec_id"))
    rows = first.join(best, "label")
    w = Window.partitionBy("question_id").orderBy("vec_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 6").select("question_id", "vec_id")


_add(
    "r_last_resort", _last_resort,
    _HITS + """, t as (select question_id, label, round(sum(score), 9) as total from h group by 1, 2), b as (select * from t qualify row_number() over (partition by question_id order by t.total desc, label) <= 2)
    select question_id, vec_id from (select b.question_id, e.vec_id, row_number() over (partition by b.question_id order by e.vec_id) n from embeddings e join b on b.label = e.label) where n <= 6""",
)


def _continue(s, d):  # noqa: ANN001, ANN202
    """After the third row of each conversation the next twelve, until 240 characters are passed."""
    m = table(s, d, "messages").where("chat_session_id is not null and content is not null").distinct()
    w = Window.partitionBy("chat_session_id").orderBy("created_at", "id")  # each task keeps the first fifteen of a conversation before the shuffle
    rows = m.withColumn("n", F.row_number().over(w)).where("n <= 15").where("n > 3")
    return R.within_budget(rows, ["chat_session_id"], ["n"], F.length("content") + 1, 240).select("chat_session_id", "id", F.col("n").cast("bigint").alias("n"))


_add(
    "r_continue", _continue,
    """with r as (select *, row_number() over (partition by chat_session_id order by created_at, id) n from (select distinct * from messages where chat_session_id is not null and content is not null)),
    b as (select *, sum(length(content) + 1) over (partition by chat_session_id order by n rows between unbounded preceding and 1 preceding) used from r where n > 3 and n <= 15)
    select chat_session_id, id, n from b where coalesce(used, 0) < 240""",
)
_CONCEPTS = ["dəstəmaz", "namaz", "oruc", "zəkat", "həcc", "qiblə"]
_add("t_key_concept", lambda s, d: table(s, d, "messages").where("content is not null").select("id", F.get(F.filter(F.array(*map(F.lit, _CONCEPTS)), lambda k: F.lower("content").contains(k)), F.lit(0)).alias("concept")).groupBy("concept").agg(F.count("*").alias("n")), "select case " + " ".join(f"when contains(lower(content), '{k}') then '{k}'" for k in _CONCEPTS) + " end as concept, count(*) as n from messages where content is not null group by 1")
_add("t_term_bold", lambda s, d: table(s, d, "messages").where("content is not null").select("id", F.md5(F.regexp_replace("content", r"(?i)(^|[^\p{L}\p{N}_])(namaz|token)([^\p{L}\p{N}_]|$)", "$1**$2**$3")).alias("hash")), r"select id, md5(regexp_replace(content, '(?i)(^|[^\p{L}\p{N}_])(namaz|token)([^\p{L}\p{N}_]|$)', '\1**\2**\3', 'g')) as hash from messages where content is not null")
_add("s_keyset", lambda s, d: table(s, d, "messages").groupBy(F.expr("id div 200").alias("batch")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")), "select id // 200 as batch, min(id) as first_id, max(id) as last_id, count(*) as n from messages group by 1")
_TABLES = ["messages", "chat_sessions", "chat_feedback", "knowledge_base", "documents", "lineitem", "orders"]


def _sizes(s, d):  # noqa: ANN001, ANN202
    out = None
    for t in _TABLES:
        n = table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_add("catalog_size", _sizes, " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _TABLES))


def _file_sizes(s, d):  # noqa: ANN001, ANN202
    """Bytes of the files of each table, from the metadata of the scan; no column is read."""
    out = None
    for t in _TABLES:
        files = table(s, d, t).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("size"))
        n = files.agg(F.sum("size").alias("bytes")).select(F.lit(t).alias("name"), "bytes")
        out = n if out is None else out.unionByName(n)
    return out


_add("catalog_bytes", _file_sizes)
_add(
    "r_resolve",
    lambda s, d: (lambda h, e: h.join(e.select("vec_id", F.col("label").alias("direct")), "vec_id", "left").join(e.groupBy("label").agg(F.min("vec_id").alias("lowest")), "label", "left").select("question_id", "rank", "vec_id", F.coalesce("direct", "label").alias("source"), "lowest"))(_hits(s, d), table(s, d, "embeddings")),
    _HITS + " select question_id, rank, h.vec_id, h.label as source, lowest from h join (select label, min(vec_id) lowest from embeddings group by 1) l on l.label = h.label",
)
_add("a_model_usage", lambda s, d: table(s, d, "messages").groupBy(F.expr("lower(trim(coalesce(role, '')))").alias("role")).agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens")), "select lower(trim(coalesce(role, ''))) as role, count(*) as n, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens from messages group by 1")
