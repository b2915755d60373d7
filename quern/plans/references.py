"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.references import orphan_references, orphan_report
from quern.sources import table


def p4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, feedback, sessions = (table(spark, sf_dir, t) for t in ("messages", "chat_feedback", "chat_sessions"))
    return orphan_references(messages, sessions, "messages", reference="chat_session_id").unionByName(
        orphan_references(feedback, messages, "chat_feedback", reference="message_id")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_orphans(spark, sf_dir).select("child_table", "child_id", "kind")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p4_orphans(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_ORPHANS = """
with sess as (select id, min(created_at) f from chat_sessions group by id),
msg as (select id, min(created_at) f from messages group by id),
c as (
  select 'messages' as child_table, m.id as child_id, m.chat_session_id as ref, m.created_at as made,
         case when s.id is null then 'missing' when s.f > m.created_at then 'late' end as kind
  from messages m left join sess s on s.id = m.chat_session_id where m.chat_session_id is not null
  union all
  select 'chat_feedback', f.id, f.message_id, f.created_at,
         case when m.id is null then 'missing' when m.f > f.created_at then 'late' end
  from chat_feedback f left join msg m on m.id = f.message_id where f.message_id is not null),
o as (select *, row_number() over (partition by child_table, child_id order by kind desc, made desc, ref desc) rn from c where kind is not null)
"""

ORACLE = {
    "p4_found": _ORPHANS + "select child_table, child_id, kind from o where rn = 1",
    "p4_report": _ORPHANS + "select child_table, strftime(made, '%Y-%m') as month, kind, count(*) as n_rows, count(distinct ref) as n_refs from o where rn = 1 group by all",
}
