"""Queries for the text functions, over messages, feedback and the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.functions import text as T
from quern.sources import table

QUERIES, ORACLE = {}, {}


def _add(name: str, f, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def _over(name: str, cols, sql: str | None = None, t: str = "messages", key: str = "id", where: str = "content is not null") -> None:  # noqa: ANN001
    """A query (KEY, columns) over all rows of a table that meet WHERE."""
    _add(name, lambda s, d: table(s, d, t).where(where).select(key, *cols()), f"select {key}, {sql} from {t} where {where}" if sql else None)


_c = lambda: F.col("content")
_FOLD = f"translate(content, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
_LOW = f"lower(translate(trim(content), '{T.FOLD_FROM}', '{T.FOLD_TO}'))"
_or = lambda x, ws: "(" + " or ".join(f"contains({x}, '{w}')" for w in ws) + ")"
_over("t_fold_az", lambda: [T.fold(_c()).alias("folded")], f"{_FOLD} as folded")
_over("t_fold_nfkd", lambda: [F.md5(T.fold_all(_c())).alias("hash")])
_over("t_source_fmt", lambda: [F.md5(T.source_lines(_c())).alias("hash"), F.md5(T.source_lines(_c(), closed=False)).alias("open_hash")])
_search = f"lower({_FOLD})"
for _a, _b in T.ARABIC.items():
    _search = f"replace({_search}, '{_a}', '{_b}')"
_over("t_search_form", lambda: [T.search_form(_c()).alias("form")], rf"regexp_replace({_search}, '\p{{Mn}}+', '', 'g') as form")
_HAS = [r"regexp_matches(content, '\p{Arabic}')", r"regexp_matches(content, '\p{Cyrillic}')", "regexp_matches(content, '[A-Za-zÇƏĞIİÖŞÜçəğıiöşü]')"]
_over("t_script", lambda: [T.script(_c()).alias("script")], f"case when cast({_HAS[0]} as int) + cast({_HAS[1]} as int) + cast({_HAS[2]} as int) > 1 then 'mixed' when {_HAS[0]} then 'arabic' when {_HAS[1]} then 'cyrillic' when {_HAS[2]} then 'latin' else 'unknown' end as script")
_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_map = lambda m: "map {" + ", ".join(f"'{k}': {_list(v)}" for k, v in m.items()) + "}"
_DISTINCT = "list_reduce(list_transform({x}, lambda y: [y]), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end, cast([] as varchar[]))"
_TOK = lambda n, stop: rf"list_filter(regexp_extract_all(lower(content), '\p{{L}}{{{n},}}'), lambda t: not list_contains({_list(stop)}, t))"
_STEM = f"flatten(list_transform({_TOK(3, T.STOP_SHORT)}, lambda t: list_concat([t], list_transform(list_filter({_list(T.SUFFIXES)}, lambda s: ends_with(t, s) and length(t) - length(s) >= 3), lambda s: substring(t, 1, length(t) - length(s))))))"
_EXP = lambda x, m: f"flatten(list_transform({x}, lambda t: list_concat([t], coalesce(({_map(m)})[t], cast([] as varchar[])))))"
_join = lambda x: f"array_to_string({x}, '|')"
_text = lambda x: F.array_join(x, "|")
_over("t_keywords_simple", lambda: [_text(T.keywords_simple(_c())).alias("keywords")], f"{_join('(' + _DISTINCT.format(x=_EXP(_STEM, T.VARIANTS)) + ')[1:12]')} as keywords")
_LONGEST = lambda x: _DISTINCT.format(x=f"list_transform(list_sort(list_transform({x}, lambda t, i: {{'l': -length(t), 'i': i, 't': t}})), lambda p: p.t)")
_over("t_keywords_smart", lambda: [_text(T.keywords_smart(_c())).alias("keywords")], f"{_join(_DISTINCT.format(x=_EXP(_LONGEST(_TOK(2, T.STOP_LONG)), T.SYNONYMS)))} as keywords")
_over("t_synonyms", lambda: [_text(T._expand(T._tokens(_c(), 2, ["-"]), T.SYNONYMS)).alias("words")], f"{_join(_DISTINCT.format(x=_EXP(_TOK(2, ['-']), T.SYNONYMS)))} as words")
_over("s_len_desc", lambda: [_text(T.by_length(T._tokens(_c(), 2, T.STOP_LONG))).alias("words")], f"{_join(_LONGEST(_TOK(2, T.STOP_LONG)))} as words")
_over("t_keywords_enh", lambda: [_text(K.keywords_enhanced(_c())).alias("keywords")])
_over("t_reduce", lambda: [F.md5(K.reduced(_c(), 900)).alias("hash")], None, t="knowledge_base")
_SMALL = f"({_LOW} != '' and (regexp_matches({_LOW}, '{T.GREETING}') or regexp_matches({_LOW}, '{T.WELLBEING}') or regexp_matches({_LOW}, '{T.THANKS}') or (length({_LOW}) <= 12 and not contains(content, '?') and {_LOW} in ({', '.join(repr(w) for w in T.SHORT_GREETINGS)}))))"
_over("t_small_talk", lambda: [T.is_small_talk(_c()).alias("small_talk")], f"{_SMALL} as small_talk")
_Q = f"(contains(content, '?') or {_or(_LOW, T.QUESTION_CUES)})"
_add(
    "t_intent",
    lambda s, d: table(s, d, "messages").where("content is not null").groupBy(T.intent(_c()).alias("intent")).agg(F.count("*").alias("n"), F.sum("id").alias("ids")),
    f"""select case when {_LOW} = '' or {_SMALL} then 'SMALL_TALK' when {_or(_LOW, T.META_CUES)} then 'META' when {_Q} and {_or(_LOW, T.FIELD_TERMS)} then 'FIQH_QUESTION'
    when {_or(_LOW, T.OTHER_TERMS)} or {_Q} then 'OUT_OF_SCOPE' else 'SMALL_TALK' end as intent, count(*) as n, cast(sum(id) as bigint) as ids from messages where content is not null group by 1""",
)
_over("t_howto", lambda: [T.is_howto(_c()).alias("howto")], "contains(lower(content), 'necə') or contains(lower(content), 'qayda') or contains(lower(content), 'addım') as howto")
_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\n{3,}', E'\n\n', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]*\n[ \t]*', E'\n', 'g'), '\.([A-ZÇƏĞIİÖŞÜ])', '. \1', 'g')"
_over("t_ws", lambda: [F.md5(T.collapse_space(_c())).alias("hash")], rf"md5(trim(regexp_replace({_WS}, '^\s+|\s+$', '', 'g'))) as hash", t="knowledge_base")
_over("t_limit", lambda: [T.limit(_c(), 40).alias("text")], "case when length(content) > 40 then concat(rtrim(substring(content, 1, 40)), '...') else content end as text")
_over("t_ends_sentence", lambda: [T.ends_sentence(_c()).alias("ends")], r"regexp_matches(content, '[.!?…]\s*$') as ends")
_over("t_trim_sentence", lambda: [F.md5(T.trim_to_sentence(_c(), 300)).alias("hash")], r"""md5(case when length(content) <= 300 and regexp_matches(content, '[.!?…]\s*$') then content
 when regexp_extract(substring(content, 1, 300), '(?s)^(.+[.!?…\n])', 1) != '' then regexp_replace(regexp_extract(substring(content, 1, 300), '(?s)^(.+[.!?…\n])', 1), '\s+$', '')
 else regexp_replace(substring(content, 1, 300), '\s+$', '') end) as hash""", t="knowledge_base")
_over("t_truncate_smart", lambda: [F.md5(T.truncate_smart(_c(), 500)).alias("hash"), F.length(T.truncate_smart(_c(), 500)).alias("chars")], None, t="knowledge_base")
_over("t_quality", lambda: [T.quality(_c()).alias("quality")], "case when strlen(content) < 500 then 'low' when strlen(content) < 2000 then 'medium' when strlen(content) < 5000 then 'high' else 'excellent' end as quality", t="knowledge_base")
_CELL = r"""concat('"', trim(regexp_replace(replace(regexp_replace(message_content, '<[^>]*>', '', 'g'), '"', '""'), '\s+', ' ', 'g')), '"')"""
_add("t_csv_escape", lambda s, d: table(s, d, "chat_feedback").select("id", T.csv_cell(F.col("message_content")).alias("cell"), T.csv_cell(F.col("user_comment")).alias("comment")), f"""select id, case when message_content is null or message_content in ('', '0') then '""' else {_CELL} end as cell, case when user_comment is null or user_comment in ('', '0') then '""' else {_CELL.replace('message_content', 'user_comment')} end as comment from chat_feedback""")
_n = lambda p: f"len(regexp_extract_all(content, '{p}'))"
_over("t_mojibake_score", lambda: [T.mojibake_score(_c())[k].cast("bigint").alias(k) for k in ("letters", "markers", "question_marks", "lost")], rf"{_n('[əğıöüşçƏĞİÖÜŞÇ]')} as letters, {_n('[ÃÄÅÂÉ]')} as markers, {_n('[?]')} as question_marks, {_n('�')} as lost")
_add(
    "t_choose_variant",
    lambda s, d: table(s, d, "chat_feedback").select("id", F.md5(T.better_variant(F.col("message_content"), F.coalesce("user_comment", F.lit("")))).alias("hash")),
    "with s as (select id, message_content a, coalesce(user_comment, '') b from chat_feedback), k as (select *, " + ", ".join(f"[len(regexp_extract_all({x}, '[əğıöüşçƏĞİÖÜŞÇ]')), -len(regexp_extract_all({x}, '[ÃÄÅÂÉ]')), -len(regexp_extract_all({x}, '�')), -len(regexp_extract_all({x}, '[?]'))] as k{x}" for x in "ab") + " from s) select id, md5(case when kb > ka then b else a end) as hash from k",
)
_over("t_is_corrupted", lambda: [T.is_corrupted(_c()).alias("corrupted")], r"regexp_matches(content, '[ÃÄÅ][\x{80}-\x{bf}]') or contains(content, '�') or regexp_matches(content, '[\x{80}-\x{9f}]') or contains(content, 'â€') as corrupted")
_over("t_valid_utf8", lambda: [F.md5(T.clean_utf8(_c())).alias("hash")], r"md5(regexp_replace(content, '[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{2060}\x{feff}�□■]', '', 'g')) as hash")
_PAIR = "(select distinct f.id, f.message_content as answer, m.content as context from chat_feedback f join messages m on m.id = f.message_id where m.content is not null)"
_pair = lambda s, d: table(s, d, "chat_feedback").join(table(s, d, "messages").where("content is not null").select(F.col("id").alias("message_id"), F.col("content").alias("context")).distinct(), "message_id").select("id", F.col("message_content").alias("answer"), "context").distinct()
_add("t_hallucination", lambda s, d: _pair(s, d).select("id", F.size(T.unsupported_words(F.col("answer"), F.col("context"))).cast("bigint").alias("unsupported")), rf"select id, len(list_filter(list_distinct(regexp_extract_all(lower(answer), '\p{{L}}{{7,}}')), lambda w: not contains(lower(context), w))) as unsupported from {_PAIR}")
_add("t_validate_answer", lambda s, d: _pair(s, d).select("id", T.is_supported(F.col("answer"), F.col("context")).alias("supported")), rf"select id, len(list_filter(regexp_extract_all(lower(answer), '\p{{L}}{{5,}}'), lambda w: not contains(lower(context), w))) = 0 as supported from {_PAIR}")
_over("t_token_estimate", lambda: [T.token_estimate(_c()).alias("tokens")], "greatest(1, cast(ceil(length(content) / 4.0) as bigint)) as tokens")
