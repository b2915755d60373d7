"""Queries for pages, links, chunks, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import chunking as C
from quern.functions import vectors as V
from quern.functions import web as H
from quern.functions.text import trim_to_sentence
from quern.operators import relational as R
from quern.operators import retrieval as Q
from quern.operators.crawl import reach
from quern.sources import table, write_and_read

QUERIES, ORACLE = {}, {}


def _add(name: str, f, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


_kb = lambda s, d: table(s, d, "knowledge_base")
_pages = lambda s, d: _kb(s, d).where("source_url like '%://%'")

# web
_UN = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_clean = "content"
for _tag in H.DROPPED:
    _clean = rf"regexp_replace({_clean}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
for _word in H.FURNITURE_CLASSES:
    for _tag in ("div", "ul", "section"):
        _clean = rf"""regexp_replace({_clean}, '(?is)<{_tag}\b[^>]*class=["''][^"'']*{_word}[^"'']*["''][^>]*>.*?</{_tag}>', ' ', 'g')"""
_clean = rf"trim(regexp_replace(regexp_replace(regexp_replace({_UN.format(_clean)}, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r]+', ' ', 'g'), '\s*\n\s*', E'\n', 'g'))"
_add("h_clean", lambda s, d: _kb(s, d).select("id", F.md5(H.clean_text(F.col("content"))).alias("hash")), f"select id, md5({_clean}) as hash from knowledge_base")
_HOST = r"regexp_replace(lower(nullif(regexp_extract(trim(source_url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1), '')), '^www\.', '')"
_add("h_title", lambda s, d: _kb(s, d).select("id", H.title(F.col("content"), F.col("source_url")).alias("title")))
_add("h_meta", lambda s, d: _kb(s, d).select("id", H.meta(F.col("content"), "description").alias("description"), H.charset(F.col("content")).alias("charset"), H.host(F.col("source_url")).alias("host")), rf"""select id, nullif(regexp_extract(content, '(?i)<meta\s+name=["'']description["'']\s+content=["'']([^"'']*)["'']', 1), '') as description,
nullif(lower(regexp_extract(content, '(?i)<meta[^>]+charset=["'']?([A-Za-z0-9_-]+)', 1)), '') as charset, {_HOST} as host from knowledge_base""")
_add("u_host", lambda s, d: _kb(s, d).groupBy(H.host(F.col("source_url")).alias("host")).agg(F.count("*").alias("n")), f"select {_HOST} as host, count(*) as n from knowledge_base group by 1")
_HREF = r"unnest(regexp_extract_all(content, '(?i)href=[\"'']([^\"'']+)[\"'']', 1))"
_ROOT = r"lower(regexp_extract(trim(source_url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]+)', 1)) || '://' || regexp_extract(trim(source_url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+)', 2)"
_add("h_links", lambda s, d: H.links(_pages(s, d), "id", "source_url", "content"), f"select distinct id, regexp_replace(root || l, '#.*$', '') as link from (select id, {_ROOT} as root, {_HREF} l from knowledge_base where source_url like '%://%') where l like '/%'")
_add("h_links_per_page", lambda s, d: H.links(_pages(s, d), "id", "source_url", "content").groupBy("id").agg(F.count("*").alias("links")), f"select id, count(distinct l) as links from (select id, {_HREF} l from knowledge_base where source_url like '%://%') where l like '/%' group by 1")
_BASE = "https://sual.nurqapi.example/yazi/"
_add("scope_filter", lambda s, d: _pages(s, d).select("id", H.in_scope(F.trim("source_url"), F.lit(_BASE)).alias("in_scope")), r"select id, regexp_matches(lower(trim(source_url)), '^https://sual\.nurqapi\.example/yazi(/|[?#]|$)') and not regexp_matches(lower(trim(source_url)), '\.pdf([?#]|$)') as in_scope from knowledge_base where source_url like '%://%'")
_URL = lambda i, u="trim(source_url)": rf"regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', {i})"
_SITE = rf"""with p as (select id, lower({_URL(1)}) || '://' || lower({_URL(2)}) as root, regexp_replace({_URL(3)}, '/+$', '') as path from knowledge_base where source_url like '%://%'),
o as (select *, root = 'https://sual.nurqapi.example' and not regexp_matches(lower(path), '\.({'|'.join(H.SITE_NO_PAGES)})$') and not ({' or '.join(f"contains(lower(path), '{x}')" for x in H.SITE_NO_PATHS)}) as ok, list_filter(string_split(path, '/'), lambda x: x != '') as s from p)
select id, ok and starts_with(path || '/', '/yazi/') as below, ok and (starts_with(path || '/', '/yazi/start/') or len(s) = 2 and s[1] = 'yazi' and s[2] != 'start') as beside from o"""
_add("scope_site", lambda s, d: _pages(s, d).select("id", H.in_site_scope(F.col("source_url"), F.lit(_BASE)).alias("below"), H.in_site_scope(F.col("source_url"), F.lit(f"{_BASE}start"), siblings=True).alias("beside")), _SITE)


def _crawled(s, d, depth: int = 3):  # noqa: ANN001, ANN202
    """(node, depth): addresses in scope of the base that links lead to from any page in scope, within DEPTH steps."""
    pages = _pages(s, d).select("id", "source_url", "content")
    address = H.absolute(F.trim("source_url"), F.trim("source_url"))
    links = H.links(pages, "id", "source_url", "content").where(H.in_scope(F.col("link"), F.lit(_BASE)))
    edges = links.join(pages.select("id", address.alias("src")), "id").select("src", F.col("link").alias("dst"))
    start = pages.where(H.in_scope(F.trim("source_url"), F.lit(_BASE))).select(address.alias("node"))
    return reach(write_and_read(edges, "edges"), start, depth)


_ADDRESS = r"lower(regexp_extract(trim(source_url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]+)', 1)) || '://' || regexp_extract(trim(source_url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]+)', 2)"
_IN_SCOPE = lambda u: rf"regexp_matches(lower({u}), '^https://sual\.nurqapi\.example/yazi(/|[?#]|$)') and not regexp_matches(lower({u}), '\.({'|'.join(H.NO_PAGES)})([?#]|$)')"
_LINKED = rf"""with recursive p as (select id, trim(source_url) as u, {_ADDRESS} as root, content from knowledge_base where source_url like '%://%'),
l as (select id, u, regexp_replace(root || l, '#.*$', '') as link from (select id, u, root, {_HREF} l from p) where l like '/%'),
e as (select distinct regexp_replace(u, '#.*$', '') as src, link as dst from l where {_IN_SCOPE('link')}),
r as (select regexp_replace(u, '#.*$', '') as node, 0 as depth from p where {_IN_SCOPE('u')} union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 3),
c as (select node, min(depth) as depth from r group by 1)"""
_add("crawl_pages", _crawled, _LINKED + " select node, depth from c")
# the crawl with a bound on its pages, the nearest first
_add("crawl_bfs", lambda s, d: _crawled(s, d).orderBy("depth", "node").limit(100), _LINKED + " select node, depth from c order by depth, node limit 100")

# chunks
def chunks(s, d, size: int = 1024, overlap: int = 200):  # noqa: ANN001, ANN201
    """(kb_id, chunk_index, content) of all pages."""
    return _kb(s, d).select(F.col("id").alias("kb_id"), F.explode(C.chunk_list(F.col("content"), size, overlap)).alias("c")).select("kb_id", "c.chunk_index", "c.content", "c.last")


_add("c_chunk", lambda s, d: chunks(s, d))
_add("c_chunk_documents", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(C.chunk_list(F.col("text"))).alias("c")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("c.content")).alias("characters")))
_add("c_sections", lambda s, d: _kb(s, d).select("id", F.posexplode(C.section_list(F.col("content"))).alias("pos", "content")))
_add("c_sentences", lambda s, d: table(s, d, "messages").where("content is not null").select("id", F.size(C.sentence_list(F.col("content"))).cast("bigint").alias("n")), r"select id, len(list_filter(string_split(regexp_replace(content, '([.!?\n])\s+', E'\\1\x01', 'g'), E'\x01'), lambda x: x != '')) as n from messages where content is not null")
_add("w_chunk_neighbours", lambda s, d: Q.neighbours(write_and_read(chunks(s, d, 400, 80), "chunks"), "kb_id", "chunk_index", "content").select("kb_id", "chunk_index", F.length("before").alias("chars_before"), F.length("behind").alias("chars_behind")))
_add("a_kb_count_max", lambda s, d: chunks(s, d).groupBy("kb_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"), F.round(F.avg(F.length("content")), 3).alias("avg_chars")))

# vectors
_COS = "list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[]))"
_vec = lambda s, d: table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
_ask = lambda s, d: table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))
_HITS = f"""with s as (select q.vec_id as question_id, v.vec_id, v.label, round({_COS}, 9) as score from embeddings q, embeddings v where q.vec_id % 100 = 0),
h as (select question_id, vec_id, label, score, row_number() over (partition by question_id order by score desc, vec_id) as rank from s qualify rank <= 10)"""
_hits = lambda s, d: Q.top_k(_ask(s, d), _vec(s, d), 10).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
_add("r_topk", lambda s, d: _hits(s, d).select("question_id", "vec_id", F.round("score", 6).alias("score"), "rank"), _HITS + " select question_id, vec_id, round(score, 6) as score, rank from h")
_add("v_cosine", lambda s, d: table(s, d, "embeddings").alias("a").join(table(s, d, "embeddings").withColumn("vec_id", F.col("vec_id") - 1).alias("b"), "vec_id").select("vec_id", F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine")), f"select q.vec_id, round({_COS}, 6) as cosine from embeddings q join embeddings v on v.vec_id = q.vec_id + 1")
_add("v_hash_embed", lambda s, d: table(s, d, "chat_feedback").select("id", V.hash_embedding(F.col("message_content")).alias("e")).select("id", F.round(V.norm(F.col("e")), 6).alias("norm"), F.size(F.filter("e", lambda x: x > 0)).alias("slots")))
_BYTE = "cast(('0x' || {}) as integer)"
_DIGEST = f"""with t as (select id, [sha256(message_content), md5(message_content), sha1(message_content)] as d, coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(message_content)), '..'), lambda x: {_BYTE.format('x')})), 0) as b, strlen(message_content) as n from chat_feedback),
v as (select id, list_transform(range(1536), lambda i: case when i % 64 * 2 < length(d[i // 512 + 1]) then {_BYTE.format('substring(d[i // 512 + 1], cast(i % 64 * 2 + 1 as bigint), 2)')} / 255.0 * 2 - 1 else sin(i * 0.1 + b * 0.001) * cos(n * 0.1) end) as e from t),
l as (select id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as length from v)"""
_add(
    "v_hash_embed_1536",
    lambda s, d: table(s, d, "chat_feedback").select("id", V.digest_embedding(F.col("message_content")).alias("e")).select("id", *[F.round(F.get("e", F.lit(i)), 6).alias(f"e{i}") for i in (0, 40, 600, 1100, 1535)]),
    _DIGEST + " select id, " + ", ".join(f"round(e[{i + 1}] / length, 6) as e{i}" for i in (0, 40, 600, 1100, 1535)) + " from l",
)
_add("r_min_score", lambda s, d: R.keep_if_any(_hits(s, d), F.col("score") >= 0.99999, ["question_id"]).select("question_id", "vec_id"), _HITS + ", k as (select *, max(score >= 0.99999) over (partition by question_id) as any_ok from h) select question_id, vec_id from k where score >= 0.99999 or not any_ok")
_add("r_restrict_kb", lambda s, d: R.keep_if_any(_hits(s, d), F.col("label") == 3, ["question_id"]).select("question_id", "vec_id"), _HITS + ", k as (select *, max(label = 3) over (partition by question_id) as any_ok from h) select question_id, vec_id from k where label = 3 or not any_ok")
_add("a_kb_score_sum", lambda s, d: Q.dominant(_hits(s, d), of="label", top=2).select("question_id", "label", F.round("total", 5).alias("total")), _HITS + ", t as (select question_id, label, round(sum(score), 9) as total from h group by 1, 2) select question_id, label, round(total, 5) as total from t qualify row_number() over (partition by question_id order by t.total desc, label) <= 2")
_add("a_used_indices", lambda s, d: _hits(s, d).groupBy("question_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_set("vec_id")), lambda x: x.cast("string")), ",").alias("ids")), _HITS + " select question_id, label, string_agg(vec_id, ',' order by vec_id) as ids from h group by 1, 2")
_add("w_first_source", lambda s, d: _hits(s, d).groupBy("question_id", "label").agg(F.min_by("vec_id", "rank").alias("vec_id")), _HITS + " select question_id, label, arg_min(vec_id, rank) as vec_id from h group by 1, 2")
_add("a_avg_score", lambda s, d: _hits(s, d).groupBy("question_id").agg(F.round(F.avg("score"), 5).alias("avg_score")), _HITS + " select question_id, round(avg(score), 5) as avg_score from h group by 1")
_add("vector_upsert", lambda s, d: R.upsert(_vec(s, d).where("vec_id % 5 != 0").select("vec_id", "label"), _vec(s, d).where("vec_id % 10 < 3").select("vec_id", (F.col("label") + 100).alias("label")), ["vec_id"]), "select vec_id, label + 100 as label from embeddings where vec_id % 10 < 3 union all select vec_id, label from embeddings where vec_id % 5 != 0 and vec_id % 10 >= 3")
_add("vector_delete", lambda s, d: R.delete_matching(_vec(s, d).select("vec_id", "label"), "label = 3"), "select vec_id, label from embeddings where label != 3")
_add(
    "r_qa_best",
    lambda s, d: Q.top_k(_ask(s, d), _vec(s, d).where("label = 1"), 1).where("score >= 0.1").select("question_id", "vec_id"),
    _HITS.split(",\nh as")[0] + " select question_id, vec_id from (select *, row_number() over (partition by question_id order by score desc, vec_id) n from s where label = 1) where n = 1 and score >= 0.1",
)

# retrieval over texts
_add("r_like_fallback", lambda s, d: _kb(s, d).where(F.exists(F.array(F.lit("zəkat"), F.lit("fitrə")), lambda k: F.lower("content").contains(k))).orderBy("id").limit(5).select("id", "title"), "select id, title from knowledge_base where contains(lower(content), 'zəkat') or contains(lower(content), 'fitrə') order by id limit 5")
_add("r_hosts", lambda s, d: _kb(s, d).where(H.host(F.col("source_url")).isin("sual.nurqapi.example", "voprosnik.invalid")).select("id"), f"select id from knowledge_base where {_HOST} in ('sual.nurqapi.example', 'voprosnik.invalid')")
# over every session, the hot one too: no task holds a session whole
_said = lambda s, d: table(s, d, "messages").where("chat_session_id is not null and content is not null").distinct()
_SAID = "(select distinct * from messages where chat_session_id is not null and content is not null)"
_add("r_context_pieces", lambda s, d: Q.context_pieces(_said(s, d), "chat_session_id", "id", "content").select("chat_session_id", "piece", F.md5("context").alias("hash")), rf"select chat_session_id, id // {Q.PIECE} as piece, md5(string_agg(content, E'\n\n---\n\n' order by id)) as hash from {_SAID} group by 1, 2")
_add("w_running_budget", lambda s, d: R.within_budget(_said(s, d), ["chat_session_id"], ["created_at", "id"], F.length("content") + 1, 200, block=F.to_date("created_at")).select("id"), f"select id from (select id, sum(length(content) + 1) over (partition by chat_session_id order by created_at, id rows between unbounded preceding and 1 preceding) b from {_SAID}) where coalesce(b, 0) < 200")
_add("w_greedy_budget", lambda s, d: R.within_budget(_said(s, d), ["chat_session_id"], [F.desc(F.length("content")), "id"], F.length("content"), 300, crossing=False, block=F.struct(-F.length("content"), F.expr(f"id div {Q.PIECE}"))).select("id"), f"select id from (select id, sum(length(content)) over (partition by chat_session_id order by length(content) desc, id rows unbounded preceding) u from {_SAID}) where u <= 300")
_WEIGHTS = {"namaz": 8, "oruc": 3, "dua": 2}
_add("r_wide", lambda s, d: Q.wide_extract(write_and_read(chunks(s, d, 400, 80), "chunks"), "kb_id", "chunk_index", "content", _WEIGHTS, 4, 1200).select("kb_id", F.length("extract").alias("chars"), F.md5("extract").alias("hash")))
_add("r_intro", lambda s, d: Q.context(R.within_budget(write_and_read(chunks(s, d, 400, 80), "chunks"), ["kb_id"], ["chunk_index"], F.length("content") + 1, 1400), "kb_id", "chunk_index", "content", "\n").select("kb_id", F.md5(trim_to_sentence(F.col("context"), 1400)).alias("hash")))


def _asked(s, d):  # noqa: ANN001, ANN202
    """The stated queries: the words of the titles of the pages whose id is divisible by 100."""
    words = F.regexp_extract_all(Q.search_form(F.col("title")), F.lit(r"\p{L}{3,}"), F.lit(0))
    return _kb(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.explode(words).alias("term"))


_FORM = "replace(replace(replace(replace(lower(translate({c}, 'əƏıİşŞçÇöÖüÜğĞ', 'eeiissccoouugg')), 'وضوء', 'wudu'), 'صلاة', 'salat'), 'صوم', 'sawm'), 'زكاة', 'zakat')"
_WORDS = lambda c: rf"regexp_extract_all(regexp_replace({_FORM.format(c=c)}, '\p{{Mn}}+', '', 'g'), '\p{{L}}{{3,}}')"
_add(
    "l_fulltext",
    lambda s, d: Q.full_text(Q.inverted_index(_kb(s, d).select("id", "content").distinct(), "id", "content"), _kb(s, d).agg(F.countDistinct("id").alias("n_docs")), _asked(s, d), "id", 5).select("query_id", "id", F.round("score", 4).alias("score"), "rank"),
    f"""with i as (select term, id, count(*) tf from (select id, unnest({_WORDS('content')}) term from (select distinct id, content from knowledge_base)) group by 1, 2),
    a as (select distinct id as query_id, unnest({_WORDS('title')}) term from knowledge_base where id % 100 = 0), n as (select count(distinct id) n from knowledge_base),
    f as (select term, log10(n / count(*)) idf from i, n where term in (select term from a) group by term, n),
    s as (select query_id, id, round(sum(tf * idf * idf), 6) score from a join i using (term) join f using (term) group by 1, 2)
    select query_id, id, round(score, 4) as score, row_number() over (partition by query_id order by s.score desc, id) as rank from s qualify rank <= 5""",
)
_add(
    "r_context",
    lambda s, d: Q.context(QUERIES["l_fulltext"](s, d).join(_kb(s, d).select("id", F.col("content").alias("said")).distinct(), "id").select("query_id", "rank", "said"), "query_id", "rank", "said").select("query_id", F.md5("context").alias("hash")),
    rf"with h as ({ORACLE['l_fulltext']}) select query_id, md5(string_agg(content, E'\n\n---\n\n' order by rank)) as hash from h join (select distinct id, content from knowledge_base) k on k.id = h.id group by 1",
)
_TIERS = {1: "contains(lower(title), 'zəkat') and source_url like 'http%'", 2: "contains(lower(title), 'zəkat') or contains(lower(content), 'zəkat niyyəti')", 3: "true"}
_add(
    "l_url_tiers",
    lambda s, d: R.first_nonempty([_kb(s, d).where(c).select("id", "title").orderBy("id").limit(3) for c in _TIERS.values()]),
    "with t as (" + " union all ".join(f"select * from (select id, title, {k} as tier from knowledge_base where {c} order by id limit 3)" for k, c in _TIERS.items()) + ") select * from t where tier = (select min(tier) from t)",
)
