"""Retrieval over vectors, chunks and words: many questions at once, each step a lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import search_form
from quern.functions.vectors import dot, unit
from quern.sources import write_and_read

#: Questions that are broadcast against all vectors at once, about; more go in several blocks.
QUESTIONS = 1000
#: Most keys in one piece of a context.
PIECE = 1000


def top_k(questions: DataFrame, vectors: DataFrame, k: int, question: str = "question_id", key: str = "vec_id") -> DataFrame:
    """(QUESTION, KEY, score, rank): the K most similar vectors of each question, by exact cosine; the smaller key wins ties.

    QUESTIONS (question, q) are divided by their hash into blocks of about QUESTIONS vectors; one block after the other is broadcast; VECTORS (KEY, v)
    stay where they are. Each task keeps the best K of every question before anything is shuffled (the window's group limit), so what moves is K rows per question and task.
    """
    blocks = max(1, -(-questions.count() // QUESTIONS))
    if blocks == 1:
        return _top_k(questions, vectors, k, question, key)
    out = None
    for i in range(blocks):
        best = _top_k(questions.where(F.pmod(F.xxhash64(question), F.lit(blocks)) == i), vectors, k, question, key)
        best = write_and_read(best, f"top{i}")
        out = best if out is None else out.unionByName(best)
    return out


def _top_k(questions: DataFrame, vectors: DataFrame, k: int, question: str, key: str) -> DataFrame:
    one = lambda c: unit(F.col(c)).alias(c)  # noqa: E731  both sides have length 1 before they meet, so a score is one product
    scored = vectors.select(key, one("v")).join(F.broadcast(questions.select(question, one("q"))), F.lit(True)).select(question, key, F.round(dot(F.col("q"), F.col("v")), 9).alias("score"))
    w = Window.partitionBy(question).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def dominant(hits: DataFrame, group: str = "question_id", of: str = "kb_id", top: int = 1) -> DataFrame:
    """(group, of, total): the TOP groups of hits by the sum of their scores."""
    sums = hits.groupBy(group, of).agg(F.round(F.sum("score"), 9).alias("total"))
    w = Window.partitionBy(group).orderBy(F.desc("total"), of)
    return sums.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def context(rows: DataFrame, group: str, order: str, text: str, between: str = "\n\n---\n\n") -> DataFrame:
    """(group, context): the texts of each group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), between).alias("context"))


def context_pieces(rows: DataFrame, group: str, order: str, text: str, piece: int = PIECE) -> DataFrame:
    """(group, piece, context): context() in pieces of PIECE keys each, which follow each other by their number; no group is collected whole."""
    cut = rows.withColumn("piece", F.expr(f"{order} div {piece}")).withColumn("_g", F.struct(group, "piece"))
    return context(cut, "_g", order, text).select(f"_g.{group}", "_g.piece", "context")


def neighbours(chunks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """CHUNKS with the text before and behind each in its document (before, behind)."""
    w = Window.partitionBy(document).orderBy(order)
    return chunks.withColumn("before", F.lag(text).over(w)).withColumn("behind", F.lead(text).over(w))


def term_score(text: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of the terms that the text holds."""
    out = F.lit(0)
    for term, weight in weights.items():
        out = out + F.when(text.contains(term), F.lit(weight)).otherwise(F.lit(0))
    return out


def wide_extract(chunks: DataFrame, document: str, order: str, text: str, weights: dict[str, int], most: int, budget: int) -> DataFrame:
    """(document, extract): each document's MOST best chunks by term weights, back in their order, until the budget of characters is passed."""
    scored = chunks.withColumn("_s", term_score(F.lower(text), weights))
    best = Window.partitionBy(document).orderBy(F.desc("_s"), order)
    kept = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    before = F.sum(F.length(text) + 1).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < budget)
    return context(kept, document, order, text, "\n").withColumnRenamed("context", "extract")


def inverted_index(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(term, KEY, tf) of every word of LEAST letters and more."""
    words = F.regexp_extract_all(search_form(F.col(text)), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(words).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def full_text(index: DataFrame, n_docs: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, KEY, score, rank): documents by the sum of tf * idf * idf over the words of a query, idf = log10(documents / documents with the word).

    QUERIES (query_id, term) restrict the index before it is scored, so only postings of asked words are shuffled.
    """
    asked = queries.where("term is not null").distinct()
    postings = index.join(asked.select("term"), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n_docs), F.lit(True)).select("term", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))
    hits = postings.join(asked, "term").join(idf, "term")
    scores = hits.groupBy("query_id", key).agg(F.round(F.sum(F.col("tf") * F.col("idf") * F.col("idf")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
