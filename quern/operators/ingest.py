"""Entries into an index and answers out of it: re-indexing as one dataflow, answers made of sentences, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.chunking import chunk_list, sentence_list
from quern.functions.text import ends_sentence, fold, jaccard, shingles, trim_to_sentence
from quern.functions.vectors import hash_embedding
from quern.operators.retrieval import context, neighbours
from quern.operators.skew import hot_keys, merge_join
from quern.sources import write_and_read

# What a sentence begins with.
CLEAN_START = r"^(Məsələ\s*\d+|[A-ZƏIŞÇÖÜĞ])"


def reindex(entries: DataFrame, index: DataFrame, size: int = 1024, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(status, index) after ENTRIES (id, content) are chunked and embedded anew and take the place of their old rows in INDEX.

    index: (kb_id, chunk_index, content, char_count, vector_id, vector). status: (id, indexing_status, chunks_count): completed, or failed for an
    entry without a chunk (a null content), whose old rows are out all the same. The new rows are written before anything reads them.
    """
    cut = entries.select(F.col("id").alias("kb_id"), F.explode(chunk_list(F.col("content"), size, overlap)).alias("c"))
    rows = cut.select("kb_id", F.col("c.chunk_index").alias("chunk_index"), F.col("c.content").alias("content"), F.length("c.content").alias("char_count"))
    rows = rows.withColumn("vector_id", F.format_string("kb_%d_chunk_%d", "kb_id", "chunk_index")).withColumn("vector", hash_embedding(F.col("content")))
    new = write_and_read(rows, "index")
    counts = new.groupBy(F.col("kb_id").alias("id")).agg(F.count("*").alias("chunks_count"))
    status = entries.select("id").distinct().join(counts, "id", "left").select(
        "id", F.when(F.col("chunks_count").isNotNull(), "completed").otherwise("failed").alias("indexing_status"), F.coalesce("chunks_count", F.lit(0)).alias("chunks_count")
    )
    kept = index.join(entries.select(F.col("id").alias("kb_id")).distinct(), "kb_id", "left_anti")
    return status, kept.unionByName(new)


def completed_ends(content: Column, before: Column, behind: Column, prepend: int = 500, append: int = 800) -> Column:
    """A chunk whose begin and end are completed from its neighbours, up to the nearest ends of sentences."""
    t = F.trim(content)
    tail = F.concat(F.substring(F.trim(before), -prepend, prepend), F.lit(" "))
    cut = F.length(F.regexp_extract(tail, r"(?s)^.+[.!?…\n]", 0))
    start = F.when(t.rlike(CLEAN_START) | before.isNull() | (before == "") | (t == ""), t).otherwise(F.ltrim(F.substring(F.concat(tail, t), cut + 1, F.length(tail) + F.length(t))))
    both = F.concat(F.rtrim(start), F.lit(" "), F.substring(behind, 1, append))
    return F.when(ends_sentence(start) | behind.isNull() | (behind == ""), start).otherwise(trim_to_sentence(both, 1_000_000_000))


def extractive(questions: DataFrame, hits: DataFrame, chunks: DataFrame, most: int = 3200) -> DataFrame:
    """(query_id, answer): for each question the sentences of its hits that hold one of its words, in order, each once, up to MOST characters.

    QUESTIONS (query_id, words), HITS (query_id, kb_id, rank), CHUNKS (kb_id, chunk_index, content). The sentence that passes MOST is cut at a sentence end
    if over 200 characters are left for it, and ends the answer. A question without such sentences gets the begin of its first two chunks. A question
    without hits has no row.
    """
    near = neighbours(chunks, "kb_id", "chunk_index", "content")
    full = hits.join(near, "kb_id").select("query_id", "rank", "chunk_index", "kb_id", completed_ends(F.col("content"), F.col("before"), F.col("behind")).alias("full"))
    cut = full.select("query_id", "rank", "chunk_index", F.posexplode(sentence_list(F.col("full"))).alias("pos", "s"))
    said = F.when(ends_sentence(F.trim("s")), F.trim("s")).otherwise(trim_to_sentence(F.trim("s"), 1000))
    cut = cut.withColumn("s", said).where(F.col("s").rlike(CLEAN_START))
    low = F.lower(fold(F.col("s")))
    found = cut.join(questions.where(F.size("words") > 0), "query_id").where(F.exists("words", lambda w: (w != "") & low.contains(F.lower(fold(w)))))
    place = F.struct("rank", "chunk_index", "pos")
    once = found.groupBy("query_id", "s").agg(F.min(place).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    ahead = F.coalesce(F.sum(F.length("s") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)) - 1, F.lit(0))
    run = once.withColumn("used", ahead).withColumn("over", F.col("used") + F.length("s") > most)
    run = run.withColumn("overs", F.sum(F.col("over").cast("int")).over(w)).where("overs = 0 or (overs = 1 and over)")
    left = F.lit(most) - F.col("used") - 1
    last = F.when(left > 200, F.regexp_replace(F.regexp_extract(F.substring(F.col("s"), F.lit(1), left.cast("int")), r"(?s)^(.+[.!?…\n])", 1), r"\s+$", ""))
    kept = run.withColumn("s", F.when(F.col("over"), last).otherwise(F.col("s"))).where("s is not null and s != ''")
    answers = context(kept, "query_id", "at", "s", "\n\n").withColumnRenamed("context", "answer")
    first = Window.partitionBy("query_id").orderBy("rank", "chunk_index")
    begin = full.join(answers.select("query_id"), "query_id", "left_anti").withColumn("n", F.row_number().over(first)).where("n <= 2")
    begin = context(begin.withColumn("t", trim_to_sentence(F.col("full"), min(1200, most))), "query_id", "n", "t", "\n\n").withColumnRenamed("context", "answer")
    return answers.unionByName(begin)


def ordered_by_choice(df: DataFrame, choice: str, allowed: Sequence[str], default: str, key: str, descending: bool = True) -> DataFrame:
    """DF in the order of the column CHOICE if that is one of ALLOWED, else of DEFAULT; KEY breaks ties."""
    by = F.col(choice if choice in allowed else default)
    return df.orderBy(by.desc() if descending else by.asc(), F.col(key).desc() if descending else F.col(key).asc())


def last_errors(lines: DataFrame, order: Sequence[str], line: str, tail: int = 50, most: int = 5) -> DataFrame:
    """(at, LINE): of the last TAIL log lines by ORDER those with ERROR, the newest MOST of them; at is the time in brackets at the start of a line."""
    end = lines.orderBy(*[F.desc(c) for c in order]).limit(tail)
    found = end.where(F.col(line).contains("ERROR")).orderBy(*[F.desc(c) for c in order]).limit(most)
    return found.select(F.regexp_extract(line, r"^\[([^\]]+)\]", 1).alias("at"), F.col(line))


def similar_entries(entries: DataFrame, key: str = "id", title: str = "title", text: str = "content", least: float = 0.8, prefix: int = 50) -> DataFrame:
    """(KEY, first, similarity): entries whose text is similar to that of the first entry (by KEY) whose title begins with the same PREFIX characters.

    Similarity is that of the sets of five-word runs, at least LEAST. Each entry meets one other only, so groups of any size are worked
    on in linear time; titles that very many entries share are divided into parts. Null titles and texts are similar to nothing.
    """
    rows = entries.where(F.col(title).isNotNull() & F.col(text).isNotNull()).select(key, F.substring(title, 1, prefix).alias("_p"), F.col(text).alias("_t"))
    first = rows.groupBy("_p").agg(F.min_by(F.struct(F.col(key).alias("first"), F.col("_t").alias("_f")), F.struct(key, "_t")).alias("_r"), F.count("*").alias("_n")).where("_n > 1").select("_p", "_r.first", "_r._f")
    pairs = merge_join(rows, first, "_p", key, hot_keys(rows, "_p"), "inner").where(F.col(key) != F.col("first"))
    return pairs.select(key, "first", jaccard(shingles(F.col("_t")), shingles(F.col("_f"))).alias("similarity")).where(F.col("similarity") >= least)
