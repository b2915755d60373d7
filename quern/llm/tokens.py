"""Problem 6: encoding of the whole corpus with a public byte-level tokenizer, inside the JVM.

Texts are cut into words by the tokenizer's pattern. Each distinct word is encoded once: its bytes, as two hexadecimal digits each, are
an array; a fold merges, step by step, the neighbours whose joint has the lowest rank. The ranks are a literal in the plan: an
array of small maps, addressed by a checksum of the token, since a single large map would be searched from its start.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.let import let
from quern.operators.skew import hot_keys, merge_join
from quern.sources import table, write_and_read

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BUCKETS = 4096
#: Most distinct words whose encoding is broadcast (about 100 bytes each); beyond it the words are joined by merging.
BROADCAST_WORDS = 400_000
#: The pattern of byte_bpe_50k; (?U) makes white space that of Unicode.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank (the token's id) of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


@functools.cache
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks(path).items():
        key = token.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return json.dumps(buckets, separators=(",", ":"))


def rank_map(path: str) -> Column:
    """The literal rank map: an array of maps, the place of a token by its checksum."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def rank_of(token: Column, buckets: Column) -> Column:
    """The rank of a token given by its hexadecimal digits; null if it is none."""
    return F.try_element_at(F.get(buckets, (F.crc32(token.cast("binary")) % BUCKETS).cast("int")), token)


def words_of(text: Column) -> Column:
    """The words of a text by the pattern; none for null and empty texts. Nothing of the text is lost between them."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def merge_bytes(word: Column, buckets: Column) -> Column:
    """The tokens (hexadecimal digits) of a word by ranked merges.

    The state of the fold holds the tokens and the rank of each neighbouring pair; a step joins the leftmost pair of the lowest rank and
    looks up only the two pairs that the joint makes. A word of n bytes takes at most n - 1 steps; steps without a pair change nothing.
    """
    digits = F.hex(F.encode(word, "UTF-8"))
    start = F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")), lambda i: F.substring(digits, i * 2 - 1, F.lit(2)))
    n = F.size(start)
    none = F.lit(None).cast("int")

    def pairs(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: rank_of(F.concat(F.get(t, i), F.get(t, i + 1)), buckets))

    def step(acc: Column, _: Column) -> Column:
        t, r = acc["t"], acc["r"]
        i = F.array_position(r, F.array_min(r)).cast("int")  # the pair of the tokens i and i + 1, from 1
        joint = F.concat(F.get(t, i - 1), F.get(t, i))
        left = F.when(i > 1, F.array(rank_of(F.concat(F.get(t, i - 2), joint), buckets))).otherwise(F.array().cast("array<int>"))
        right = F.when(i < F.size(r), F.array(rank_of(F.concat(joint, F.get(t, i + 1)), buckets))).otherwise(F.array().cast("array<int>"))
        merged = F.struct(
            F.concat(F.slice(t, F.lit(1), i - 1), F.array(joint), F.slice(t, i + 2, F.size(t))).alias("t"),
            F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(r))).alias("r"),
        )
        return F.when(F.array_min(r).isNull(), acc).otherwise(merged)

    zero = F.struct(start.alias("t"), pairs(start).alias("r"))
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(2), n), zero, step, lambda acc: acc["t"])).otherwise(F.when(n == 1, start).otherwise(F.array(none.cast("string"))))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word) -> (word, ids): a word that is a token by itself, else its merged bytes. The rank map stands in the plan once."""

    def ids(buckets: Column) -> Column:
        whole = rank_of(F.hex(F.encode("word", "UTF-8")), buckets)
        split = F.transform(merge_bytes(F.col("word"), buckets), lambda t: rank_of(t, buckets))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(split)

    return words.select("word", let(rank_map(path), ids).alias("ids"))


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.posexplode(words_of(F.col(text))).alias("pos", "word"))


def word_table(docs: DataFrame, text: str = "text", path: str | None = None) -> tuple[DataFrame, int]:
    """The encoding of every distinct word of the corpus, written to the shared folder, and the number of words."""
    distinct = docs.select(F.explode(words_of(F.col(text))).alias("word")).distinct()
    # the words are few bytes but much work: a fixed number of parts, which adaptive execution doesn't put together by their bytes
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    encoded = write_and_read(encode_words(distinct.repartition(tasks, "word"), path or vocabulary()), "words")
    return encoded, encoded.count()


def _joined(docs: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """(_key, pos, ids) of every word of every document."""
    encoded, n = word_table(docs, text, path)
    if n <= BROADCAST_WORDS:  # the texts are shuffled once, by their key; the words of a document stay in its task
        words = _words(docs.select(key, text).repartition(key), key, text)
        return words.join(F.broadcast(encoded), "word").select("_key", "pos", "ids")
    words = _words(docs, key, text)
    return merge_join(words, encoded, "word", "pos", hot_keys(words, "word", 200_000), "inner").select("_key", "pos", "ids")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(KEY, ids) of every document: its token ids in order; an empty list for null and empty texts.

    Documents that share a key (null included) come out once, with their texts' ids in no defined order; keys are meant to be unique.
    Texts may be of any length. Extra columns are not looked at.
    """
    parts = _joined(docs, key, text, path).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("w"))
    ids = parts.select(F.col("_key").alias(key), F.flatten("w.ids").alias("ids"))
    empty = docs.where(F.col(text).isNull() | (F.col(text) == "")).select(key, F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(empty)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(KEY, n_tokens) of every document, 0 for null and empty texts."""
    encoded, n = word_table(docs, text, path)
    sizes = encoded.select("word", F.size("ids").alias("n"))
    words = docs.select(F.col(key), F.explode(words_of(F.col(text))).alias("word"))
    joined = words.join(F.broadcast(sizes), "word") if n <= BROADCAST_WORDS else merge_join(words, sizes, "word", key, hot_keys(words, "word", 200_000), "inner")
    empty = docs.where(F.col(text).isNull() | (F.col(text) == "")).select(key, F.lit(0).cast("bigint").alias("n_tokens"))
    return joined.groupBy(key).agg(F.sum("n").alias("n_tokens")).unionByName(empty)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(KEY, text): the binary pieces of the ids, concatenated and read as UTF-8. An empty list gives an empty text, null gives null."""
    tokens = ranks(path or vocabulary())
    pieces = [""] * (max(tokens.values()) + 1)
    for t, r in tokens.items():
        pieces[r] = t.hex().upper()
    literal = F.split(F.lit(",".join(pieces)), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(literal, i)), "")), "UTF-8")
    return encoded.select(key, text.alias("text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
ORACLE: dict[str, str] = {}
