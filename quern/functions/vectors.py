"""Vectors as arrays: similarity and a hashed bag of words, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.let import let


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; all zeros for one of length zero. Meant for vectors of one length."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """The cosine over the shorter length; 0 for empty vectors and vectors of length zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    both = norm(x) * norm(y)
    return F.when((n > 0) & (both > 0), dot(x, y) / both).otherwise(F.lit(0.0))


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Counts of the words of TEXT by CRC-32 modulo DIM, scaled to length 1 (all zeros for no words)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(dim)).cast("int"))
    counts = let(slots, lambda x: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(x, lambda s: s == i)).cast("double")))
    return let(counts, lambda v: let(norm(v), lambda length: F.transform(v, lambda x: x / F.when(length > 0, length).otherwise(F.lit(1.0)))))


def digest_embedding(text: Column, dim: int = 1536) -> Column:
    """A vector that depends on the digests of TEXT only, for when no model can be reached, scaled to length 1; null for null.

    Each 512 places take the bytes of SHA-256, MD5 and SHA-1 in turn, as numbers from -1 to 1, again after 64 places; where a digest
    has no more, a wave of the place, the sum of the text's bytes and their number stands in. It says nothing about how alike texts are.
    """
    number = lambda x: F.conv(x, 16, 10).cast("double")
    total = F.aggregate(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), F.lit(0.0), lambda s, x: s + number(x))
    known = F.struct(F.array(F.sha2(text, 256), F.md5(text), F.sha1(text)).alias("d"), F.sin(total * 0.001).alias("s"), F.cos(total * 0.001).alias("c"), F.cos(F.octet_length(text) * 0.1).alias("k"))

    def place(i: Column, x: Column) -> Column:
        digest, at = F.get(x["d"], F.floor(i / 512).cast("int")), (i % 64) * 2
        wave = (F.sin(i * 0.1) * x["c"] + F.cos(i * 0.1) * x["s"]) * x["k"]
        return F.when(at < F.length(digest), number(F.substring(digest, at + 1, F.lit(2))) / 255.0 * 2 - 1).otherwise(wave)

    raw = let(known, lambda x: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: place(i, x)))
    return F.when(text.isNotNull(), let(raw, unit))
