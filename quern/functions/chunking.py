"""Cutting texts into overlapping chunks, as a fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.let import let

#: Chunks of at most so many characters are left out, unless the text is one chunk.
LEAST_CHARS = 50
# What ends a sentence inside a chunk. The last three hold a backslash and an n, not a line end.
ENDS = [". ", "? ", "! ", r".\n", r"?\n", r"!\n"]


def normalize(c: Column) -> Column:
    """White space runs as one space, no control characters, trimmed."""
    t = F.regexp_replace(c, r"\s{2,}", " ")
    return _trim(F.regexp_replace(t, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", ""))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, "^[ \t\n\r\u0000\u000b]+|[ \t\n\r\u0000\u000b]+$", "")


def _last(part: Column, s: Column) -> Column:
    """The place of the last S in PART, from 0; -1 if there is none."""
    at = F.call_function("locate", F.reverse(s), F.reverse(part))
    return F.when(at > 0, F.length(part) - at - F.length(s) + 1).otherwise(F.lit(-1))


def _broken(chunk: Column) -> Column:
    """The chunk up to a sentence end in its last fifth, else up to a space behind 70 %, else whole."""
    n = F.length(chunk)
    start = F.floor(n * F.lit(0.8)).cast("int")
    ends = F.array(*map(F.lit, ENDS))

    def later(part: Column) -> Column:
        return F.aggregate(ends, F.lit(-1), lambda end, s: let(_last(part, s), lambda p: F.when(p > end, p + F.length(s)).otherwise(end)))

    space = _last(chunk, F.lit(" "))
    end = let(F.substring(chunk, start + 1, n), later)
    pick = lambda e: F.when(e > 0, F.substring(chunk, F.lit(1), start + e)).when(space > n * 0.7, F.substring(chunk, F.lit(1), space)).otherwise(chunk)
    return let(end, pick)


def chunk_list(c: Column, size: int = 1024, overlap: int = 200) -> Column:
    """array<struct<chunk_index, content, is_tail>>; chunk_index is the place before short chunks are left out, so it may have gaps.

    A text of at most SIZE characters is one chunk, even if empty; null gives null. Each chunk starts OVERLAP characters before the end of the
    one before it. The fold keeps the next start and the chunks so far; steps after the end of the text change nothing.
    """
    if overlap >= size:
        overlap = max(0, size // 4)
    return let(normalize(c), lambda t: _chunks(t, size, overlap))


def _chunks(t: Column, size: int, overlap: int) -> Column:
    n = F.length(t)
    least = max(1, min(int(size * 0.7) - overlap, int(size * 0.75)))
    steps = F.sequence(F.lit(0), F.floor(n / least).cast("int") + 1)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        raw = F.substring(t, at + 1, F.lit(size))

        def grown(cut: Column) -> Column:
            ahead = F.when(F.length(cut) - overlap < 1, F.lit(max(1, int(size * 0.75)))).otherwise(F.length(cut) - overlap)
            more = F.when(cut != "", F.array(F.struct(F.size(acc["out"]).alias("chunk_index"), cut.alias("content"), (at + size >= n).alias("last"))))
            return F.struct((at + ahead).cast("int").alias("at"), F.concat(acc["out"], F.coalesce(more, F.array().cast(_CHUNKS))).alias("out"))

        cut = let(raw, lambda x: _trim(F.when(at + size < n, _broken(x)).otherwise(x)))
        return F.when(at < n, let(cut, grown)).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_CHUNKS).alias("out"))
    many = F.filter(F.aggregate(steps, zero, step, lambda a: a["out"]), lambda x: F.length(x["content"]) > LEAST_CHARS)
    one = F.array(F.struct(F.lit(0).alias("chunk_index"), t.alias("content"), F.lit(True).alias("last"))).cast(_CHUNKS)
    return F.when(n <= size, one).otherwise(many)


_CHUNKS = "array<struct<chunk_index: int, content: string, last: boolean>>"


def section_list(c: Column, size: int = 1500) -> Column:
    """array<string>: paragraphs packed in order into pieces of at most SIZE characters; a longer paragraph is chunked by itself."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), _trim), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        now, out = acc["now"], acc["out"]
        flushed = F.when(now != "", F.concat(out, F.array(now))).otherwise(out)
        joined = F.when(now != "", F.concat(now, F.lit("\n\n"), p)).otherwise(p)
        big = F.struct(F.lit("").alias("now"), F.concat(flushed, F.transform(chunk_list(p, size, 100), lambda x: x["content"])).alias("out"))
        fits = F.length(now) + F.length(p) + 2 <= size
        return F.when(F.length(p) > size, big).when(fits, F.struct(joined.alias("now"), out.alias("out"))).otherwise(F.struct(p.alias("now"), flushed.alias("out")))

    done = lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"])
    zero = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    return F.filter(F.aggregate(paragraphs, zero, step, done), lambda x: F.length(_trim(x)) > LEAST_CHARS)


def sentence_list(c: Column) -> Column:
    """Sentences, cut behind . ! ? or a line end that white space follows."""
    return F.filter(F.split(c, r"(?<=[.!?\n])\s+"), lambda s: s != "")
