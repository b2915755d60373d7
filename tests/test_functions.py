import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import chunking as C
from quern.functions import text as T
from quern.functions import vectors as V
from quern.functions import web as H


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column).collect()[0][0]


def slow_chunks(text, size, overlap):
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(r"[ \t\n\r\x0b\x0c]{2,}", " ", text[:500_000])).strip(" \t\n\r\0\x0b")
    if len(t) <= size:
        return [(0, t)]
    if overlap >= size:
        overlap = max(0, size // 4)
    out, at = [], 0
    while at < len(t):
        c = t[at : at + size]
        if at + size < len(t):
            s = int(len(c) * 0.8)
            part, end = c[s:], -1
            for e in (". ", "? ", "! ", ".\\n", "?\\n", "!\\n"):
                if part.rfind(e) > end:
                    end = part.rfind(e) + len(e)
            sp = c.rfind(" ")
            c = c[: s + end] if end > 0 else c[:sp] if sp > len(c) * 0.7 else c
        c = c.strip(" \t\n\r\0\x0b")
        if c:
            out.append(c)
        step = len(c) - overlap
        at += step if step >= 1 else max(1, int(size * 0.75))
    return [(i, c) for i, c in enumerate(out) if len(c.strip()) > 50]


@pytest.mark.parametrize("size,overlap", [(120, 20), (300, 60), (100, 0), (200, 200)])
def test_chunks_match_brute_force(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", "short", "x" * 350, "a. " * 300, "no\\n end?\\n " * 40]
    texts += ["".join(rng.choice(["word ", "söz. ", "Nə? ", "\n\n", "ə", "longer-word ", "! ", "  "]) for _ in range(rng.randint(5, 400))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [(c.chunk_index, c.content) for c in r.c] for r in df.select("id", C.chunk_list(F.col("t"), size, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == slow_chunks(t, size, overlap), repr(t[:80])


def test_chunks_reach_the_end_of_a_long_text(spark):
    t = "word " * 101_000 + "the very last words of all stand here and nowhere else in this text"
    assert one(spark, C.chunk_list(F.col("t"), 5000, 100), "t string", t)[-1].content.endswith("else in this text")


def test_chunk_null_and_sections(spark):
    assert one(spark, C.chunk_list(F.col("t")), "t string", None) is None
    text = "\n\n".join(["a" * 60, "b" * 70, "c" * 300, "d" * 55, "e"])
    got = one(spark, C.section_list(F.col("t"), 150), "t string", text)
    assert got[0] == "a" * 60 + "\n\n" + "b" * 70
    assert got[-1] == "d" * 55 + "\n\ne"


def test_vectors(spark):
    s = "a array<float>, b array<float>"
    assert one(spark, V.cosine(F.col("a"), F.col("b")), s, [1.0, 0.0, 5.0], [1.0, 1.0]) == pytest.approx(0.70710678)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), s, [], [1.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), s, [0.0], [1.0]) == 0
    import zlib

    e = one(spark, V.hash_embedding(F.col("t")), "t string", "salam salam hello")
    assert e[zlib.crc32(b"salam") % 256] == pytest.approx(2 / 5**0.5)
    assert sum(one(spark, V.hash_embedding(F.col("t")), "t string", "")) == 0


def test_text(spark):
    f = lambda col, t: one(spark, col(F.col("t")), "t string", t)
    assert f(T.fold, "Əlaqə İstanbul") == "elaqe istanbul".replace("elaqe", "elaqe")
    assert f(T.script, "salam привет") == "mixed" and f(T.script, "123") == "unknown"
    assert f(T.is_small_talk, "Salam!") is True and f(T.is_small_talk, "") is False
    assert f(T.intent, "Namaz nədir?") == "FIQH_QUESTION"
    assert f(T.keywords_smart, "Namaz və dua haqqında")[:2] == ["haqqında", "namaz"]
    assert f(lambda c: T.trim_to_sentence(c, 10), "Bir. iki uc dord") == "Bir."
    assert f(lambda c: T.trim_to_sentence(c, 10), ".iki") == ".iki"
    assert f(T.csv_cell, "0") == '""' and f(T.csv_cell, 'a "b" <i>c</i>') == '"a ""b"" c"'
    assert f(lambda c: T.truncate_smart(c, 20), "word " * 10).endswith("...")
    assert f(T.quality, "x" * 500) == "medium"


def test_web(spark):
    f = lambda col, t: one(spark, col(F.col("t")), "t string", t)
    assert f(H.clean_text, "<nav>menu</nav><p>a &amp; b</p><script>x</script>") == "a & b"
    assert f(H.host, "HTTPS://www.A.com/x?y") == "a.com"
    assert f(lambda c: H.title(c, F.lit("http://h.example/x")), "<title>Long enough title - Site</title>") == "Long enough title"
    assert f(lambda c: H.title(c, F.lit("http://h.example/x")), "no title") == "İmport edilmiş məzmun - h.example"
    assert f(lambda c: H.absolute(c, F.lit("http://h.example/a/b")), "c#x") == "http://h.example/a/c"
    assert f(lambda c: H.absolute(c, F.lit("http://h.example/a/b")), "mailto:x") is None
    assert f(lambda c: H.in_scope(c, F.lit("https://h.example/blog/")), "https://h.example/blog/x") is True
    assert f(lambda c: H.in_scope(c, F.lit("https://h.example/blog/")), "https://h.example/blog/x.pdf") is False
    df = spark.createDataFrame([("a &lt; b &eacute;",)], "t string")
    assert df.select(H.decode_entities("t")).collect()[0][0] == "a < b é"


def test_site_scope(spark):
    base = "https://h.example/az/book/12/"
    f = lambda link, siblings=False, b=base: one(spark, H.in_site_scope(F.col("t"), F.lit(b), siblings), "t string", link)
    assert f("HTTPS://H.example:443/az/book/12") and f("https://h.example/az/book/12/part?x=1#y")
    assert not f("https://h.example/az/book/13") and f("https://h.example/az/book/13", True)
    assert not f("https://h.example/az/book/13/part", True) and not f("https://h.example/en/book/12", True) and not f("https://h.example/az", True)
    assert not f("http://h.example/az/book/12") and not f("https://g.example/az/book/12") and not f("/az/book/12") and not f(None)
    assert not f("https://h.example/az/book/12/a.PDF") and not f("https://h.example/az/book/12/images/a")
    assert f("https://h.example/any", b="https://h.example") and f("https://h.example", b="https://h.example/") and not f("https://h.example/b", True, "https://h.example/a")


def test_digest_embedding_against_brute_force(spark):
    import hashlib
    import math

    def slow(text):
        raw = text.encode()
        digests = [hashlib.new(h, raw).hexdigest() for h in ("sha256", "md5", "sha1")]
        v = []
        for i in range(1536):
            d, at = digests[i // 512], i % 64 * 2
            v.append(int(d[at : at + 2], 16) / 255 * 2 - 1 if at < len(d) else math.sin(i * 0.1 + sum(raw) * 0.001) * math.cos(len(raw) * 0.1))
        length = math.sqrt(sum(x * x for x in v))
        return [x / length for x in v]

    for text in ("", "salam", "Əlaqə üçün 12 sual? " * 200):
        assert one(spark, V.digest_embedding(F.col("t")), "t string", text) == pytest.approx(slow(text), abs=1e-9)
    assert one(spark, V.digest_embedding(F.col("t")), "t string", None) is None


def test_fold_all(spark):
    f = lambda t: one(spark, T.fold_all(F.col("t")), "t string", t)
    assert f("Əlaqə e\u0301té ﬁ ² İ") == "elaqe ete fi 2 i" and f("") == "" and f(None) is None


def test_source_lines(spark):
    f = lambda t, closed=True: one(spark, T.source_lines(F.col("t"), "L", closed), "t string", t)
    assert f("a\nMənbə: Q&A Training, no 3\nb") == "a\n**Mənbə:** L\nb"
    assert f("Mənbə:  https://h.example/x y") == "**Mənbə:** https://h.example/x y"
    assert f("Mənbə: some book\nb") == "**Mənbə:** L\nb" and f("Mənbə: some book\nb", False) == "**Mənbə:** some book\nb"
    assert f("Mənbə: see https://h.example") == "Mənbə: see https://h.example"
    assert f("Mətn.\nMənbələr:\n- Book one\n• Book two\nson") == "Mətn.\n**Mənbə:** L\nson"
    assert f("**Mənbə:** ready") == "**Mənbə:** ready" and f("") == "" and f(None) is None


def test_bytes_of_tables(spark):
    import os

    from quern.plans.lookups import QUERIES

    folder = "/root/testdata/sf0.001"
    for r in QUERIES["catalog_bytes"](spark, folder).collect():
        path = f"{folder}/{r.name}.parquet"
        files = [path] if os.path.isfile(path) else [f"{path}/{x}" for x in os.listdir(path) if x.endswith(".parquet")]
        assert r.bytes == sum(map(os.path.getsize, files))
