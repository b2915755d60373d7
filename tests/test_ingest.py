import random
import re
from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quern.functions import keywords as K
from quern.functions.dom import main_block
from quern.operators import ingest as I
from quern.operators import relational as R
from quern.operators.skew import beside


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


def keywords(text):
    """Word by word, as a list of steps."""
    q = re.sub(r"\s+", " ", text.lower()).strip()
    less = q
    for w in K.FILLERS:
        less = re.sub(rf"\b{re.escape(w)}\b", "", less)
    less = re.sub(r"\s+", " ", less).strip()
    kept = q if len(less.encode()) < 3 else less
    words = [w for w in re.findall(r"[^\W\d_]{2,}", kept) if w not in K.STOP and len(w) >= 3]
    first = [w for w in words if any(t in w or w in t for t in K.FIRST)]
    order = first + [w for w in words if w not in first]
    if not order:
        order = [w for w in sorted(text.split(" "), key=lambda w: -len(w)) if len(w) >= 3][:3]
    out = []
    for w in order:
        forms = [w, *K.VARIATIONS.get(w.lower(), []), w.lower(), *[w.lower()[: -len(e)] for e in K.ENDINGS if w.lower().endswith(e)]]
        out += [x for x in forms if x not in out]
    return list(dict.fromkeys(out))


def test_keywords_against_brute_force(spark):
    texts = ["Salam, namaz necə qılınır?", "bir bu o", "Zəhmət olmasa dəstəmazın qaydasını izah edin", "ABC 12 x", "Oruc  tutmaq vacibdir mi, bu-o?", "", "su suyun qiblə kitab kitabın", "nə üçün bu belədir"]
    rng = random.Random(3)
    bits = [*K.FILLERS[:12], "namaz", "kitabın", "su", "qapı", "edin", "oruc", "12", "?", "abdest"]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    for r in df.select("id", K.keywords_enhanced(F.col("c")).alias("x")).collect():
        assert r.x == keywords(texts[r.id]), texts[r.id]
    assert one(spark, None, K.keywords_enhanced) is None


def test_reduced(spark):
    a, b, c = "a" * 60, "b" * 90, "c" * 70
    text = "\n\n".join([a, "short", b, c])
    assert one(spark, text, lambda x: K.reduced(x, 500)) == text
    assert one(spark, text, lambda x: K.reduced(x, 225)) == "\n\n".join([a, b, c])
    assert one(spark, text, lambda x: K.reduced(x, 200)) == "\n\n".join([b, c])
    assert one(spark, "x" * 300, lambda x: K.reduced(x, 100)).startswith("xxx") and one(spark, None, lambda x: K.reduced(x, 100)) is None


def test_model_dimension(spark):
    got = [one(spark, m, K.model_dimension) for m in ("text-embedding-3-large", "voyage-2", "embedding-001", "other", "", None)]
    assert got == [3072, 1024, 768, 1536, None, None]


def test_main_block():
    long = "word " * 40
    page = f"<html><body><div class='nav'>Menu</div><article><p>short</p></article><div id=content><h1>T</h1><script>x()</script><p>{long}&amp; more</p><div class='ads-box'>Buy</div></div><footer>f</footer></body></html>"
    assert main_block(page) == f"T {long}& more".strip()
    assert main_block("plain <b>text</b> only") == "plain text only" and main_block("") == "" and main_block("<div><p>open") == "open"
    assert main_block("<div>" * 3000 + "deep") == "deep"


def test_reindex(spark):
    text = "Bir cümlə burada dayanır. " * 60
    kb = spark.createDataFrame([(1, text), (2, "qısa"), (3, None), (4, "")], "id bigint, content string")
    empty = spark.createDataFrame([], "kb_id bigint, chunk_index int, content string, char_count int, vector_id string, vector array<double>")
    status, index = I.reindex(kb, empty)
    got = {r.id: (r.indexing_status, r.chunks_count) for r in status.collect()}
    rows = index.collect()
    assert got[3] == ("failed", 0) and got[2] == got[4] == ("completed", 1) and got[1][1] == sum(r.kb_id == 1 for r in rows) > 1
    assert all(r.vector_id == f"kb_{r.kb_id}_chunk_{r.chunk_index}" and r.char_count == len(r.content) for r in rows)
    again = I.reindex(kb.where("id = 1"), index, 400, 80)[1].collect()
    assert {r.kb_id for r in again} == {1, 2, 4} and sum(r.kb_id == 1 for r in again) > got[1][1]


def test_extractive(spark):
    chunks = spark.createDataFrame([(1, 0, "Namaz vacibdir. Kitab haqqında cümlə başla"), (1, 1, "nır burada. Oruc tutulur. namaz kiçik hərflə."), (1, 2, "Namaz vacibdir. Namaz beş vaxtdır. Son"), (2, 0, "Başqa mətn. ")], "kb_id bigint, chunk_index int, content string")
    asked = spark.createDataFrame([(7, ["namaz"]), (8, ["yoxdur"]), (9, ["x"])], "query_id bigint, words array<string>")
    hits = spark.createDataFrame([(7, 1, 1), (8, 2, 1)], "query_id bigint, kb_id bigint, rank bigint")
    got = {r.query_id: r.answer for r in I.extractive(asked, hits, chunks).collect()}
    assert got == {7: "Namaz vacibdir.\n\nNamaz beş vaxtdır.", 8: "Başqa mətn."}
    cut = {r.query_id: r.answer for r in I.extractive(asked, hits, chunks, 20).collect()}
    assert cut[7] == "Namaz vacibdir."
    assert I.extractive(asked, hits.where("rank > 5"), chunks).count() == 0


def test_beside_against_a_list(spark):
    rng = random.Random(8)
    t0 = D(2025, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["u", "a", None]), None if rng.random() < 0.05 else t0 + timedelta(minutes=rng.randint(0, 600))) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, g bigint, v string, at timestamp")
    for ahead in (False, True):
        got = {r.id: r.n for r in beside(df, "g", "at", "id", F.col("v"), "n", ahead).collect()}
        for g in (1, 2, None):
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[3] is not None, r[3] or t0, r[0]), reverse=ahead)
            last = None
            for r in own:
                assert got[r[0]] == last, (r, ahead)
                last = r[2] or last
    assert beside(df.where("false"), "g", "at", "id", F.col("v"), "n").columns == [*df.columns, "n"]


def test_writes(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "c", 2)], "t string, c string, v int")
    b = spark.createDataFrame([("x", None, 5), ("x", None, 4), ("z", "c", 3)], "t string, c string, v int")
    assert sorted(map(tuple, R.upsert(a, b, ["t", "c"]).collect()), key=str) == [("x", None, 5), ("y", "c", 2), ("z", "c", 3)]
    assert sorted(map(tuple, R.bulk_update(a, "v > 1", v="v + 10").collect()), key=str) == [("x", None, 1), ("y", "c", 12)]
    assert R.truncate(a).count() == 0 and R.truncate(a).columns == a.columns


def test_order_by_choice_and_errors(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 1)], "id int, a string, at int")
    assert [r.id for r in I.ordered_by_choice(df, "a", ["a"], "at", "id", False).collect()] == [2, 1]
    assert [r.id for r in I.ordered_by_choice(df, "id; x", ["a"], "at", "id").collect()] == [1, 2]
    lines = spark.createDataFrame([(i, f"[t{i}] {'ERROR' if i % 9 == 0 else 'INFO'}") for i in range(200)], "n int, line string")
    assert [r.at for r in I.last_errors(lines, ["n"], "line").collect()] == ["t198", "t189", "t180", "t171", "t162"]


def test_windows_as_a_stream(spark, tmp_path):
    from quern.streaming.windows import tumbling_counts

    rows = [(D(2025, 1, 1 + i // 4, i % 4), "a" if i % 3 else "b") for i in range(20)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(path)
    job = tumbling_counts(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination()
    want = sorted(map(tuple, tumbling_counts(spark.read.parquet(path), "ts", "kind").collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want and want


def test_shared_folder_is_required_on_a_cluster():
    from quern.sources.shared import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")


def test_similar_entries(spark):
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join([*words[:39], "other"]), " ".join(words[::-1])
    rows = [(1, "T", a, 0), (2, "T", b, 0), (3, "T", c, 0), (4, "T", a.upper(), 0), (5, "U", a, 0), (6, None, a, 0), (7, "T", None, 0), (8, "V", "", 0), (9, "V", "", 0)]
    df = spark.createDataFrame(rows, "id bigint, title string, content string, first int")
    got = {r.id: (r.first, round(r.similarity, 3)) for r in I.similar_entries(df).collect()}
    assert got == {2: (1, round(35 / 37, 3)), 4: (1, 1.0), 9: (8, 1.0)}
    assert I.similar_entries(df.where("id > 90")).count() == 0
