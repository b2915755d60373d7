import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import garbled as G

CLEAN = [
    "Mənə namaz barədə yazın, zəhmət olmasa. Gözlə görünən dəyişiklik dua və oruc arasında oldu.", "Sonrakı bölmədə axtarış indeksi daha geniş izah edilir.",
    "Bana güncelleme paketi hakkında yazar mısınız? Göze çarpan değişiklik öğretmen görüşü ile ilgilidir.", "İmzaladığınız kâğıt iki tarafı da bağlar, şikâyet dilekçesi çoğu zaman karıştırılır.",
    "Здравствуйте, сегодня хорошая погода. Про вечерняя молитва собрано девять отдельных записей.", "Часто путают, где азан, а где милостыня, хотя разница велика.",
    "The answer is short: without the archive record no khanate era is complete. What’s next – “we” wait…", "Yesterday I read of the fasting day but the source isn't clear.",
]


@pytest.fixture(scope="module")
def model():
    return G.train(CLEAN * 40)


@pytest.mark.parametrize("pair", [p for p in G.PAIRS if p.name in ("utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as cp437", "utf-8 as cp1252, twice")], ids=lambda p: p.name)
def test_round_trip(model, pair):
    for t in CLEAN[:6]:
        bad = pair.garble[0](t)
        path = G.viterbi(model, [bad])[0]
        assert path is not None and G.restored(bad, path, model) == t


def test_cyrillic_pairs(model):
    for name in ("utf-8 as cp1251", "cp1251 as cp1252", "koi8-r as cp1251", "cp1251 as koi8-r"):
        pair = next(p for p in G.PAIRS if p.name == name)
        bad = pair.garble[0](CLEAN[4])
        path = G.viterbi(model, [bad])[0]
        assert path is not None, name
        assert sum(a == b for a, b in zip(G.restored(bad, path, model), CLEAN[4])) > 0.8 * len(CLEAN[4])


def test_clean_text_with_rare_letters(model):
    for t in [*CLEAN, "Ðani", "Ärlig Öst namaz", "Przełęcz Żółta dua", "ΑΒΓ δέλτα", "مرحبا", "±2 °C, § 5, 10 €", "👍🏽 ♥ ↑", "", " ", "São Côte naïve café"]:
        assert G.viterbi(model, [t])[0] is None, t


def test_partly_garbled_and_lost(model):
    half = CLEAN[0][:40] + G.PAIRS[0].garble[0](CLEAN[0][40:])
    path = G.viterbi(model, [half])[0]
    assert G.restored(half, path, model) == CLEAN[0] and (path[:20] == 0).all()
    assert G.viterbi(model, ["haqq�nda"])[0] is not None


def test_long_text_is_labelled_whole(model):
    t = CLEAN[0] * 500 + G.PAIRS[0].garble[0](CLEAN[1])
    assert G.restored(t, G.viterbi(model, [t])[0], model) == CLEAN[0] * 500 + CLEAN[1]


def test_table(spark, model):
    bad = G.PAIRS[0].garble[0](CLEAN[0])
    rows = [("m", 1, "content", bad, "x"), ("m", 1, "content", bad, "x"), ("m", 2, "content", None, None), ("m", 3, "content", "", ""), ("m", 4, "content", CLEAN[0], "")]
    schema = "src_table string, rec_id bigint, field string, text string, restored string"
    got = G.label(spark.createDataFrame(rows, schema), model).collect()
    assert [(r.rec_id, r.restored) for r in got] == [(1, CLEAN[0])]
    assert G.label(spark.createDataFrame([], schema), model).count() == 0
    assert G.fit(spark.createDataFrame([], schema)).log.shape[1] == len(G.PAIRS) + 1


SCHEMA = "src_table string, rec_id bigint, field string, text string"


def test_batches_without_a_hit(spark, model):
    rows = [("m", i, "content", f"São Côte naïve café {i}") for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert G.label(spark.createDataFrame(rows, SCHEMA), model).count() == 0
        bad = G.PAIRS[0].garble[0](CLEAN[0])
        assert G.label(spark.createDataFrame([*rows, ("m", 99, "content", bad)], SCHEMA), model).count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prefilter_loses_nothing(spark):
    texts = G.text_fields(spark, "/root/testdata/sf0.001")
    model = G.fit(texts)
    a, b = ({tuple(r)[:4] for r in G.label(texts, model, x).collect()} for x in (True, False))
    assert a == b and a


def test_impossible_inverse_takes_the_likeliest_result(model):
    bad = G.PAIRS[0].garble[0](CLEAN[0])
    twice = 1 + [p.name for p in G.PAIRS].index("utf-8 as cp1252, twice")
    assert G._inverse(bad, twice, model) == CLEAN[0]


def test_every_text_is_counted(spark):
    texts = [f"{CLEAN[i % len(CLEAN)]} {i}" for i in range(6000)] + ["Ok", "Щъщъ ёъ.", CLEAN[0] * 300]
    texts = [t for t in texts if not re.search(G.SUSPECT, t)]
    got, want = G.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)), G.train(texts)
    assert got.index == want.index and np.array_equal(got.log, want.log)
    x, y = (want.index[c] for c in "ёъ")
    assert got.log[x * got.width + y, 0] > np.log(G.UNSEEN_CLEAN) + 1


def test_counts_of_garbled_texts_follow_from_clean_ones(monkeypatch):
    texts = ["short", "Türkçe şey", "Жук 😀 → ёж", "“So” – No…", "ıĞ"] * 3
    monkeypatch.setattr(G, "COUNTED", 20)
    model = G.train(texts)
    for name in ("utf-8 as cp437", "utf-8 as cp1252, twice", "lost bytes"):
        k = 1 + [p.name for p in G.PAIRS].index(name)
        bad = "".join(f" {x} " for g in G.PAIRS[k - 1].garble for t in texts if (x := g(t)) != t)
        pairs, single, before = Counter(zip(bad, bad[1:])), Counter(bad[1:]), Counter(bad[:-1])
        for (x, y), n in pairs.items():
            if min(x, y) > "\x7f":
                p = (n + G.SMOOTH * single[y] / len(bad)) / (before[x] + G.SMOOTH) + G.UNSEEN_GARBLED
                assert abs(model.log[model.index[x] * model.width + model.index[y], k] - np.log(p)) < 0.03, (name, x, y)


def test_a_larger_corpus_of_the_same_texts_gives_the_same_model():
    a, b = (G.train(CLEAN * n) for n in (1200, 2400))
    assert a.index == b.index and np.allclose(a.log, b.log, atol=1e-3)
