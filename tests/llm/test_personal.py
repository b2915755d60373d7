import random

import pytest

from quern.llm import personal as P

PARTS = {"orxan", "dasqinli", "lydia", "ashgrain"}


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([(w,) for w in sorted(PARTS)], "w string")



def kinds(t, field="content"):
    return sorted({k for _, _, k, _ in P.find(t, PARTS, field)})


def test_found():
    assert kinds("E-poçtum orxan_1 (at) mail [dot] example, gözləyirəm.") == ["email"]
    assert kinds("Nömrəm +994 50 555 47 94, zəng edin.") == ["phone"]
    assert kinds("FİN kodum EXLR2Y3.") == ["id_number"] and kinds("identity card 947-96-3692") == ["id_number"]
    assert kinds("Ünvanım: Yeni Bağ küç. 55/15.") == ["address"] and kinds("I live at 54b Foxglove Avenue, unit 10.") == ["address"]
    assert kinds("Hörmətli Zaur Yenisoylu, müraciətiniz qeydə alındı.") == ["name"]
    assert kinds("Меня зовут Глеб, запишите, пожалуйста.") == ["name"]
    assert kinds("Lydia Ashgrain, 58 Willowmere Road", "user_name") == ["address", "name"]


def test_not_found():
    for t in ["Sifariş nömrəsi 2024-0005-217 işləmir.", "v2.10.117 versiyasında problem var", "Qiymət 1 250 manat idi, tarix 12.03.2024.", "promo kod N3MH3HG keçmir",
              "Sənəd KB-00012345 açılmır", "@sual_botu cavab vermir", "«Sakit Liman» kitabında 12-ci səhifə", "Bütçe tablosu", "", "Salam, necəsiniz?", "Hörmətlə, Necə edim ki namaz olsun"]:
        assert kinds(t) == [], t
    for t in ["Qonaq", "silent reader", "user_43118", "mavi.dəniz", "-", "читатель55811"]:
        assert kinds(t, "user_name") == [], t


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82 WEST 1234 5698 7654 32") and not P.mod97("GB82 WEST 1234 5698 7654 33")
    assert P.turkish_id("10000000146") and not P.turkish_id("10000000147")


def test_checksums_decide():
    assert kinds("Kartım 4111 1111 1111 1111 idi") == ["id_number"] == kinds("ödəniş GB82 WEST 1234 5698 7654 32") == kinds("benim 10000000146 olacak")
    assert kinds("kimlik 4111111111111112") == [] == kinds("kimlik no 10000000147") == kinds("iban GB82 WEST 1234 5698 7654 33") == kinds("sifariş 4111 1111 1111 1111")
    assert kinds("снилс 112-233-445 95") == ["id_number"] and kinds("kart 4111 1111 1111 1112 ") == []


def test_many_name_parts_give_the_same_result(spark, parts):
    texts = P.personal_texts(spark, "/root/testdata/sf0.001")
    known = P.name_parts(spark.read.parquet("/root/testdata/sf0.001/chat_feedback.parquet"))
    a, b, c = ({tuple(r)[:4] for r in P.personal_spans(texts, known, **x).collect()} for x in ({}, {"most": 1}, {"prefilter": False}))
    assert a == b == c and a


def test_redacted_text_keeps_the_rest():
    t = "Nömrəm 050-555-47-94, zəng edin. Mən Orxan, sualım var."
    assert P.redact(t, P.find(t, PARTS)) == "Nömrəm [PHONE], zəng edin. Mən [NAME], sualım var."


def test_prefilter_loses_nothing():
    rng = random.Random(5)
    bits = ["Nömrəm 0505554794", "a@b.example", "Hörmətli Orxan, müraciətiniz", "FİN kodum EXLR2Y3", "ul. 5", "Yeni Bağ küç. 5", "2024-0005-2", "Salam", "12 Larkspur Road", "Mən Orxan, sualım var", "ул. Тихая, д. 5"]
    import re

    pre = re.compile(P.PROPOSALS)
    for _ in range(400):
        t = " ".join(rng.sample(bits, 2))
        if kinds(t):
            assert pre.search(P.fold(t)), t


def test_prefilter_of_the_jvm_loses_nothing(spark, parts):
    texts = ["Hello, Lydia Ashgrain", "Mən Orxan", "this is Lydia", "I am Lydia Ashgrain.", "Это Lydia", "Adım Zaur", "x\nLydia Ashgrain\ny", " L. Ashgrain ", "Atatürk Bulvarı No:12", "12 Oak Hill", "7 Elm Ln",
             "5 Oak Boulevard", "3 Elm dr.", "наб. Мойки 12", "Тихая набережная, 5", "б-р Победы 7", "Gül sk. 5", "Nizami xiyabanı 9", "Bakı şossesi 3", "orxan [ at] mail [dot] example", "٠٥٠ 555 47 94", "+٩٩٤ ٥٠ ٥٥٥ ٤٧ ٩٤",
             "GB82 WEST 1234 5698 7654 32", "AZE 12345678", "Salam, necəsiniz?", "hemen gel", "Lydi̇a"]
    df = spark.createDataFrame([("messages", i, "content", t) for i, t in enumerate(texts)], "src_table string, rec_id bigint, field string, text string")
    every, kept = ({r.rec_id: r.redacted for r in P.personal_spans(df, parts, x).collect()} for x in (False, True))
    assert kept == every and {0, 5, 6, 8, 9, 13} <= set(every)


def test_table(spark, parts):
    schema = "src_table string, rec_id bigint, field string, text string, spans string, redacted string"
    rows = [("messages", 1, "content", "tel 050-555-47-94", "", ""), ("messages", 2, "content", None, None, None), ("messages", 3, "content", "", "", ""), ("messages", 4, "content", "x " * 50_000 + "a@b.example", "", "")]
    got = P.personal_spans(spark.createDataFrame(rows, schema), parts).collect()
    assert sorted((r.rec_id, r.spans[0].kind) for r in got) == [(1, "phone"), (4, "email")]
    assert P.personal_spans(spark.createDataFrame([], schema), parts).count() == 0
    users = spark.createDataFrame([("Orxan Daşqınlı",), ("Orxan Daşqınlı",), ("Qonaq",), (None,), ("x",)], "user_name string")
    assert {r.w for r in P.name_parts(users).collect()} == {"orxan", "dasqinli"}


def test_batches_without_a_hit(spark, parts):
    rows = [("messages", i, "content", f"call 12345-67 order {i}") for i in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert P.personal_spans(spark.createDataFrame(rows, "src_table string, rec_id bigint, field string, text string"), parts).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
