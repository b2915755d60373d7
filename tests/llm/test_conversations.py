import os
from datetime import datetime as D
from datetime import timedelta

import pytest

from quern.llm import conversations as C

MESSAGE = "id bigint, chat_session_id bigint, role string, content string, created_at timestamp, slice string, turns int"
T0 = D(2024, 3, 1, 10, 59, 0)


def rows(spec):
    """spec: {session: [(role, content, seconds)]} with running ids."""
    out, i = [], 0
    for s, turns in spec.items():
        for role, content, sec in turns:
            i += 1
            out.append((i, s, role, content, T0 + timedelta(seconds=sec) if sec is not None else None, "x", 1))
    return out


def run(spark, tmp_path, data, sessions=()):
    path = str(tmp_path / "messages.parquet")
    spark.createDataFrame(data, MESSAGE).write.mode("overwrite").parquet(path)
    slices = C.rebuild(spark, path)
    known = spark.createDataFrame([(s,) for s in sessions], "id bigint")
    messages = spark.read.parquet(path)
    broken = sorted(r.chat_session_id for r in C.broken_conversations(slices.parts, known).collect())
    whole = [tuple(r) for r in C.conversations(slices, messages).orderBy("chat_session_id", "slice", "turn_no").select("chat_session_id", "speaker", "content").collect()]
    return broken, whole


def test_cases(spark, tmp_path):
    u, a = "user", "assistant"
    spec = {
        1: [(u, "Hello", 0), (a, "Hi", 1)],
        2: [(" USER", "Hello", 0), ("Bot", "Hi", 70), ("\tassistant", "Hi", 71), ("system", "x", 72)],  # repeated turn across the hour
        3: [(a, "Hi", 0), (u, "Hello", 1), (a, "Hi", 2)],
        4: [(u, "Hello", 0), (u, "Other", 90), (a, "Hi", 91)],  # same speaker across the hour
        5: [(u, "Hello", 0), (a, "null", 1)],
        6: [(u, "Hello", 0), ("?", "Hi", 1), (a, "x", 2)],
        7: [("system", "x", 0)],
        8: [(u, "Hello", 0), (a, "Hi", 1), (u, "More", 2)],
        9: [(u, "?", 0), (a, "👍", 1)],  # short but real
        10: [(u, "null dəyəri nədir?", 1), (a, "Error 502 yazır", 2)],
        11: [(u, "​ \n", 0), (a, "Hi", 1)],
        12: [(a, "Hi", 5), (u, "Hello", 0)],  # late row
        13: [(u, "Hello", None), (a, "Hi", 0)],  # no time counts as earliest
        14: [(None, "x", 0), (a, "Hi", 1)],
        None: [(u, "no session", 0)],
    }
    data = rows(spec)
    broken, whole = run(spark, tmp_path, data + data[:4], sessions=[1, 99])  # rows stored twice
    assert broken == [3, 4, 5, 6, 7, 8, 11, 14, 99]
    assert [x for x in whole if x[0] == 2] == [(2, "user", "Hello"), (2, "assistant", "Hi")]
    assert {x[0] for x in whole} == {1, 2, 9, 10, 12, 13}


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, []) == ([], [])
    assert run(spark, tmp_path, [], [5])[0] == [5]


def test_slices_do_not_change_the_result(spark, tmp_path):
    data = rows({1: [("user" if i % 2 == 0 else "assistant", f"t{i}", i * 400) for i in range(60)], 2: [("user", "a", 0), ("assistant", "b", 4000), ("assistant", "c", 9000)]})
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame(data, MESSAGE).write.parquet(path)
    for length in ("5 minutes", "1 day"):
        checks = {r.chat_session_id: r for r in C.conversation_checks(C.rebuild(spark, path, slice_length=length).parts).collect()}
        assert checks[1].n_turns == 60 and not checks[1].same_speaker and not checks[1].ends_with_user
        assert checks[2].same_speaker


def write_files(spark, folder, files):
    """One Parquet file per list of rows, each younger than the one before."""
    os.makedirs(folder)
    for i, data in enumerate(files):
        spark.createDataFrame(data, MESSAGE).coalesce(1).write.parquet(f"{folder}-{i}")
        part = next(x for x in os.listdir(f"{folder}-{i}") if x.endswith(".parquet"))
        os.rename(f"{folder}-{i}/{part}", f"{folder}/f{i:03}.parquet")
        os.utime(f"{folder}/f{i:03}.parquet", (1_700_000_000 + 10 * i,) * 2)


def days(n, late=0):
    """Conversation 1 has a pair of turns each day, in its own file; 2 comes back after its timeout; some rows come LATE seconds late."""
    out = []
    for d in range(n):
        at = T0 + timedelta(days=d)
        out.append([(10 * d + 1, 1, "user", f"q{d}", at, "", 0), (10 * d + 2, 1, "assistant", f"a{d}", at + timedelta(seconds=5), "", 0), (10 * d + 5, 100 + d, "user", "alone", at + timedelta(seconds=9), "", 0)])
    out[0].append((3, 2, "user", "x", T0, "", 0))
    out[-1].append((4, 2, "assistant", "y", T0 + timedelta(days=n - 1), "", 0))
    if late:
        out[4 if late > 3600 else 2].append((7, 3, "user", "early", T0 + timedelta(days=1, seconds=9 - late), "", 0))
        out[1].append((8, 3, "assistant", "answer", T0 + timedelta(days=1), "", 0))
    return out


def test_one_file_a_trigger(spark, tmp_path):
    files = days(12, late=60)
    write_files(spark, str(tmp_path / "m"), files)
    results = []
    for each, delay in ((1, "2 days"), (None, "10 minutes")):
        r = C.rebuild(spark, str(tmp_path / "m"), delay=delay, timeout="3 days", files_per_trigger=each)
        checks = sorted(tuple(x) for x in C.conversation_checks(r.parts).collect())
        results.append(checks)
        assert {x.chat_session_id: x.n for x in r.parts.groupBy("chat_session_id").agg(C.F.count("*").alias("n")).collect()}[2] == 2  # two parts
    assert results[0] == results[1]
    by = {x[0]: x for x in results[0]}
    assert by[1] == (1, 24, False, False, False, False, False) and by[2] == (2, 2, False, False, False, False, False)
    assert by[3][1] == 2 and not by[3][5] and all(by[100 + d][6] for d in range(12))


def test_rows_beyond_the_delay_stop_the_job(spark, tmp_path):
    write_files(spark, str(tmp_path / "m"), days(6, late=7200))
    with pytest.raises(RuntimeError, match="1 message rows came later"):
        C.rebuild(spark, str(tmp_path / "m"), delay="1 minute", files_per_trigger=1)


def test_rows_without_a_time_keep_the_order_of_ids(spark, tmp_path):
    path = str(tmp_path / "m")
    data = [(i * C.UNDATED, 1, "user" if i % 2 == 0 else "assistant", f"t{i}", None, "", 0) for i in range(6)]
    spark.createDataFrame(data, MESSAGE).write.parquet(path)
    r = C.rebuild(spark, path)
    assert r.slices.count() == 6 and [tuple(x) for x in C.conversation_checks(r.parts).collect()] == [(1, 6, False, False, False, False, False)]
