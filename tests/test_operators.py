from datetime import datetime as D

from pyspark.sql import functions as F

from __spark_entry__ import queries
from quern.operators import analytics as A
from quern.operators import relational as R
from quern.operators import retrieval as Q
from quern.operators.crawl import reach
from quern.sources.sinks import error_lines, range_or_newest


def test_series_are_filled_and_today_is_left_out(spark):
    now = D(2024, 5, 10, 12)
    df = spark.createDataFrame([(D(2024, 5, 10, 1),), (D(2024, 5, 9, 23),), (D(2024, 4, 10),), (D(2024, 4, 9),)], "t timestamp")
    days = {r.bin: r.n for r in A.daily(df, "t", now).collect()}
    assert len(days) == 30 and days["2024-05-09"] == 1 and days["2024-04-10"] == 1 and "2024-05-10" not in days
    hours = {r.bin: r.n for r in A.hourly(df, "t", now).collect()}
    assert len(hours) == 24 and hours["23:00"] == 1 and hours["01:00"] == 1 and hours["12:00"] == 0
    assert len(A.monthly(df, "t", now).collect()) == 6


def test_growth_and_percent(spark):
    empty = spark.createDataFrame([], "t timestamp")
    assert A.growth(empty, "t", D(2024, 5, 10)).collect()[0].growth_pct == 0
    some = spark.createDataFrame([(D(2024, 5, 9),)], "t timestamp")
    assert A.growth(some, "t", D(2024, 5, 10)).collect()[0].growth_pct == 100


def test_duration_edges(spark):
    m = lambda n: D(2024, 1, 1, n // 60, n % 60)
    df = spark.createDataFrame([(m(0), m(x)) for x in (0, 5, 15, 60, 120, 121)], "a timestamp, b timestamp")
    assert {r.bin: r.n for r in A.duration_histogram(df, "a", "b").collect()} == {"0-5": 1, "5-15": 1, "15-30": 1, "30-60": 0, "60+": 2}


def test_pair_gaps(spark):
    t = lambda s: D(2024, 1, 1, 0, s // 60, s % 60)
    rows = [(1, "user", t(0), 1), (1, "user", t(1), 2), (1, "assistant", t(1), 3), (1, "assistant", t(9), 4), (2, "user", t(0), 5), (2, "assistant", t(299), 6), (3, "user", t(0), 7), (3, "assistant", t(300), 8)]
    got = A.response_gaps(spark.createDataFrame(rows, "s int, role string, t timestamp, id int"), "s", "role", "t", "id").collect()
    assert [(r.s, r.gap) for r in got] == [(2, 299)]


def test_fallbacks(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "g int, v int")
    kept = sorted(map(tuple, R.keep_if_any(df, F.col("v") > 1, ["g"]).collect()))
    assert kept == [(1, 2), (2, 5)]
    assert R.keep_if_any(df, F.col("v") > 9, ["g"]).count() == 3
    tiers = R.first_nonempty([df.where("v > 9"), df.where("v = 5"), df])
    assert [tuple(r) for r in tiers.collect()] == [(2, 5, 2)]


def test_upsert_and_insert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (2, "d"), (3, None)], "k int, v string")
    assert sorted(map(tuple, R.upsert(a, b, ["k"]).collect()), key=str) == [(1, "a"), (2, "d"), (3, None)]
    assert sorted(map(tuple, R.insert_missing(a, b, ["k"]).collect()), key=str) == [(1, "a"), (2, "b"), (3, None)]


def test_budget(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(5)], "g int, i int, n int")
    assert R.within_budget(df, ["g"], ["i"], F.col("n"), 25).count() == 3
    assert R.within_budget(df, ["g"], ["i"], F.col("n"), 25, crossing=False).count() == 2


def test_budget_in_blocks_keeps_the_hot_group(spark):
    df = spark.createDataFrame([(g, i, i % 4) for g in (1, 2, None) for i in range(40)] + [(3, None, 5), (3, 1, 9)], "g int, i int, n int")
    for crossing in (True, False):
        want = R.within_budget(df, ["g"], ["i"], F.col("n"), 21, crossing)
        got = R.within_budget(df, ["g"], ["i"], F.col("n"), 21, crossing, F.expr("i div 6"))
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {r.g for r in got.collect()} == {1, 2, 3, None}


def test_queries_over_all_sessions_and_orders(spark, tmp_path):
    t = lambda n: D(2024, 1, 1 + n // 24, n % 24)
    rows = [(i, 1 if i <= 1500 else 2, t(i // 10), "user", f"text {i % 7}") for i in range(1, 1521)]
    spark.createDataFrame(rows, "id bigint, chat_session_id bigint, created_at timestamp, role string, content string").write.parquet(f"{tmp_path}/messages.parquet")
    q = queries()
    for name, n in (("w_running_budget", 29 + 20), ("w_greedy_budget", 50 + 20), ("r_continue", 12 + 12)):
        assert q[name](spark, str(tmp_path)).count() == n, name
    pieces = q["r_context_pieces"](spark, str(tmp_path)).collect()
    assert sorted((r.chat_session_id, r.piece) for r in pieces) == [(1, 0), (1, 1), (2, 1)]
    spark.createDataFrame([(7,), (600_001,)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(600_001, 2), (600_001, 1)], "l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, q["j_eager_1ton"](spark, str(tmp_path)).collect())) == [(7, None), (600_001, "1,2")]


def test_more_questions_than_a_block(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(i * i % 7)]) for i in range(20)], "vec_id bigint, v array<double>")
    asked = df.select(F.col("vec_id").alias("question_id"), F.col("v").alias("q"))
    want = sorted(map(tuple, Q.top_k(asked, df, 2).collect()))
    monkeypatch.setattr(Q, "QUESTIONS", 3)
    assert sorted(map(tuple, Q.top_k(asked, df, 2).collect())) == want and len(want) == 40


def test_more_terms_than_a_hundred_thousand(spark):
    n = 100_500
    index = spark.range(n).select(F.col("id").cast("string").alias("term"), "id", F.lit(1).alias("tf"))
    asked = spark.range(n).select((F.col("id") % 10).alias("query_id"), F.col("id").cast("string").alias("term"))
    got = Q.full_text(index, spark.range(1).select(F.lit(n).alias("n_docs")), asked, "id", n)
    assert got.count() == n


def test_reach_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src bigint, dst bigint")
    got = reach(edges, spark.createDataFrame([(1,)], "node bigint"), 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 1), (3, 2)]


def test_crawl_follows_the_links_of_pages(spark, tmp_path):
    u = "https://sual.nurqapi.example/yazi/"
    rows = [(1, f"{u}a", f'<a href="{u}b">x</a> <a href="/other/z">x</a>'), (2, "https://sual.nurqapi.example/q", f'<a href="{u}far">x</a>')]
    spark.createDataFrame(rows, "id bigint, source_url string, content string").write.parquet(f"{tmp_path}/knowledge_base.parquet")
    assert sorted(map(tuple, queries()["crawl_pages"](spark, str(tmp_path)).collect())) == [(f"{u}a", 0), (f"{u}b", 1)]


def test_export_fallback_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 2))], "id int, at timestamp")
    assert range_or_newest(df, "at", "id", "2024-01-02", "2024-01-03").count() == 1
    assert [r.id for r in range_or_newest(df, "at", "id", "2025-01-02", "2025-01-03", 1).collect()] == [2]
    (tmp_path / "x.log").write_text("[2024-01-01] a ERROR x\n[2024-01-03] b ERROR y\n[2024-01-02] fine\n")
    assert [r["at"] for r in error_lines(spark, str(tmp_path / "x.log"), 1).collect()] == ["2024-01-03"]
