from datetime import datetime as D

from pyspark.sql import functions as F

from quern.operators.references import orphan_references, orphan_report
from quern.operators.skew import hot_keys, merge_join

A, B, C = D(2024, 1, 1), D(2024, 1, 2), D(2024, 2, 3)
CHILD = "id bigint, parent_id bigint, created_at timestamp, ref string, valid_from string"
PARENT = "id bigint, created_at timestamp, gone timestamp, known boolean"


def found(spark, children, parents, **kw):
    rows = orphan_references(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), "t", **kw).collect()
    return sorted(((r.child_id, r.ref, r.kind) for r in rows), key=str)


def test_kinds_and_clashing_columns(spark):
    children = [(1, 10, B, "x", "y"), (2, 11, A, None, None), (3, 12, B, "", ""), (4, None, B, "a", "b"), (5, 13, C, "", "")]
    parents = [(10, A, None, True), (11, B, None, False), (13, A, B, None)]
    assert found(spark, children, parents) == [(2, 11, "late"), (3, 12, "missing")]
    assert found(spark, children, parents, valid_to="gone") == [(2, 11, "late"), (3, 12, "missing"), (5, 13, "deleted")]


def test_copies_and_nulls(spark):
    children = [(1, 10, A, "", ""), (1, 10, A, "", ""), (1, 99, A, "", ""), (2, 10, None, "", ""), (None, 98, A, "", ""), (None, 97, A, "", "")]
    parents = [(10, B, None, True), (10, C, None, True), (None, A, None, True), (20, None, None, True)]
    assert found(spark, children, parents) == sorted([(1, 99, "missing"), (None, 97, "missing"), (None, 98, "missing")], key=str)


def test_empty_tables(spark):
    assert found(spark, [], [(1, A, None, True)]) == []
    assert found(spark, [(1, 5, A, "", "")], []) == [(1, 5, "missing")]


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100).alias("k"))
    right = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left, "k", 1000)
    assert [r._hot for r in hot.collect()] == [7]
    joined = merge_join(left, right, "k", "id", hot)
    assert joined.count() == 5000
    assert joined.where("v is null or v != 2 * k").count() == 0


def test_report(spark):
    o = orphan_references(spark.createDataFrame([(1, 5, A, "", ""), (2, 5, C, "", ""), (3, 6, C, "", "")], CHILD), spark.createDataFrame([], PARENT), "t")
    assert sorted(map(tuple, orphan_report(o).collect())) == [("t", "2024-01", "missing", 1, 1), ("t", "2024-02", "missing", 2, 2)]
