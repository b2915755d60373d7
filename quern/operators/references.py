"""Problem 4: references whose target is absent, deleted, or came only later.

References and parent keys are partitioned and sorted alike and merged in one linear pass (a sort-merge join); each parent key
carries the interval in which it is valid, and the interval separates the kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import hot_keys, merge_join

MISSING, DELETED, LATE = "missing", "deleted", "late"


def parent_intervals(parents: DataFrame, key: str = "id", valid_from: str = "created_at", valid_to: str | None = None) -> DataFrame:
    """One row per non-null key: (ref, valid_from, valid_to, undated).

    Several rows of a key count as one record: valid from the first of them until the last of them ends.
    A null VALID_TO is an open end. A key none of whose rows has a start is ``undated``: it exists, since when is unknown.
    """
    to = F.col(valid_to) if valid_to else F.lit(None).cast("timestamp")
    return (
        parents.where(F.col(key).isNotNull())
        .select(F.col(key).alias("ref"), F.col(valid_from).alias("_from"), to.alias("_to"))
        .groupBy("ref")
        .agg(
            F.min("_from").alias("valid_from"),
            F.when(F.count("*") == F.count("_to"), F.max("_to")).alias("valid_to"),
            F.lit(True).alias("known"),
        )
    )


def _kind() -> Column:
    return (
        F.when(F.col("known").isNull(), F.lit(MISSING))
        .when(F.col("valid_from") > F.col("_at"), F.lit(LATE))
        .when(F.col("valid_to") <= F.col("_at"), F.lit(DELETED))
    )


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    child_table: str,
    child_key: str = "id",
    reference: str = "parent_id",
    at: str = "created_at",
    parent_key: str = "id",
    valid_from: str = "created_at",
    valid_to: str | None = None,
    hot_rows: int = 20_000,
) -> DataFrame:
    """One row per child with a broken reference: (child_table, child_id, ref, at, kind).

    ``missing``: no parent row has the key. ``late``: the parent became valid after the child's own time. ``deleted``: the parent's
    validity had ended by then (only if VALID_TO is given). A null reference is no case. A child without a time, or a parent without
    one, can only be ``missing``. Rows stored twice under one child key come out once; if such copies differ, ``missing`` wins over
    ``late``, and that over ``deleted``. Rows with a null child key are kept apart only by their reference, time and kind.
    Extra columns, whatever their names, are not looked at. Empty inputs give an empty result, or all ``missing``.
    """
    refs = children.where(F.col(reference).isNotNull()).select(
        F.col(child_key).alias("child_id"), F.col(reference).alias("ref"), F.col(at).alias("_at")
    )
    merged = merge_join(refs, parent_intervals(parents, parent_key, valid_from, valid_to), "ref", "child_id", hot_keys(refs, "ref", hot_rows))
    found = merged.withColumn("kind", _kind()).where("kind is not null")
    first = F.max_by(F.struct("ref", "_at", "kind"), F.struct("kind", "_at", "ref"))
    once = found.groupBy("child_id", F.when(F.col("child_id").isNull(), F.struct("ref", "_at", "kind")).alias("_own")).agg(first.alias("r"))
    return once.select(F.lit(child_table).alias("child_table"), "child_id", "r.ref", F.col("r._at").alias("at"), "r.kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, month of the referring row and kind: (child_table, month, kind, n_rows, n_refs)."""
    return orphans.groupBy("child_table", F.date_format("at", "yyyy-MM").alias("month"), "kind").agg(
        F.count("*").alias("n_rows"), F.countDistinct("ref").alias("n_refs")
    )
