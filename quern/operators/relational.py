"""Joins, ranking, pages, merges of ranked branches and keyed writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_count(df: DataFrame, key: str, many: DataFrame, foreign: str, name: str) -> DataFrame:
    """DF with the number of rows of MANY per key, 0 where there are none. MANY is counted before the join."""
    counts = many.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Rows of one page, from 1. Only the pages up to it are sorted (top-k), never the whole table."""
    rows = df.orderBy(*order).limit(number * size)
    return rows.offset((number - 1) * size) if number > 1 else rows


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """(total, last_page, first_row, last_row) beside a page."""
    n = F.count("*")
    out = df.agg(n.alias("total"))
    t = F.col("total")
    return out.select(
        "total", F.greatest(F.ceil(t / size), F.lit(1)).cast("bigint").alias("last_page"),
        F.least(F.lit((number - 1) * size + 1).cast("bigint"), t).alias("first_row"), F.least(F.lit(number * size).cast("bigint"), t).alias("last_row"),
    )


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 1) -> DataFrame:
    """The K last rows of each key by ORDER. For K = 1 an aggregate that combines before the shuffle, no window."""
    if k == 1:
        others = [c for c in df.columns if c not in keys]
        best = F.max_by(F.struct(*others), F.struct(*order, *[c for c in others if c not in order]))
        return df.groupBy(*keys).agg(best.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _without(target: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of TARGET whose KEYS aren't in KEYS_OF; nulls are equal to each other."""
    other = keys_of.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return target.join(other, same, "left_anti")


def bulk_update(df: DataFrame, condition: Column | str, **values: Column | str) -> DataFrame:
    """DF with new values (columns, or SQL) in the rows that meet CONDITION."""
    expr = lambda c: F.expr(c) if isinstance(c, str) else c
    hit = F.coalesce(expr(condition), F.lit(False))
    return df.withColumns({n: F.when(hit, expr(v)).otherwise(F.col(n)) for n, v in values.items()})


def truncate(df: DataFrame) -> DataFrame:
    """No rows, the same columns; nothing is read."""
    return df.where(F.lit(False))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """TARGET after SOURCE is written over it by KEYS (nulls are equal): rows of SOURCE win; of several with a key the last by ORDER."""
    new = newest_per_key(source, keys, order or [c for c in source.columns if c not in keys])
    return _without(target, new, keys).unionByName(new)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """TARGET and those rows of SOURCE whose key it hasn't, one per key."""
    new = newest_per_key(source, keys, order or [c for c in source.columns if c not in keys])
    return target.unionByName(new.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def delete_matching(df: DataFrame, condition: Column | str) -> DataFrame:
    """DF without the rows that meet CONDITION; rows where it is unknown stay."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(c, F.lit(False)))


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, foreign: str, condition: Column | str) -> tuple[DataFrame, DataFrame]:
    """Both tables after the parents that meet CONDITION are deleted with their children."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    gone = parents.where(c).select(F.col(key).alias(foreign)).distinct()
    return delete_matching(parents, c), children.join(gone, foreign, "left_anti")


def first_nonempty(branches: Sequence[DataFrame], group: Sequence[str] = ()) -> DataFrame:
    """The rows of the first branch that has any (per group), with its number in ``tier``: a fallback chain as one plan."""
    rows = None
    for i, b in enumerate(branches, 1):
        b = b.withColumn("tier", F.lit(i))
        rows = b if rows is None else rows.unionByName(b)
    if group:
        best = rows.groupBy(*group).agg(F.min("tier").alias("_t"))
        return rows.join(best, list(group)).where(F.col("tier") == F.col("_t")).drop("_t")
    best = F.broadcast(rows.agg(F.min("tier").alias("_t")))
    return rows.join(best, F.col("tier") == F.col("_t"), "left_semi")


def merge_ranked(branches: Sequence[tuple[DataFrame, int | None]], key: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """Branches in order of priority, each with its own limit; a key counts for its best branch only; LIMIT rows in all, with ``prio``."""
    rows = None
    for i, (b, most) in enumerate(branches, 1):
        b = (b.orderBy(*order).limit(most) if most else b).withColumn("prio", F.lit(i))
        rows = b if rows is None else rows.unionByName(b)
    best = rows.groupBy(key).agg(F.min("prio").alias("_p"))
    return rows.join(best, key).where(F.col("prio") == F.col("_p")).drop("_p").orderBy("prio", *order).limit(limit)


def keep_if_any(df: DataFrame, condition: Column, group: Sequence[str]) -> DataFrame:
    """Per group the rows that meet CONDITION, or all rows of the group if none does."""
    c = F.coalesce(condition, F.lit(False))
    flagged = df.withColumn("_ok", c)
    w = Window.partitionBy(*group)
    return flagged.withColumn("_any", F.max("_ok").over(w)).where(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], size: Column, budget: float, crossing: bool = True, block: Column | None = None) -> DataFrame:
    """Rows of each group in order while the sum of SIZE before a row is below BUDGET; without CROSSING the row must fit itself, and the first that doesn't ends it.

    BLOCK never falls along ORDER. With it no task sorts a whole group: sizes are summed per block before the shuffle, blocks behind the
    budget are left out, and the running sum goes on within each block that is left. SIZE is not negative.
    """
    base = F.lit(0)
    by = list(group)
    if block is not None:
        df = df.withColumn("_k", block)
        sums = df.groupBy(*group, "_k").agg(F.sum(size).alias("_s"))
        ahead = F.sum("_s").over(Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("_a", F.coalesce(ahead, F.lit(0)))
        sums = sums.where(F.col("_a") < budget if crossing else F.col("_a") <= budget).select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], F.col("_k").alias("_j"), "_a")
        same = F.col("_k").eqNullSafe(F.col("_j"))
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_{i}"))
        df = df.join(sums, same).drop("_j", *[f"_{i}" for i in range(len(by))])
        base, by = F.col("_a"), [*by, "_k"]
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if crossing:
        return df.withColumn("_b", F.coalesce(before, F.lit(0)) + base).where(F.col("_b") < budget).drop("_b", "_k", "_a")
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_u", upto + base).where(F.col("_u") <= budget).drop("_u", "_k", "_a")
