"""Joins whose keys may be very unevenly filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with a larger share than 1/HOT_KEYS of the rows is always among the HOT_KEYS most frequent ones,
#: so a list of that length holds every key that could fill a task by itself.
HOT_KEYS = 256
#: Number of parts into which the rows of a hot key are divided.
SALTS = 32


def hot_keys(df: DataFrame, key: str, least: int = 20_000, most: int = HOT_KEYS) -> DataFrame:
    """The keys with at least LEAST rows, at most MOST of them, as one column ``_hot``.

    Counts are combined before the shuffle; the result has at most MOST rows whatever the input, so it may be broadcast.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_hot"))
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= least)
        .orderBy(F.desc("_n"), "_hot")
        .limit(most)
        .select("_hot")
    )


def merge_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Sort-merge join of many LEFT rows to RIGHT rows on KEY, with the hot keys of LEFT divided into SALTS parts.

    LEFT rows of a hot key are spread by the hash of the column SPREAD; the RIGHT rows of hot keys are repeated once per part.
    All other rows have the part 0 on both sides. Nothing is dropped, and only the list of hot keys is broadcast.
    """
    part = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    hot = F.broadcast(hot)
    a = left.join(hot, left[key] == hot["_hot"], "left").withColumn("_part", part).drop("_hot")
    b = right.join(hot, right[key] == hot["_hot"], "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return a.join(b.hint("merge"), [key, "_part"], how).drop("_part")


def beside(df: DataFrame, group: str, at: str, key: str, value: Column, name: str, ahead: bool = False, block: str = "hour") -> DataFrame:
    """DF with NAME: the nearest non-null VALUE before each row of its group in the order of AT and KEY, or AHEAD of it; null if there is none.

    Rows of a group are cut into blocks of time, so that no task sorts a whole group: the window runs within each block, and what comes from
    another block is found over the last (first) value of each block. Nulls in AT come first; rows with a null GROUP make a group of their own.
    """
    start = F.to_timestamp(F.lit("0001-01-01"))
    rows = df.withColumns({"_g": F.coalesce(F.hash(group), F.lit(0)), "_s": F.struct(group), "_b": F.coalesce(F.date_trunc(block, at), start), "_v": value})
    order = [F.col(at).asc_nulls_first(), F.col(key)] if not ahead else [F.col(at).desc_nulls_last(), F.col(key).desc()]
    within = Window.partitionBy("_g", "_s", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if ahead else F.max_by
    ends = rows.where("_v is not null").groupBy("_g", "_s", "_b").agg(pick("_v", F.struct(F.coalesce(at, start), key)).alias("_e"))
    blocks = rows.groupBy("_g", "_s", "_b").agg(F.count("*")).drop("count(1)").join(ends.withColumnsRenamed({"_g": "_g2", "_s": "_s2", "_b": "_b2"}), (F.col("_g") == F.col("_g2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")), "left")
    across = Window.partitionBy("_g", "_s").orderBy(F.desc("_b") if ahead else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_g").alias("_g2"), F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), F.last("_e", ignorenulls=True).over(across).alias("_o"))
    near = rows.withColumn("_n", F.last("_v", ignorenulls=True).over(within))
    joined = near.join(blocks, (F.col("_g") == F.col("_g2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")), "left")
    return joined.withColumn(name, F.coalesce("_n", "_o")).drop("_g", "_s", "_b", "_v", "_n", "_o", "_g2", "_s2", "_b2")
