"""Problem 7: filling containers of fixed capacity with texts, by their size in tokens.

Items of one size are interchangeable, so the instance is its histogram: at most as many sizes as a container has tokens, however many
texts there are. On the histogram, counts and all, dominance after Martello and Toth fixes sets of items that no other filling can beat;
best fit, the largest items first, fills the containers of what is left. The result of that is a short table of patterns (so many containers, each
with so many items of these sizes). Texts are numbered within their size by distributed counts and find their container by a join.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tokens import count_tokens
from quern.sources import table, write_and_read

#: Ranks of one size are joined to the patterns in blocks of so many.
BLOCK = 256
#: Rows of a part within which texts of one size are numbered by sorting.
PART = 50_000


class _Counts:
    """Sizes that are left, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: k for s, k in counts.items() if k > 0 and s > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def largest(self, room: int) -> int:
        """The largest size of at most ROOM, or 0."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def smallest(self, but: int, k: int) -> int:
        """The joint size of the K smallest items besides one item of size BUT; a huge number if there are not so many."""
        total, left = 0, k
        for s in self.sizes:
            have = min(left, self.n[s] - (s == but))
            total += have * s
            left -= have
            if not left:
                return total
        return 1 << 60

    def best_pair(self, room: int, but: int) -> int:
        """The largest joint size of at most ROOM of two items besides one of size BUT, or 0."""
        usable = [s for s in self.sizes[: bisect_right(self.sizes, room)] if self.n[s] - (s == but) > 0]
        best, lo, hi = 0, 0, len(usable) - 1
        while lo <= hi:
            a, b = usable[lo], usable[hi]
            if a + b > room:
                hi -= 1
                continue
            if a != b or self.n[a] - (a == but) > 1:
                best = max(best, a + b)
            lo += 1
        return best


def _times(c: _Counts, pattern: dict[int, int]) -> int:
    return min(c.n[s] // k for s, k in pattern.items())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int, bool]]:
    """Patterns ({size: items}, containers, fixed by dominance) that hold all items of a histogram with sizes up to CAPACITY."""
    c = _Counts(counts)
    out: list[tuple[dict[int, int], int, bool]] = []

    def emit(pattern: dict[int, int], fixed: bool) -> None:
        m = _times(c, pattern)
        for s, k in pattern.items():
            c.take(s, k * m)
        out.append((pattern, m, fixed))

    pair = lambda a, b: {a: 2} if a == b else {a: 1, b: 1}
    changed = True
    while changed:  # what is fixed shrinks the instance, so that other sets may come to dominate
        changed = False
        for j in sorted(c.n, reverse=True):  # from the largest size
            while c.n.get(j, 0):
                room = capacity - j
                if c.smallest(j, 1) > room:
                    emit({j: 1}, True)  # nothing fits beside it
                    changed = True
                    continue
                k = c.largest(room)
                if k == j and c.n[j] == 1:
                    k = c.largest(j - 1)
                one = c.smallest(j, 2) > room  # at most one item fits beside it: the largest such dominates
                exact = k == room  # no room is left
                two = not one and not exact and c.smallest(j, 3) > room and k >= c.best_pair(room, j)  # it covers any pair
                if k and (one or exact or two):
                    emit(pair(j, k), True)
                    changed = True
                    continue
                break
    out += [(pattern, m, False) for pattern, m in best_fit(c.n, capacity)]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, the largest items first: each goes where the least room is left that holds it. Equal containers are kept as one pattern."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, pattern: dict[int, int], m: int) -> None:
        if m:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((pattern, m))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, pattern, m = capacity, {}, n
            k = room // s  # a container that took one item now has the least room for the next of that size
            full = min(m, n // k)
            put(room - k * s, pattern | {s: k}, full)
            n -= k * full
            m -= full
            if 0 < n < k and m:
                put(room - n * s, pattern | {s: n}, 1)
                n, m = 0, m - 1
            if room < capacity:
                put(room, pattern, m)
    return [x for group in open_.values() for x in group]


def _patterns(pdf: pd.DataFrame) -> pd.DataFrame:
    """The plan of one window as rows: (window_id, pattern, fixed, containers, first, size, each, rank)."""
    window, capacity = int(pdf["window_id"].iat[0]), int(pdf["capacity"].iat[0])
    rows, first, used = [], 0, {}
    for i, (pattern, m, fixed) in enumerate(plan(dict(zip(pdf["size"].astype(int), pdf["n"].astype(int))), capacity)):
        for s, k in pattern.items():
            rows.append((window, i, fixed, m, first, s, k, used.get(s, 0)))
            used[s] = used.get(s, 0) + k * m
        first += m
    return pd.DataFrame(rows, columns=["window_id", "pattern", "fixed", "containers", "first", "size", "each", "rank"])


_PLAN = "window_id int, pattern int, fixed boolean, containers bigint, first bigint, size int, each int, rank bigint"


def items_of(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, capacity, doc_id, n_tokens, size): the part of each text that is packed with others; 0 if it is nothing."""
    w = F.broadcast(windows.where("window_id is not null and capacity_tokens > 0").select("window_id", F.col("capacity_tokens").alias("capacity")).dropDuplicates(["window_id"]))
    size = F.when(F.col("n_tokens") > F.col("capacity"), F.col("n_tokens") % F.col("capacity")).otherwise(F.col("n_tokens"))
    return sizes.join(w, F.lit(True)).withColumn("size", size.cast("int"))


def pack(sizes: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers of each capacity for all texts: (assignment, plan).

    SIZES has (doc_id, n_tokens), WINDOWS (window_id, capacity_tokens). The assignment has one row per window and text, or piece of a text:
    (window_id, container, doc_id, piece, first_token, tokens). Only a text longer than the capacity is divided: into full containers of
    its own and a last piece that is packed like a text. Texts without tokens (null sizes too) have a row with a null container.
    Windows without a positive capacity are left out; of windows with one id one counts. doc_id is meant to be unique. Empty tables
    give empty results. The plan is bounded by the capacities: at most one task holds the histogram of one window.
    """
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    items = items_of(sizes, windows)
    counts = items.where("size > 0").groupBy("window_id", "capacity", "size").agg(F.count("*").alias("n"))
    patterns = write_and_read(counts.groupBy("window_id").applyInPandas(_patterns, _PLAN), "patterns")

    parts = max(1, -(-sizes.count() // PART))
    numbered = items.where("size > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    before = Window.partitionBy("window_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("window_id", "size", "part").agg(F.count("*").alias("k")).withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    own = F.row_number().over(Window.partitionBy("window_id", "size", "part").orderBy("doc_id")) - 1
    ranked = numbered.withColumn("own", own).join(offsets, ["window_id", "size", "part"]).withColumn("r", F.col("own") + F.col("offset"))

    last = F.col("rank") + F.col("containers") * F.col("each") - 1
    blocks = patterns.withColumn("last", last).withColumn(
        "block", F.explode(F.sequence(F.expr(f"rank div {BLOCK}"), F.expr(f"last div {BLOCK}")))
    )
    packed = ranked.withColumn("block", F.expr(f"r div {BLOCK}")).join(blocks, ["window_id", "size", "block"]).where("r between rank and last")
    number = F.col("first") + F.expr("(r - rank) div each")
    pieces = F.expr("if(n_tokens > capacity, n_tokens div capacity, 0)")
    packed = packed.select(
        "window_id", F.concat_ws("-", "window_id", number).alias("container"), "doc_id", pieces.cast("int").alias("piece"),
        (pieces * F.col("capacity")).alias("first_token"), F.col("size").cast("bigint").alias("tokens"),
    )
    full = items.where("n_tokens > capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.expr("n_tokens div capacity") - 1).cast("int"))))
    full = full.select(
        "window_id", F.concat_ws("-", "window_id", F.lit("full"), F.col("doc_id"), "piece").alias("container"), "doc_id", "piece",
        (F.col("piece") * F.col("capacity")).cast("bigint").alias("first_token"), F.col("capacity").cast("bigint").alias("tokens"),
    )
    none = items.where("n_tokens = 0").select(
        "window_id", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("tokens")
    )
    return packed.unionByName(full).unionByName(none), patterns


def report(assignment: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, capacity_tokens, tokens, n_containers, least_containers, fill): how full the containers are."""
    used = assignment.where("container is not null").groupBy("window_id", "container").agg(F.sum("tokens").alias("t"))
    totals = used.groupBy("window_id").agg(F.sum("t").alias("tokens"), F.count("*").alias("n_containers"))
    out = totals.join(F.broadcast(windows.select("window_id", "capacity_tokens").dropDuplicates(["window_id"])), "window_id")
    return out.select(
        "window_id", "capacity_tokens", "tokens", "n_containers",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / F.col("n_containers") / F.col("capacity_tokens"), 4).alias("fill"),
    )


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of all documents, written once, since the packing reads it several times."""
    return write_and_read(count_tokens(table(spark, sf_dir, "documents")), "sizes")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(document_sizes(spark, sf_dir), table(spark, sf_dir, "context_windows"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "context_windows")
    return report(pack(document_sizes(spark, sf_dir), windows)[0], windows)


QUERIES = {"p7_containers": p7_containers, "p7_report": p7_report}
ORACLE: dict[str, str] = {}
