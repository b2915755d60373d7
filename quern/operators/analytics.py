"""Counts, series and distributions over timed rows. Every "now" is the parameter as_of; every series is filled with zeros."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.skew import beside


def counts_where(df: DataFrame, **conditions: Column | str) -> DataFrame:
    """One row with the number of rows that meet each condition, in one pass."""
    expr = lambda c: F.expr(c) if isinstance(c, str) else c
    return df.agg(*[F.count_if(expr(c)).alias(n) for n, c in conditions.items()])


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded half up; 0 where the whole is 0."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def calendar(spark: SparkSession, starts: list[datetime], fmt: str) -> DataFrame:
    """One row per bin (bin) of a short fixed series."""
    return spark.range(len(starts)).select(F.get(F.array(*[F.lit(s.strftime(fmt)) for s in starts]), F.col("id").cast("int")).alias("bin"))


def series(df: DataFrame, bin_of: Column, bins: DataFrame, value: Column, name: str) -> DataFrame:
    """(bin, NAME) for every row of BINS, 0 where nothing falls into the bin. Only counts are joined."""
    counted = df.groupBy(bin_of.alias("bin")).agg(value.alias(name))
    return F.broadcast(bins).join(counted, "bin", "left").select("bin", F.coalesce(name, F.lit(0)).alias(name))


def hourly(df: DataFrame, ts: str, as_of: datetime, days: int = 7, name: str = "n") -> DataFrame:
    """Rows per hour of the day ('HH:00', 24 rows) of the last DAYS days."""
    bins = df.sparkSession.range(24).select(F.format_string("%02d:00", F.col("id")).alias("bin"))
    recent = df.where((F.col(ts) >= F.lit(as_of - timedelta(days=days))) & (F.col(ts) < F.lit(as_of)))
    return series(recent, F.format_string("%02d:00", F.hour(ts)), bins, F.count("*"), name)


def daily(df: DataFrame, ts: str, as_of: datetime, days: int = 30, name: str = "n") -> DataFrame:
    """Rows per day of the DAYS days before the day of AS_OF, which is left out."""
    starts = [as_of.replace(hour=0, minute=0, second=0) - timedelta(days=i) for i in range(days, 0, -1)]
    recent = df.where((F.col(ts) >= F.lit(starts[0])) & (F.col(ts) < F.lit(starts[-1] + timedelta(days=1))))
    return series(recent, F.date_format(ts, "yyyy-MM-dd"), calendar(df.sparkSession, starts, "%Y-%m-%d"), F.count("*"), name)


def weekly(df: DataFrame, ts: str, as_of: datetime, value: Column, weeks: int = 8, name: str = "n") -> DataFrame:
    """VALUE per week (its Monday), the last one being the week before that of AS_OF."""
    monday = as_of.replace(hour=0, minute=0, second=0) - timedelta(days=as_of.weekday())
    starts = [monday - timedelta(weeks=i) for i in range(weeks, 0, -1)]
    recent = df.where((F.col(ts) >= F.lit(starts[0])) & (F.col(ts) < F.lit(monday)))
    return series(recent, F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"), calendar(df.sparkSession, starts, "%Y-%m-%d"), value, name)


def _month(start: datetime, back: int) -> datetime:
    m = start.year * 12 + start.month - 1 - back
    return datetime(m // 12, m % 12 + 1, 1)


def monthly(df: DataFrame, ts: str, as_of: datetime, months: int = 6, name: str = "n") -> DataFrame:
    """Rows per month, the last one being the month before that of AS_OF."""
    starts = [_month(as_of, i) for i in range(months, 0, -1)]
    recent = df.where((F.col(ts) >= F.lit(starts[0])) & (F.col(ts) < F.lit(_month(as_of, 0))))
    return series(recent, F.date_format(ts, "yyyy-MM"), calendar(df.sparkSession, starts, "%Y-%m"), F.count("*"), name)


def growth(df: DataFrame, ts: str, as_of: datetime) -> DataFrame:
    """(this_week, last_week, growth_pct): the running week against the one before; from 0 it is 100, or 0 if there is nothing."""
    monday = as_of.replace(hour=0, minute=0, second=0) - timedelta(days=as_of.weekday())
    this = (F.col(ts) >= F.lit(monday)) & (F.col(ts) < F.lit(as_of))
    last = (F.col(ts) >= F.lit(monday - timedelta(weeks=1))) & (F.col(ts) < F.lit(monday))
    n = df.agg(F.count_if(this).alias("this_week"), F.count_if(last).alias("last_week"))
    a, b = F.col("this_week"), F.col("last_week")
    pct = F.when(b > 0, F.round((a - b) * 100.0 / b, 1)).otherwise(F.when(a > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return n.withColumn("growth_pct", pct)


def minutes_between(start: str, end: str) -> Column:
    """Whole minutes from START to END, cut towards zero."""
    return F.expr(f"timestampdiff(MINUTE, {start}, {end})")


def average_duration(df: DataFrame, start: str, end: str) -> DataFrame:
    """(avg_minutes, n) of the durations above 0 and below a day; 0.0 if there are none."""
    d = minutes_between(start, end)
    good = df.select(d.alias("d")).where("d > 0 and d < 1440")
    return good.agg(F.coalesce(F.round(F.avg("d"), 1), F.lit(0.0)).alias("avg_minutes"), F.count("*").alias("n"))


#: Lower and upper edge in minutes; the last bin ends where the filter does.
DURATION_BINS = [("0-5", 0, 5), ("5-15", 5, 15), ("15-30", 15, 30), ("30-60", 30, 60), ("60+", 60, 121)]


def duration_histogram(df: DataFrame, start: str, end: str) -> DataFrame:
    """(bin, n) of durations from 0 to 120 minutes, all five bins."""
    d = F.col("d")
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(DURATION_BINS):
        label = F.when((d >= lo) & (d < hi), F.lit(name)).otherwise(label)
    found = df.select(minutes_between(start, end).alias("d")).where("d between 0 and 120")
    bins = df.sparkSession.range(5).select(F.get(F.array(*[F.lit(b[0]) for b in DURATION_BINS]), F.col("id").cast("int")).alias("bin"))
    return series(found, label, bins, F.count("*"), "n")


def response_gaps(messages: DataFrame, session: str, role: str, ts: str, key: str, most: int = 300) -> DataFrame:
    """(session, gap): seconds from a user's row to the assistant's right behind it, above 0 and below MOST. No task sorts a whole session."""
    pairs = beside(messages.select(session, role, ts, key), session, ts, key, F.struct(F.col(role).alias("role"), F.col(ts).alias("at")), "_next", ahead=True)
    gap = F.expr(f"timestampdiff(SECOND, {ts}, _next.at)")
    return pairs.where((F.col(role) == "user") & (F.col("_next.role") == "assistant")).select(session, gap.alias("gap")).where((F.col("gap") > 0) & (F.col("gap") < most))


def gap_stats(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.round(F.avg("gap"), 3).alias("avg_gap"), F.percentile("gap", 0.5).alias("median_gap"), F.min("gap").cast("bigint").alias("min_gap"), F.max("gap").cast("bigint").alias("max_gap"), F.count("*").alias("n")
    )


def topic_hits(texts: DataFrame, text: str, topics: dict[str, list[str]], top: int = 10) -> DataFrame:
    """(topic, hits, pct): rows that hold each topic's words, share of all hits; topics without hits are left out.

    All topics are counted in one pass over the rows.
    """
    lower = F.lower(text)
    hit = lambda words: F.coalesce(F.greatest(*[lower.contains(w) for w in words], F.lit(False)), F.lit(False))
    row = texts.agg(*[F.count_if(hit(words)).alias(t) for t, words in topics.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"`{t}`").alias("hits")) for t in topics])).alias("x")).select("x.*").where("hits > 0")
    total = F.sum("hits").over(Window.partitionBy())
    return long.withColumn("pct", F.round(F.col("hits") * 100.0 / total, 1)).orderBy(F.desc("hits"), "topic").limit(top)


def common_questions(messages: DataFrame, text: str, key: str, top: int = 10) -> DataFrame:
    """(question, n, example): questions by their first three words in lower case, the most frequent first."""
    q = messages.where(F.col(text).contains("?")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    words = F.split(F.lower("t"), " ")
    q = q.withColumn("w", words).where(F.size("w") >= 3).withColumn("question", F.array_join(F.slice("w", 1, 3), " "))
    by = q.groupBy("question").agg(F.count("*").alias("n"), F.min_by("t", "k").alias("example"))
    return by.orderBy(F.desc("n"), "question").limit(top)


def most_active(sessions: DataFrame, messages: DataFrame, top: int = 10) -> DataFrame:
    """(rank, user_id, sessions, messages) of the users with most messages; messages are counted per session first."""
    per = messages.where("chat_session_id is not null").groupBy("chat_session_id").agg(F.count("*").alias("m"))
    own = sessions.where("user_id is not null").select(F.col("id").alias("chat_session_id"), "user_id").distinct()
    by = own.join(per, "chat_session_id", "left").groupBy("user_id").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"))
    best = by.orderBy(F.desc("messages"), "user_id").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("messages"), "user_id")).cast("bigint").alias("rank"), "user_id", "sessions", "messages")
