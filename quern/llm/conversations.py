"""Problem 1: rebuilding conversations from message rows, as keyed streaming jobs.

Two stateful steps, one behind the other. The first is keyed by conversation and time slice: it buffers the turns of a slice, in
whatever order they arrive, until the event-time watermark passes the end of the slice, and emits the slice as one ordered list
of turns. The second is keyed by conversation: it reads those slices as a stream and keeps of each only marks (first and last turn, a
count, a few flags) until the conversation has been silent for the timeout or is closed; then it folds the marks in order of time
and emits the validated conversation. No task ever holds a whole conversation, however long. What is buffered of a turn is its
time, id, speaker and a 64-bit hash of its text; texts are joined back by id only where they are wanted. A conversation that goes on
after its timeout is emitted again as another part, and the parts are folded by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources import discard, shared_dir, table

USER, ASSISTANT, SYSTEM, UNKNOWN = 1, 2, 0, 3

# Spellings of a role, lower case, without white space.
ROLE_WORDS = {
    USER: ["user", "human", "istifadəçi", "kullanıcı", "пользователь", "client", "customer", "guest", "visitor"],
    ASSISTANT: ["assistant", "bot", "ai", "model", "asistan", "köməkçi", "ассистент", "бот", "chatbot"],
    SYSTEM: ["system", "sistem", "система"],
}
# What stands in place of words when a turn says nothing (a technical marker or an error notice), lower case, whole text.
NOTHING_SAID = (
    r"^(null|none|nil|nan|undefined|n/a|\.{2,}|…+"
    r"|http(/[0-9.]+)? ?[1-5][0-9][0-9]( [a-z ]+)?"
    r"|(internal )?(server )?error:? ?([0-9]{3}|[a-z ]*(timed out|timeout|failed|refused|unavailable|aborted|reset|exceeded|limit))"
    r"|\[(object object|stream aborted|aborted|empty|no response|no content|error|timeout|deleted|removed)\]"
    r"|<(no response|empty|null|none|error|no content|eos|pad|unk)>"
    r"|\{ ?\"error\" ?:.*\})$"
)
_BLANK = r"[\s\p{Z}\p{C}]+"
#: Slices of a conversation; a slice is the most that one state row holds.
SLICE = "1 hour"
#: How long the watermark waits for late rows.
DELAY = "10 minutes"
#: A conversation that is silent for so long is taken as closed and is emitted.
TIMEOUT = "7 days"
#: Rows without a time count as the earliest; so many ids share one slice of theirs.
UNDATED = 100_000
_END = datetime(9000, 1, 1)
# State in RocksDB, of which each batch writes what has changed and no copy of the whole.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def speaker(role: Column) -> Column:
    """The speaker code of a free-text role: user, assistant, system or unknown (also for null)."""
    word = F.lower(F.translate(F.regexp_replace(role, _BLANK, ""), "İ", "i"))
    code = F.lit(UNKNOWN)
    for k, words in ROLE_WORDS.items():
        code = F.when(word.isin(words), F.lit(k)).otherwise(code)
    return code.cast("tinyint")


def says_nothing(content: Column) -> Column:
    """True for null, for text without a visible character, and for a technical marker or error notice in place of words."""
    text = F.lower(F.trim(F.regexp_replace(content, _BLANK, " ")))
    return content.isNull() | (text == "") | ((F.length(text) <= 200) & text.rlike(NOTHING_SAID))


def turn_rows(messages: DataFrame) -> DataFrame:
    """(chat_session_id, at, turn): what the state keeps of each message; turn is null for rows of the system.

    A row without a time counts as the earliest of its conversation; such rows lie in slices of their own, by their id.
    """
    who = speaker(F.col("role"))
    turn = F.struct(
        F.col("created_at").alias("at"),
        F.col("id"),
        who.alias("speaker"),
        says_nothing(F.col("content")).alias("nothing"),
        F.xxhash64(F.regexp_replace(F.coalesce("content", F.lit("")), _BLANK, "")).alias("text"),
    )
    undated = F.timestamp_seconds(F.pmod(F.floor(F.col("id") / UNDATED), F.lit(200_000)) * 3600)  # from 1970 to 1992
    at = F.coalesce(F.col("created_at"), undated, F.timestamp_seconds(F.lit(0)))
    return messages.select("chat_session_id", at.alias("at"), F.when(who != SYSTEM, turn).alias("turn"))


def closed_slices(rows: DataFrame, delay: str = DELAY, slice_length: str = SLICE) -> DataFrame:
    """The first stateful step: (chat_session_id, slice, rows, turns), emitted when the watermark passes the end of a slice.

    Rows stored twice collapse in the set that the state keeps; rows counts them all. turns are in the order of time, then id.
    """
    return (
        rows.withWatermark("at", delay)
        .groupBy("chat_session_id", F.window("at", slice_length).alias("w"))
        .agg(F.collect_set("turn").alias("turns"), F.count("*").alias("rows"))
        .select("chat_session_id", F.col("w.start").alias("slice"), "rows", F.array_sort("turns").alias("turns"))
    )


_repeats = lambda a, b: (a["speaker"] == b["speaker"]) & (a["text"] == b["text"])
_clash = lambda a, b: (a["speaker"] == b["speaker"]) & (a["text"] != b["text"])


def slice_marks(slices: DataFrame) -> DataFrame:
    """(chat_session_id, slice, mark): of each slice what the validation needs; neighbours within it are compared in its list.

    A turn that repeats the turn directly before it (same speaker, same text) doesn't count.
    """
    t = F.col("turns")
    n = F.size(t)
    pairs = F.when(n > 1, F.arrays_zip(F.slice(t, 1, n - 1).alias("a"), F.slice(t, F.lit(2), n - 1).alias("b"))).otherwise(F.array())
    mark = F.struct(
        F.col("slice").alias("begin"),
        (n - F.size(F.filter(pairs, lambda p: _repeats(p["a"], p["b"])))).cast("bigint").alias("n_turns"),
        F.exists(t, lambda x: x["speaker"] == UNKNOWN).alias("unknown_speaker"),
        F.exists(t, lambda x: x["nothing"]).alias("empty_turn"),
        F.exists(pairs, lambda p: _clash(p["a"], p["b"])).alias("same_speaker"),
        F.when(n > 0, F.get(t, F.lit(0))).alias("first"),
        F.when(n > 0, F.get(t, n - 1)).alias("last"),
    )
    return slices.select("chat_session_id", "slice", mark.alias("mark"))


def fold_marks(marks: Column) -> Column:
    """One mark of a list of marks, in the order of their begin: the same rule for slices and for parts of a conversation."""
    no = F.lit(None).cast(_TURN)
    false = F.lit(False)
    zero = F.struct(
        F.lit(None).cast("timestamp").alias("begin"), F.lit(0).cast("bigint").alias("n_turns"), false.alias("unknown_speaker"), false.alias("empty_turn"),
        false.alias("same_speaker"), no.alias("first"), no.alias("last"),
    )
    ordered = F.array_sort(F.transform(marks, lambda m: F.struct(m["begin"].alias("o"), m.alias("m"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))

    def step(acc: Column, x: Column) -> Column:
        m = x["m"]
        again = F.coalesce(_repeats(acc["last"], m["first"]), false)
        clash = F.coalesce(_clash(acc["last"], m["first"]), false)
        joined = F.struct(
            F.coalesce(acc["begin"], m["begin"]).alias("begin"), (acc["n_turns"] + m["n_turns"] - again.cast("bigint")).alias("n_turns"),
            (acc["unknown_speaker"] | m["unknown_speaker"]).alias("unknown_speaker"), (acc["empty_turn"] | m["empty_turn"]).alias("empty_turn"),
            (acc["same_speaker"] | m["same_speaker"] | clash).alias("same_speaker"), F.coalesce(acc["first"], m["first"]).alias("first"), F.coalesce(m["last"], acc["last"]).alias("last"),
        )
        return joined

    return F.aggregate(ordered, zero, step)


def validated_parts(slices: DataFrame, timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """The second stateful step: (chat_session_id, slices, mark, whole), emitted when a conversation has been silent for TIMEOUT.

    The state of a conversation holds one mark per slice with turns, so its size is bounded by time, not by the number of rows.
    """
    rows = slice_marks(slices).withWatermark("slice", delay)
    closed = rows.groupBy("chat_session_id", F.session_window("slice", timeout)).agg(F.collect_list("mark").alias("marks"))
    out = closed.select("chat_session_id", F.size("marks").cast("bigint").alias("slices"), fold_marks(F.col("marks")).alias("mark"))
    return out.withColumn("whole", ~_broken_mark(F.col("mark")))


def _broken_mark(m: Column) -> Column:
    ends = F.coalesce((m["first"]["speaker"] == ASSISTANT) | (m["last"]["speaker"] == USER), F.lit(False))
    return (m["n_turns"] == 0) | m["unknown_speaker"] | m["empty_turn"] | m["same_speaker"] | ends


_MESSAGE = "id bigint, chat_session_id bigint, role string, content string, created_at timestamp"
_TURN = "struct<at: timestamp, id: bigint, speaker: tinyint, nothing: boolean, text: bigint>"
_SLICE = f"chat_session_id bigint, slice timestamp, rows bigint, turns array<{_TURN}>"
_PART = f"chat_session_id bigint, slices bigint, mark struct<begin: timestamp, n_turns: bigint, unknown_speaker: boolean, empty_turn: boolean, same_speaker: boolean, first: {_TURN}, last: {_TURN}>, whole boolean"


def _drain(spark: SparkSession, path: str, schema: str, closing: dict[str, object], step: Callable[[DataFrame], DataFrame], name: str, files_per_trigger: int | None = None) -> str:
    """Runs STEP over the files at PATH until all is emitted; the folder of its result.

    The closing row is written only after the last file has been taken in; the job then goes on from its checkpoint, the row's time ends
    the time of the stream, and every open state times out. Checkpoint and result lie in the shared folder, the state is RocksDB's.
    """
    ends, out, state = shared_dir(spark, f"{name}-end"), shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    fields = spark.createDataFrame([], schema).schema
    spark.createDataFrame([], fields).write.parquet(ends)
    reader = spark.readStream.schema(fields)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = step(reader.parquet(path).where("chat_session_id is not null").unionByName(spark.readStream.schema(fields).parquet(ends)))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        for last in (False, True):
            if last:
                spark.range(1).select(*[F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in fields]).coalesce(1).write.mode("append").parquet(ends)
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for folder in (ends, state):  # all is emitted, no state is left
        discard(spark, folder)
    return out


class Rebuilt(NamedTuple):
    """What the jobs emitted: the slices with their turns, and the validated conversations (or parts of them)."""

    slices: DataFrame
    parts: DataFrame


def rebuild_slices(spark: SparkSession, path: str, delay: str = DELAY, slice_length: str = SLICE, files_per_trigger: int | None = None) -> str:
    """Runs the first step over the message files at PATH until all is emitted; the folder with the slices of all conversations.

    By default the files are taken in one trigger and no row can be too late. With FILES_PER_TRIGGER the files come in the order of
    their age; rows are buffered until DELAY after the end of their slice, and a row that arrives later can't be taken in any more.
    Whether that happened is seen by counting: the slices must hold as many rows as the files, else the job fails instead of
    losing any.
    """
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be a file as well as a folder
    out = _drain(spark, files, _MESSAGE, {"role": "system", "created_at": _END}, lambda m: closed_slices(turn_rows(m), delay, slice_length), "p1-slices", files_per_trigger)
    slices = spark.read.schema(_SLICE).parquet(out).where("chat_session_id is not null")
    late = spark.read.schema(_MESSAGE).parquet(path).where("chat_session_id is not null").count() - (slices.agg(F.sum("rows")).first()[0] or 0)
    if late:
        raise RuntimeError(f"{late} message rows came later than {delay} after their slice had closed")
    return out


def rebuild(spark: SparkSession, path: str, delay: str = DELAY, slice_length: str = SLICE, timeout: str = TIMEOUT, files_per_trigger: int | None = None) -> Rebuilt:
    """Runs both steps over the message files at PATH (see rebuild_slices): slices with their turns, and validated conversations."""
    slices = rebuild_slices(spark, path, delay, slice_length, files_per_trigger)
    parts = _drain(spark, slices, _SLICE, {"slice": _END}, lambda s: validated_parts(s, timeout, delay), "p1-parts")
    known = "chat_session_id is not null"
    return Rebuilt(spark.read.schema(_SLICE).parquet(slices).where(known), spark.read.schema(_PART).parquet(parts).where(known))


def conversation_checks(parts: DataFrame) -> DataFrame:
    """One row per conversation: (chat_session_id, n_turns, unknown_speaker, empty_turn, same_speaker, starts_with_assistant, ends_with_user).

    Most conversations have one part; those that went on after their timeout have several, which are folded like slices.
    Conversations without turns have n_turns 0.
    """
    m = parts.groupBy("chat_session_id").agg(fold_marks(F.collect_list("mark")).alias("m"))
    return m.select(
        "chat_session_id", "m.n_turns", "m.unknown_speaker", "m.empty_turn", "m.same_speaker",
        F.coalesce(F.col("m.first.speaker") == ASSISTANT, F.lit(False)).alias("starts_with_assistant"), F.coalesce(F.col("m.last.speaker") == USER, F.lit(False)).alias("ends_with_user"),
    )


def is_broken(checks: DataFrame) -> Column:
    """A conversation to leave out."""
    flags = ("unknown_speaker", "empty_turn", "same_speaker", "starts_with_assistant", "ends_with_user")
    hit = F.coalesce(checks["n_turns"], F.lit(0)) == 0
    for f in flags:
        hit = hit | F.coalesce(checks[f], F.lit(False))
    return hit


def broken_conversations(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """(chat_session_id) of all conversations to leave out, of those with messages and of all rows of SESSIONS.

    A conversation is left out if it has no turns, a turn without a speaker, a turn that says nothing, two turns of one speaker in a
    row, if it begins with the assistant or ends with the user. Null session ids are none; empty tables give an empty result.
    """
    known = sessions.where("id is not null").select(F.col("id").alias("chat_session_id")).distinct()
    checks = conversation_checks(parts)
    every = checks.join(known, "chat_session_id", "full")
    return every.where(is_broken(every)).select("chat_session_id")


def conversations(rebuilt: Rebuilt, messages: DataFrame) -> DataFrame:
    """The turns of all whole conversations: (chat_session_id, slice, turn_no, message_id, speaker, content, at).

    turn_no counts from 1 within the slice; (slice, turn_no) is the order in the conversation. Repeated turns are left out.
    Texts are joined by message id from MESSAGES.
    """
    slices, checks = rebuilt.slices, conversation_checks(rebuilt.parts)
    whole = checks.where(~is_broken(checks)).select("chat_session_id")
    turns = slices.join(whole, "chat_session_id", "left_semi").select("chat_session_id", "slice", F.posexplode("turns").alias("pos", "t"))
    # across slices a repetition is found by the last turn of the slice before
    ends = slices.where(F.size("turns") > 0).select(
        "chat_session_id", "slice",
        F.lag(F.element_at("turns", -1)).over(Window.partitionBy("chat_session_id").orderBy("slice")).alias("end"),
    )
    turns = turns.join(ends, ["chat_session_id", "slice"])
    order = Window.partitionBy("chat_session_id", "slice").orderBy("pos")
    before = F.coalesce(F.lag("t").over(order), F.col("end"))
    kept = turns.withColumn("before", before).where(
        "before is null or before.speaker != t.speaker or before.text != t.text"
    )
    name = F.when(F.col("t.speaker") == USER, "user").otherwise("assistant")
    kept = kept.select(
        "chat_session_id", "slice", F.row_number().over(order).cast("bigint").alias("turn_no"), F.col("t.id").alias("message_id"), name.alias("speaker"), F.col("t.at").alias("at")
    )
    texts = messages.where("id is not null").select(F.col("id").alias("message_id"), "content").groupBy("message_id").agg(F.first("content").alias("content"))
    return kept.join(texts, "message_id").select("chat_session_id", "slice", "turn_no", "message_id", "speaker", "content", "at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_conversations(rebuild(spark, f"{sf_dir}/messages.parquet").parts, table(spark, sf_dir, "chat_sessions"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(rebuild(spark, f"{sf_dir}/messages.parquet"), table(spark, sf_dir, "messages"))


QUERIES = {"p1_found": p1_found, "p1_conversations": p1_conversations}

_IN = lambda k: ", ".join(f"'{w}'" for w in ROLE_WORDS[k])
_TURNS = f"""
with one as (
  select distinct id, chat_session_id, role, content, created_at from messages where chat_session_id is not null),
r as (
  select *, lower(replace(regexp_replace(coalesce(role, ''), '[\\s\\pZ\\pC]+', '', 'g'), 'İ', 'i')) as word,
         regexp_replace(coalesce(content, ''), '[\\s\\pZ\\pC]+', '', 'g') as bare,
         lower(trim(regexp_replace(coalesce(content, ''), '[\\s\\pZ\\pC]+', ' ', 'g'))) as plain from one),
s as (
  select *, case when word in ({_IN(USER)}) then 1 when word in ({_IN(ASSISTANT)}) then 2 when word in ({_IN(SYSTEM)}) then 0 else 3 end as who,
         plain = '' or regexp_matches(plain, '{NOTHING_SAID}') as nothing from r),
t as (
  select *, lag(who) over w as who0, lag(bare) over w as bare0 from s where who != 0
  window w as (partition by chat_session_id order by created_at nulls first, id)),
k as (select * from t where who0 is null or who0 != who or bare0 != bare),
c as (
  select chat_session_id, bool_or(who = 3) or bool_or(nothing) or bool_or(coalesce(who0 = who, false))
      or arg_min(who, (created_at, id)) = 2 or arg_max(who, (created_at, id)) = 1 as broken
  from k group by 1)
"""
ORACLE = {
    "p1_found": _TURNS
    + """select i.chat_session_id from (select chat_session_id from one union select id from chat_sessions where id is not null) i
         left join c on c.chat_session_id = i.chat_session_id where coalesce(c.broken, true)""",
    "p1_conversations": _TURNS
    + """select chat_session_id, time_bucket(interval '1 hour', created_at) as slice,
                row_number() over (partition by chat_session_id, time_bucket(interval '1 hour', created_at) order by created_at, id) as turn_no,
                id as message_id, case who when 1 then 'user' else 'assistant' end as speaker, content, created_at as at
         from k where chat_session_id in (select chat_session_id from c where not broken)""",
}
