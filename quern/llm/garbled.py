"""Problem 2: text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a text. It has one clean state and one state for each pair of encodings (written in
one, read in another). Each state emits a character depending on the one before it; the clean state has learned these probabilities
from all texts without anything suspect, each other state from the same texts after being garbled in its way. Tasks count pairs of
characters; as every way of garbling goes character by character, the counts of garbled texts follow from those of clean ones. The
Viterbi path is found for many texts at once in Arrow batches, each labelled span gets the inverse transform of its state.

Texts without any character (or pair of characters) that is likelier in a garbled state than in the clean one have the all-clean path;
a regular expression inside the JVM leaves them out before any row reaches Python.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import table

#: Characters whose pairs are counted at once (a longer text is counted alone).
COUNTED = 2_000_000
#: Some people write in one case: each text counts so often in upper and in lower case besides.
ONE_CASE = 1 / 8
#: Natural logarithms of entering a garbled state, of leaving it, and of changing from one to another.
ENTER, LEAVE, CHANGE = -8.0, -4.6, -13.8
#: Least probability of a character: in the clean state (any script may turn up anywhere) and in a garbled one.
UNSEEN_CLEAN, UNSEEN_GARBLED = 1e-5, 1e-8
#: The same for the replacement character and C1 controls, which no clean text has.
UNSEEN_BROKEN = 1e-14
#: Weight of the single-character distribution in that of pairs, for each SMOOTH_PER characters of training: letters that no clean text
#: has are garbled too, so it must not fade as the corpus grows.
SMOOTH, SMOOTH_PER = 4.0, 500_000
#: Characters (padded) of one Viterbi batch.
CELLS = 400_000

# A text is looked at only if it has a character outside the plain alphabets, a pair that arises from two-byte letters, Cyrillic
# letters in an odd case order, or an HTML entity.
# Arrows, signs and emoji are in none of the encodings read.
_SIGNS = (("\u2190", "\u21ff"), ("\u2600", "\u27bf"), ("\u2900", "\u297f"), ("\U0001f000", "\U0001faff"))
_PLAIN = r"\x09\x0a\x0d\x20-\x7eəğıöüşçƏĞİÖÜŞÇа-яА-ЯёЁ«»“”‘’–—…№•·©" + "".join(f"{a}-{b}" for a, b in _SIGNS)
SUSPECT = rf"[^{_PLAIN}]|[РСВ][ёЁ№«»“”‘’–—…•·©]|[а-яё][А-ЯЁ]|[А-ЯЁ]{{2}}|&[A-Za-z0-9]{{2,8}};"


def _c1(b: bytes, codec: str) -> str:
    """Bytes read in an 8-bit encoding; those without a meaning stay control characters."""
    return "".join(_TABLES[codec][x] for x in b)


def _tables() -> dict[str, list[str]]:
    t = {}
    for codec in ("cp1252", "latin-1", "cp1254", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac-roman"):
        t[codec] = [bytes([i]).decode(codec, "ignore") or chr(i) for i in range(256)]
    return t


_TABLES = _tables()
_BYTES = {codec: {c: i for i, c in reversed(list(enumerate(chars)))} for codec, chars in _TABLES.items()}

# Letters of Turkish and Azerbaijani as an 8-bit encoding has them, read in the western one.
_TURKIC = dict(zip("ışğİŞĞəƏ", "ýþðÝÞÐæÆ"))
_TURKIC_BACK = {v: k for k, v in _TURKIC.items()}


def _read(written: str, read: str) -> Callable[[str], str]:
    def garble(text: str) -> str:
        if written == "utf-8":
            return _c1(text.encode("utf-8", "ignore"), read)
        chars, known = _TABLES[read], _BYTES[written]
        return "".join(chars[known[c]] if c in known else c for c in text)

    return garble


def _lossy(text: str) -> str:
    """Bytes that the reader did not know, each as the replacement character."""
    return "".join(c if c < "\x80" else "�" * len(c.encode("utf-8", "ignore")) for c in text)


def _lossy_once(text: str) -> str:
    return "".join(c if c < "\x80" else "�" for c in text)


def _holes(text: str) -> str:
    """UTF-8 read in the western encoding where bytes without a meaning became the replacement character."""
    return re.sub("[\x80-\x9f]", "�", _c1(text.encode("utf-8", "ignore"), "cp1252"))


def _back(written: str, read: str) -> Callable[[str], str]:
    """The inverse of _read; characters that can't be part of the garbling stay."""
    known = _BYTES[read]
    if written != "utf-8":
        chars, k2 = _TABLES[written], known
        return lambda s: "".join(chars[k2[c]] if c in k2 else c for c in s)

    def restore(s: str) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            out.append(run.decode("utf-8", "replace"))
            run.clear()

        for c in s:
            if c in known:
                run.append(known[c])
            elif c == "�":
                run.append(0xFF)
            else:
                flush()
                out.append(c)
        flush()
        return re.sub("�+", "�", "".join(out))

    return restore


def _lowered(garble: Callable[[str], str]) -> Callable[[str], str]:
    return lambda t: garble(t).lower()


def _raise_lead(s: str) -> str:
    """Undoes the lower case of the first byte of two-byte letters, where a second byte follows it."""
    up = lambda m: m.group(1).upper() + ("Ÿ" if m.group(2) == "ÿ" else "Œ" if m.group(2) == "œ" else m.group(2))
    return re.sub("([ãäåéæâðñ])([\x80-¿ÿœžšƒ‚„…†‡ˆ‰‹‘’“”•–—˜™›€])", up, s)


@dataclass(frozen=True)
class Pair:
    """One garbled state: how texts get into it and how they come back."""

    name: str
    garble: tuple[Callable[[str], str], ...]
    restore: Callable[[str], str]


def _pairs() -> list[Pair]:
    u = lambda read: Pair(f"utf-8 as {read}", (_read("utf-8", read), _lowered(_read("utf-8", read))), _back("utf-8", read))
    w = _read("utf-8", "cp1252")
    turkic = lambda t: t.translate(str.maketrans(_TURKIC))
    back = _back("utf-8", "cp1252")
    return [
        Pair("utf-8 as cp1252", (w, _holes), back),
        *(u(x) for x in ("latin-1", "cp1254", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac-roman")),
        Pair("utf-8 as cp1252, twice", (lambda t: w(w(t)),), lambda s: back(back(s))),
        Pair("utf-8 as latin-1, twice", (lambda t: _read("utf-8", "latin-1")(_read("utf-8", "latin-1")(t)),), lambda s: _back("utf-8", "latin-1")(_back("utf-8", "latin-1")(s))),
        Pair("utf-8 as cp1252, lower case", (_lowered(w),), lambda s: back(_raise_lead(s))),
        Pair("utf-8 as cp1252, twice, lower case", (_lowered(lambda t: w(w(t))),), lambda s: back(back(_raise_lead(s)))),
        Pair("cp1254 as cp1252", (turkic,), lambda s: s.translate(str.maketrans(_TURKIC_BACK))),
        Pair("cp1251 as cp1252", (_read("cp1251", "cp1252"), _lowered(_read("cp1251", "cp1252"))), _back("cp1251", "cp1252")),
        Pair("koi8-r as cp1251", (_read("koi8-r", "cp1251"),), _back("koi8-r", "cp1251")),
        Pair("cp1251 as koi8-r", (_read("cp1251", "koi8-r"),), _back("cp1251", "koi8-r")),
        Pair("cp1251 as cp866", (_read("cp1251", "cp866"),), _back("cp1251", "cp866")),
        Pair("cp1252 as latin-1", (lambda t: re.sub("[“”‘’–—…„€™•]", lambda m: chr(_BYTES["cp1252"][m.group()]), t),), lambda s: "".join(_TABLES["cp1252"][ord(c)] if "\x80" <= c <= "\x9f" else c for c in s)),
        Pair("lost bytes", (_lossy, _lossy_once), lambda s: s),
    ]


PAIRS = _pairs()


@dataclass
class Model:
    """index: character -> column (0: any other; all signs share one); log: natural logarithm of P(character | the one before, state), by
    pair of columns."""

    index: dict[str, int]
    log: np.ndarray

    @property
    def width(self) -> int:
        return math.isqrt(len(self.log))

    def columns(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.index.get, text, [0] * len(text)), dtype=np.int32, count=len(text))


#: All ways of garbling, with the number of their state.
_WAYS = [(k, g) for k, p in enumerate(PAIRS, 1) for g in p.garble]


@functools.lru_cache(None)
def _changed_by(char: str) -> int:
    """The ways of garbling that change a character, as bits."""
    return sum(1 << i for i, (_, g) in enumerate(_WAYS) if g(char) != char)


def counts(texts: list[str]) -> pd.DataFrame:
    """(ways, before, after, n): how often a pair of characters is in TEXTS, each between spaces, by the ways that change its text."""
    out, begin = [], 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= COUNTED):
            size += len(texts[end])
            end += 1
        sizes = np.array([len(t) + 2 for t in texts[begin:end]])
        x = np.frombuffer("".join([" " + t + " " for t in texts[begin:end]] + [" "]).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        begin = end
        seen = np.flatnonzero(np.bincount(x))
        bits = np.zeros(seen[-1] + 1, dtype=np.int64)
        bits[seen] = [_changed_by(chr(c)) for c in seen]
        ways, of_text = np.unique(np.bitwise_or.reduceat(bits[x[:-1]], np.cumsum(sizes) - sizes), return_inverse=True)
        key, n = np.unique(np.repeat(of_text, sizes) << 42 | x[:-1] << 21 | x[1:], return_counts=True)
        out.append(pd.DataFrame({"ways": ways[key >> 42], "before": key >> 21 & 0x1FFFFF, "after": key & 0x1FFFFF, "n": n}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("ways", "before", "after", "n")})


def train(texts: list[str]) -> Model:
    """Learns the emission probabilities of all states from clean texts."""
    return learn(counts(texts))


def _fold(text: str) -> str:
    """Each sign as the same one."""
    return "".join(_SIGNS[0][0] if any(a <= c <= b for a, b in _SIGNS) else c for c in text)


def learn(found: pd.DataFrame) -> Model:
    """The emission probabilities of all states from the counts of clean texts."""
    ways, n = found["ways"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    points, at = np.unique(np.concatenate([found["before"], found["after"]]).astype(np.int64), return_inverse=True)
    chars, (before, after) = [chr(c) for c in points], at.reshape(2, -1)
    # each version of the texts: its state, the text of each character, the weight of each pair
    versions = [(0, str, n), (0, str.upper, n * ONE_CASE), (0, str.lower, n * ONE_CASE)]
    versions += [(k, g, np.where(ways >> i & 1, n, 0.0)) for i, (k, g) in enumerate(_WAYS)]
    versions = [(k, [_fold(g(c)) for c in chars], w) for k, g, w in versions]
    used = [np.bincount(np.concatenate([before, after]), np.concatenate([w, w]), len(chars)) > 0 for *_, w in versions]
    seen = sorted({" "}.union(*(x for (_, made, _), u in zip(versions, used) for x, y in zip(made, u) if y)))
    index = {c: i + 1 for i, c in enumerate(seen)}
    a = len(index) + 1
    logs = np.empty((a * a, len(PAIRS) + 1), dtype=np.float32)
    smooth = SMOOTH * max(1.0, n.sum() / SMOOTH_PER)
    for k in range(len(PAIRS) + 1):
        pairs = np.zeros(a * a)
        for state, made, w in versions:
            if state != k:
                continue
            first, last = (np.array([index.get(x[i], 0) for x in made], dtype=np.int64) for i in (0, -1))
            pairs += np.bincount(last[before] * a + first[after], w, a * a)
            single = np.bincount(after, w, len(chars))
            for j in np.flatnonzero(single):
                for x, y in zip(made[j], made[j][1:]):
                    pairs[index[x] * a + index[y]] += single[j]
            if not w.any():
                pairs[index[" "] * (a + 1)] += 1
        pairs = pairs.reshape(a, a)
        single = pairs.sum(0)
        floor = np.full(a, UNSEEN_GARBLED)
        if k == 0:
            floor = np.array([UNSEEN_CLEAN, *(UNSEEN_BROKEN if "\x80" <= c <= "\x9f" or c == "�" else UNSEEN_CLEAN for c in seen)])
        p1 = single / max(single.sum(), 1)
        log = np.log((pairs + smooth * p1[None, :]) / (pairs.sum(1, keepdims=True) + smooth) + floor[None, :])
        if k:  # characters that the garbling leaves alone but for their case say nothing, next to each other
            to = {c: _fold(PAIRS[k - 1].garble[0](c)) for c in seen}
            made = set().union(*(set(x) for c, x in to.items() if x.lower() != c.lower()))
            # and one 8-bit alphabet read as another shows in its letters, not in bullets and quotes
            mute = set() if PAIRS[k - 1].name.startswith(("utf-8", "lost", "cp1252")) else {c for c in seen if not c.isalpha() and not "\x7f" < c < "\xa0" and c != "�"}
            same = np.array([False, *(c in mute or to[c] == c and c not in made for c in seen)])
            log = np.where(same[:, None] & same[None, :], clean, log)
        else:
            clean = log
        logs[:, k] = log.reshape(-1)
    if sign := index.get(_SIGNS[0][0]):
        index.update((chr(c), sign) for x, y in _SIGNS for c in range(ord(x), ord(y) + 1))
    return Model(index, logs)


def viterbi(model: Model, texts: list[str]) -> list[np.ndarray | None]:
    """The state of each character of each text; None where all are clean."""
    out: list[np.ndarray | None] = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    begin = 0
    while begin < len(order):
        end, longest = begin, 0
        while end < len(order):
            longest = max(longest, len(texts[order[end]]), 1)
            if end > begin and longest * (end - begin + 1) > CELLS:
                break
            end += 1
        group = order[begin:end]
        begin = end
        _viterbi(model, texts, group, out)
    return out


def _viterbi(model: Model, texts: list[str], group: list[int], out: list) -> None:
    a, states = model.width, model.log.shape[1]
    longest = max(len(texts[i]) for i in group)
    n = len(group)
    chars = np.full((longest + 1, n), model.index.get(" ", 0), dtype=np.int32)
    for j, i in enumerate(group):
        chars[1 : len(texts[i]) + 1, j] = model.columns(texts[i])
    size = np.array([len(texts[i]) for i in group])
    score = np.full((n, states), ENTER, dtype=np.float32)
    score[:, 0] = 0
    came = np.empty((longest, n, states), dtype=np.uint8)  # the state before
    own = np.arange(states, dtype=np.uint8)
    for t in range(longest):
        best_k = score[:, 1:].argmax(1) + 1
        best = np.take_along_axis(score, best_k[:, None], 1)[:, 0]
        jump = np.maximum(score[:, 0] + ENTER, best + CHANGE)
        source = np.where(score[:, 0] + ENTER >= best + CHANGE, 0, best_k).astype(np.uint8)
        stay = score >= jump[:, None]
        stay[:, 0] = score[:, 0] >= best + LEAVE
        into = np.where(stay, score, jump[:, None])
        into[:, 0] = np.where(stay[:, 0], score[:, 0], best + LEAVE)
        source = np.where(stay, own[None, :], source[:, None])
        source[:, 0] = np.where(stay[:, 0], 0, best_k)
        came[t] = source
        new = into + model.log[chars[t] * a + chars[t + 1]]
        score = np.where((t < size)[:, None], new, score)  # texts that are over keep their score
        if t % 64 == 0:
            score -= score.max(1, keepdims=True)
    last = score.argmax(1)
    path = np.zeros((longest, n), dtype=np.uint8)
    rows = np.arange(n)
    for t in range(longest - 1, -1, -1):
        live = t < size
        path[t] = np.where(live, last, 0)
        last = np.where(live, came[t, rows, last], last)
    for j, i in enumerate(group):
        p = path[: size[j], j]
        if p.any():
            out[i] = p


def unescaped(text: str) -> str:
    """HTML entities as characters, twice escaped ones too."""
    if "&" not in text:
        return text
    once = html.unescape(text)
    return html.unescape(once) if "&" in once else once


def _broken(text: str) -> bool:
    return any(c == "�" or "\x80" <= c <= "\x9f" for c in text)


def _inverse(text: str, state: int, model: Model) -> str:
    """The inverse transform of the span's state. Where that leaves broken characters, a byte was lost or the span holds several ways of
    garbling: then, of the inverses of the states for UTF-8, the one whose result the clean state finds likeliest."""
    own = PAIRS[state - 1].restore(text)
    if not _broken(own) or not PAIRS[state - 1].name.startswith("utf-8"):
        return own

    def clean(x: str) -> float:
        at = model.columns(f" {x} ")
        return float(model.log[at[:-1] * model.width + at[1:], 0].sum()) + np.log(UNSEEN_BROKEN) * sum(map(_broken, x))

    return max([own, *(p.restore(text) for p in PAIRS if p.name.startswith("utf-8"))], key=clean)


def restored(text: str, path: np.ndarray, model: Model) -> str:
    """Each garbled span by the inverse transform of its state."""
    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(text)]
    return "".join(text[i:j] if path[i] == 0 else _inverse(text[i:j], int(path[i]), model) for i, j in zip(cuts, cuts[1:]))


def text_fields(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("messages", "knowledge_base", "chat_sessions")) -> DataFrame:
    """(src_table, rec_id, field, text) of all texts that may be garbled, of the TABLES named."""
    fields = [("messages", "content"), ("knowledge_base", "title"), ("knowledge_base", "content"), ("chat_sessions", "title")]
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("src_table"), F.col("id").alias("rec_id"), F.lit(f).alias("field"), F.col(f).alias("text"))
        for t, f in fields
        if t in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield counts(f["text"].tolist())


def fit(texts: DataFrame) -> Model:
    """Trains on all texts that have nothing suspect. Only counts leave the tasks: a row for each pair of plain characters and set of
    ways of garbling that change the text."""
    plain = texts.where(F.col("text").isNotNull() & ~F.col("text").rlike(SUSPECT)).select("text")
    found = plain.mapInPandas(_count, "ways bigint, before bigint, after bigint, n bigint")
    return learn(found.groupBy("ways", "before", "after").agg(F.sum("n").alias("n")).toArrow().to_pandas())


def label(texts: DataFrame, model: Model, prefilter: bool = True) -> DataFrame:
    """The garbled ones of TEXTS (src_table, rec_id, field, text): (src_table, rec_id, field, restored, pairs).

    pairs: the names of the encoding pairs found. Null and empty texts are never garbled. Rows stored twice come out once; if copies of
    a record differ, one of the garbled ones comes out. Texts may be of any length: each is labelled as a whole.
    Without PREFILTER all texts go through the model; the result is the same (a test compares both on whole tables).
    """
    wanted = F.col("text").rlike(SUSPECT) if prefilter else F.col("text").isNotNull()
    suspects = texts.where(wanted).select("src_table", "rec_id", "field", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            plain = [unescaped(t) for t in f["text"]]
            paths = viterbi(model, plain)
            hit = [i for i, p in enumerate(paths) if p is not None]
            g = f.iloc[hit][["src_table", "rec_id", "field"]].copy()
            g["restored"] = pd.Series([restored(plain[i], paths[i], model) for i in hit], dtype=object, index=g.index)
            g["pairs"] = pd.Series([[PAIRS[k - 1].name for k in np.unique(paths[i]) if k] for i in hit], dtype=object, index=g.index)
            yield g  # of object type even if the batch has no hit

    found = suspects.mapInPandas(run, "src_table string, rec_id bigint, field string, restored string, pairs array<string>")
    return found.groupBy("src_table", "rec_id", "field").agg(F.min(F.struct("restored", "pairs")).alias("r")).select(
        "src_table", "rec_id", "field", "r.restored", "r.pairs"
    )


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = text_fields(spark, sf_dir)
    return label(texts, fit(texts))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_restored(spark, sf_dir).select("src_table", "rec_id", "field")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
ORACLE: dict[str, str] = {}
