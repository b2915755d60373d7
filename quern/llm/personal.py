"""Problem 3: personal information inside free text.

Regular expressions propose spans, checksum and format validators confirm or reject them, and the words nearby raise or lower the score;
spans above the threshold are replaced by typed placeholders. One regular expression inside the JVM leaves out the texts that hold
no proposal at all; the rest is worked on in Arrow batches. The only thing learned are name parts, counted over all user names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.let import let
from quern.sources import table

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = "email", "phone", "id_number", "address", "name"
#: A span with at least this score is personal.
THRESHOLD = 0.6
#: Name parts (about 40 bytes each) that are sent to every task; where there are more, each text gets those among its words by a join.
NAME_PARTS = 50_000

# Letters of az, tr and ru as typed without their marks; each maps to one character, so places in a text stay the same.
_FROM = "ƏəĞğİıÖöŞşÜüÇçÂâÎîÛûЁё"
_TO = "eeggiioossuucc" + "aaiiuu" + "ее"
_FOLD = {ord(a): b for a, b in zip(_FROM, _TO)} | {c: chr(c).lower() for r in (range(65, 91), range(0x410, 0x430)) for c in r}


def fold(text: str) -> str:
    """Lower case without the marks of az and tr letters; as long as the text."""
    return text.translate(_FOLD)


def folded(c: Column) -> Column:
    return F.lower(F.translate(c, _FROM, _TO))


# Words before a name (folded), with the score that they give; the weak ones need a second sign.
_BEFORE = {
    0.6: ["hormetli", "hormetle,", "sayin", "saygilarimla,", "dear", "kind regards,", "best regards,", "menim adim", "benim adim", "adim",
          "my name is", "on behalf of", "the request of", "muraciet eden:", "basvuran:", "applicant:", "заявитель:", "пишу от имени:",
          "от имени:", "меня зовут", "с уважением,", "его оставляет", "уважаемый", "уважаемая"],
    0.2: ["men", "ben", "this is", "i am", "это", "salam,", "merhaba,", "hello,", "здравствуйте,"],
}
# Words after a name (folded).
_AFTER = {
    0.5: ["adindan yaziram", "adina yaziyorum", "xanimin muraciet", "beyin muraciet", "hanimin basvuru", "beyin basvuru", ", sualim var",
          ", bir sorum var", "and i have a question", ", у меня вопрос", ", muracietiniz", ", basvurunuz", ", your request",
          ", ваше обращение", ", xahis edirem", ", lutfen not", ", please note", ", запишите"],
}
# What stands where a name might and is none (folded).
_LABELS = {
    "qonaq", "guest", "misafir", "гость", "anonim", "anonymous", "user", "reader", "visitor", "okuyan", "ziyaretci", "читатель", "admin",
    "bot", "istifadeci", "kullanici", "oxucu", "silent", "mavi", "gece", "пользователь", "аноним", "test", "operator", "team",
}
# Words before an identity number (folded); the short ones only at the begin of a word.
_ID_WORDS = ["fin kod", "pasport", "pasaport", "passport", "паспорт", "vesiqe", "kimlik", "sened nomre", "id number", "identity card", "identity no", "national id", "удостоверени"]
_ID_SHORT = r"(?<![a-zа-я])(?:снилс|инн|ssn|iban|tc|t\.c\.)"
_ID_BEFORE = rf"(?:(?:{'|'.join(_ID_WORDS)})\w*|{_ID_SHORT}(?![a-zа-я]))"
_STREET = {
    "az": r"(?:kucesi|kuc\.|prospekti|pr\.|dongesi|xiyabani|sossesi|meydani)",
    "tr": r"(?:caddesi|cad\.|sokagi|sokak|sok\.|sk\.|bulvari|blv\.)",
    "ru": r"(?:улица|ул\.|проспект|просп\.|пр-т|пр\.|переулок|пер\.|бульвар|б-р|шоссе|набережная|наб\.)",
    "en": r"(?:street|st\.|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.|court|close|terrace|hill|way|row|square|boulevard)",
}
_WEAK = 0.2
#: A folded text has no proposal unless it has one of these, or a known name part beside WEAK_PROPOSALS. Each alternation is that of find() or
#: a wider one; in the JVM they are read with (?U), so that digits and white space are those of Python, and the fixed words are looked for as such.
_SHAPES = r"@|at[)\]]|\d[\d ().-]{6,18}\d|aze ?\d{8}|aa ?№ ?\d{7}|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){3}"
_PLACES = rf" (?:{_STREET['az']}|{_STREET['tr']}),? \S|\d[a-z]? \S+(?: \S+)? {_STREET['en']}"
_CUES = [w for s, ws in _BEFORE.items() if s > _WEAK for w in ws] + [w for ws in _AFTER.values() for w in ws]
PROPOSALS = "|".join([_SHAPES, _PLACES, _STREET["ru"], _ID_BEFORE, *map(re.escape, _CUES)])
#: A weak word before a name, or a line of one or two words.
_SHORT_LINE = r"(?:^|\n)[ \t]*(?:\S\. ?)?[^\s.]+(?: [^\s.]+)?[ \t]*(?:\n|$)"
WEAK_PROPOSALS = "|".join([*[re.escape(w) + r" \S" for w in _BEFORE[_WEAK]], _SHORT_LINE])

_AT = r"(?: ?@ ?| ?[\[(] ?at ?[\])] ?)"
_DOT = r"(?:\.| ?[\[(] ?dot ?[\])] ?)"
_EMAIL = re.compile(rf"[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", re.I)
_PHONE = re.compile(r"(?<![\w.-])(?:\+|00)?\(?\d[\d ().-]{6,18}\d(?![\w-])")
_ID_CUE = re.compile(_ID_BEFORE + r"(?: ?(?:no|[a-zа-я]{3,12})(?=[ :.(№#])\.?){0,3}[ :.(№#]*")
_ID_TOKEN = re.compile(r"(?:[a-z]{1,3}[ -]?№? ?)?[0-9a-z]{2,}(?:[ -]?(?:№ ?)?[0-9a-z]{2,}){0,7}", re.I)
_ID_ALONE = re.compile(r"\b(?:AZE ?\d{8}|AA ?№ ?\d{7}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?)\b")
_CARD = re.compile(r"(?<![\d.-])(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d\d[ -]?\d{6}[ -]?\d{5})(?![\d-])")
_TURKISH = re.compile(r"(?<![\w.-])[1-9]\d{10}(?![\w-])")
_W = r"[^\W\d_]+(?:['’̇-][^\W\d_]*)*"
_NUMBER = r"(?:no ?[:.]? ?|№ ?|ev |bina |дом |д\. ?)?\d{1,4}[a-zа-я]?(?:[/-]\d{1,4})?(?:,? (?:menzil|m\.|blok|daire|kat|d\.|кв\.|квартира|unit|apt\.?|flat) ?\d{1,4})?"
_ADDRESS = [
    re.compile(rf"{_W}(?: {_W})? (?:{_STREET['az']}|{_STREET['tr']}),? {_NUMBER}"),
    re.compile(rf"(?:{_STREET['ru']} ?{_W}(?: {_W})?|{_W}(?: {_W})? {_STREET['ru']}),? {_NUMBER}"),
    re.compile(rf"\b\d{{1,5}}[a-z]? {_W}(?: {_W})? {_STREET['en']}(?![\w])(?:,? (?:unit|apt\.?|flat|no\.?) ?\d+)?"),
]
_NAME_HERE = re.compile(rf"(?:[^\W\d_]\. ?)?{_W}(?: {_W})?")
_INITIAL = r"(?:(?<!\w)[^\W\d_]\. ?)?"
_NAME_BACK = re.compile(rf"(?<!\w)(?:{_INITIAL}{_W} )?{_INITIAL}{_W}$")
_CUES_BEFORE = [(s, re.compile(rf"(?<!\w){re.escape(w)} ")) for s, ws in _BEFORE.items() for w in ws]
_CUES_AFTER = [(s, re.compile((" " if w[0] != "," else "") + re.escape(w))) for s, ws in _AFTER.items() for w in ws]
_NO_PHONE = re.compile(r"(?:sifaris|siparis|order|заказ|qiymet|fiyat|price|цена|tarix|tarih|dated|дата|versiya|surum|kod|code|код)\w*(?: \w+)?[ :.#№]*$")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The checksum of international account numbers."""
    code = re.sub(r"\s", "", code).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def turkish_id(digits: str) -> bool:
    """The two check digits of an eleven-digit Turkish identity number."""
    if not re.fullmatch(r"[1-9]\d{10}", digits):
        return False
    d = [int(c) for c in digits]
    return (sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def is_phone(text: str) -> bool:
    """A number in one of the ways that phone numbers of az, tr, ru and en are written."""
    d = re.sub(r"\D", "", text)
    if text.lstrip("(").startswith("+"):
        return 10 <= len(d) <= 14
    if d.startswith("00"):
        return 12 <= len(d) <= 15
    if d.startswith("0"):
        return len(d) in (10, 11)
    if d.startswith("8"):
        return len(d) == 11
    if len(d) == 12:
        return d.startswith(("994", "90"))
    if turkish_id(d):
        return False
    american = re.fullmatch(r"1?[2-9]\d\d[2-9]\d{6}", d)
    return bool(american and re.fullmatch(r"\d+|1?[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", text.strip()))


def _id_score(token: str, cue: str = "") -> float:
    """How likely the token is an identity number, given the words for one before it ("" for none).

    A checksum decides where the shape has one: a passed one confirms without a cue, a failed one rejects in spite of it.
    """
    bare = re.sub(r"[ №-]", "", token)
    digits = re.sub(r"\D", "", bare)
    if mod97(bare) or turkish_id(bare) or (_CARD.fullmatch(token) and luhn(digits)):
        return 1.0
    turkish = re.search(r"kimlik|(?<![a-z])(?:tc|t\.c\.)", cue) and re.fullmatch(r"[1-9]\d{10}", bare)
    if turkish or re.fullmatch(r"\d{13,19}", bare) or re.fullmatch(r"[A-Z]{2}\d{2}(?=[A-Z0-9]*\d{6})[A-Z0-9]{11,30}", bare.upper()):
        return 0.0
    if cue and 5 <= len(bare) <= 20 and len(digits) >= 1:
        return 0.8 if 3 <= len(digits) or len(bare) == 7 else 0.3
    return 0.7 if _ID_ALONE.fullmatch(token) and not token[:2].isdigit() and re.match(r"AZE|AA", token) else 0.0


def _trim_token(token: str) -> str:
    """Without words that follow a number in the same run of letters."""
    m = re.match(r"(?:[A-Za-z]{1,3}[ -]?№? ?)?[0-9A-Za-z]*\d[0-9A-Za-z]*(?:[ -]?(?:№ ?)?\d[0-9A-Za-z]*)*", token)
    return m.group() if m else ""


def _name_parts(text: str) -> list[str]:
    return [fold(w.replace("̇", "")) for w in re.findall(_W, text) if len(w.replace("̇", "")) > 1]


def _is_title(word: str) -> bool:
    return word[:1].isupper()


def _name_score(text: str, parts: set[str]) -> float:
    """Shape and known parts."""
    words = _name_parts(text)
    if not words or any(w in _LABELS for w in words):
        return -1.0
    known = sum(w in parts for w in words)
    title = all(_is_title(w) for w in re.findall(_W, text))
    return 0.5 * (known > 0) + 0.2 * title - 0.3 * (not title and not known)


def find(text: str, parts: set[str], field: str = "content") -> list[tuple[int, int, str, float]]:
    """The personal spans of a text: (start, end, kind, score), in order, without overlaps."""
    f = fold(text)
    spans: list[tuple[int, int, str, float]] = []
    taken = lambda a, b: any(x < b and a < y for x, y, *_ in spans)
    if "@" in f or "at)" in f or "at]" in f:
        for m in _EMAIL.finditer(text):
            spans.append((*m.span(), EMAIL, 0.9))
    for m in _ID_CUE.finditer(f):
        if t := _ID_TOKEN.match(text, m.end()):
            token = _trim_token(t.group())
            end = t.start() + len(token)
            if token and (s := _id_score(token, m.group())) >= THRESHOLD and not taken(t.start(), end):
                spans.append((t.start(), end, ID_NUMBER, s))
    for m in _ID_ALONE.finditer(text):
        if (s := _id_score(m.group())) >= THRESHOLD and not taken(*m.span()):
            spans.append((*m.span(), ID_NUMBER, s))
    for shape in (_CARD, _TURKISH):
        for m in shape.finditer(text):
            other = is_phone(m.group()) or _NO_PHONE.search(f[max(0, m.start() - 40) : m.start()])
            if not other and _id_score(m.group()) >= THRESHOLD and not taken(*m.span()):
                spans.append((*m.span(), ID_NUMBER, 1.0))
    for r in _ADDRESS:
        for m in r.finditer(f):
            if not taken(*m.span()):
                spans.append((*m.span(), ADDRESS, 0.8))
    for m in _PHONE.finditer(text):
        if is_phone(m.group()) and not taken(*m.span()) and not _NO_PHONE.search(f[max(0, m.start() - 40) : m.start()]):
            spans.append((*m.span(), PHONE, 0.8))
    if field == "user_name":
        spans += _names_of_user(text, parts, spans)
    else:
        spans += _names_in(text, f, parts, spans)
    return sorted(spans)


def _names_in(text: str, f: str, parts: set[str], spans: list) -> list[tuple[int, int, str, float]]:
    """Names in running text: the cues before and after a candidate add up with its shape."""
    found: dict[tuple[int, int], float] = {}
    for score, cue in _CUES_BEFORE:
        for m in cue.finditer(f):
            n = _NAME_HERE.match(text, m.end())
            if not n:
                continue
            a, b = n.span()
            words = n.group().split(" ")
            known = [bool(set(_name_parts(w)) & parts) for w in words]
            if len(words) == 2 and not re.match(r"[^\W\d_]\.$", words[0]) and not known[1] and (known[0] or not _is_title(words[1])):
                after = any(c.match(f, b) for _, c in _CUES_AFTER)
                if not after or not _is_title(words[1]):
                    b = a + len(words[0])
            if not any(known) and " " not in text[a:b] and re.match(r" [^\W\d_]", text[b : b + 2]) and not any(c.match(f, b) for _, c in _CUES_AFTER):
                continue  # the next sentence follows the greeting
            found[a, b] = found.get((a, b), 0) + score
    for score, cue in _CUES_AFTER:
        for m in cue.finditer(f):
            n = _NAME_BACK.search(text, max(0, m.start() - 60), m.start())
            if not n:
                continue
            a, b = n.span()
            words = n.group().split(" ")
            if len(words) == 2 and not (set(_name_parts(words[0])) & parts) and not re.match(r"[^\W\d_]\.$", words[0]) and (not _is_title(words[0]) or fold(words[0]) in _FIRST_WORDS):
                a = b - len(words[-1])
            same = next((k for k in found if k[0] <= a < k[1] or a <= k[0] < b), None)
            if same:
                found[same] += score
            else:
                found[a, b] = found.get((a, b), 0) + score
    out = []
    for (a, b), score in found.items():
        total = score + _name_score(text[a:b], parts)
        if total >= THRESHOLD and not any(x < b and a < y for x, y, *_ in [*spans, *out]):
            out.append((a, b, NAME, total))
    # a line that is nothing but a known name
    for m in re.finditer(rf"(?m)^[ \t]*((?:[^\W\d_]\. ?)?{_W}(?: {_W})?)[ \t]*$", text):
        w = _name_parts(m.group(1))
        if w and all(x in parts for x in w) and not any(x < m.end(1) and m.start(1) < y for x, y, *_ in [*spans, *out]):
            out.append((*m.span(1), NAME, 0.7))
    return out


_FIRST_WORDS = {"men", "ben", "salam", "merhaba", "hormetli", "sayin", "dear", "hello", "это", "здравствуйте", "this", "is", "am"}


def _names_of_user(text: str, parts: set[str], spans: list) -> list[tuple[int, int, str, float]]:
    """A name in a user-name field: what is left beside other data has the shape of a name."""
    out, begin = [], 0
    for a, b, *_ in [*sorted(spans), (len(text), len(text), "", 0)]:
        piece = text[begin:a]
        m = re.search(rf"(?<![\w.@_-])(?:[^\W\d_]\. ?)?{_W}(?: {_W}){{0,2}}(?![\w@_])", piece)
        if m and not re.search(r"[_@]|\d", piece[m.start() :].split(" ")[0]):
            words = _name_parts(m.group())
            initial = bool(re.match(r"[^\W\d_]\. ?", m.group()))
            title = all(_is_title(w) for w in re.findall(_W, m.group()))
            known = sum(w in parts for w in words)
            ok = words and not any(w in _LABELS for w in words)
            if ok and (known or (title and (len(words) == 2 or initial))):
                out.append((begin + m.start(), begin + m.end(), NAME, 0.6 + 0.1 * known))
        begin = b
    return out


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with a typed placeholder in the place of each span."""
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def name_parts(feedback: DataFrame) -> DataFrame:
    """(w): given names and surnames, folded: the words of user names that are two words with capitals, if they occur twice; counted over all rows."""
    w = r"[\p{Lu}][\p{Ll}'’-]+"
    words = feedback.where(F.col("user_name").rlike(rf"^{w} {w}$")).select(F.explode(F.split(folded(F.col("user_name")), " ")).alias("w"))
    return words.groupBy("w").count().where(~F.col("w").isin(*sorted(_LABELS)) & (F.col("count") >= 2)).select("w")


_SPANS = "array<struct<start: int, end: int, kind: string, score: double>>"


def _holds(f: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: f.contains(w))


def proposed(text: Column, has_name: Column) -> Column:
    """True for a text that PROPOSALS finds something in, or WEAK_PROPOSALS if it HAS_NAME; folded once, words without a pattern."""
    fixed = [*_CUES, *_ID_WORDS, *[w.replace("\\", "") for w in _STREET["ru"][3:-1].split("|")]]
    weak = lambda f: (_holds(f, [f"{w} " for w in _BEFORE[_WEAK]]) | f.rlike(f"(?U){_SHORT_LINE}")) & F.coalesce(has_name, F.lit(False))
    return let(folded(text), lambda f: f.rlike(f"(?U){_SHAPES}") | f.rlike(f"(?U){_PLACES}") | f.rlike(_ID_SHORT) | _holds(f, fixed) | weak(f))


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(folded(text), "\u0307", ""), F.lit(r"\p{L}+(?:['’-]\p{L}*)*"), F.lit(0))


def _with_known(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """TEXTS with known: the name parts among the words of each, by a join of distinct words."""
    words = texts.select(F.xxhash64("text").alias("_h"), F.explode(F.array_distinct(_words_of(F.col("text")))).alias("w")).distinct()
    known = words.join(parts, "w").groupBy("_h").agg(F.collect_set("w").alias("known"))
    return texts.withColumn("_h", F.xxhash64("text")).join(known, "_h", "left").drop("_h")


def personal_spans(texts: DataFrame, parts: DataFrame, prefilter: bool = True, most: int = NAME_PARTS) -> DataFrame:
    """TEXTS (src_table, rec_id, field, text) with the columns spans and redacted; rows without personal data are left out.

    PARTS (w) are the known name parts: up to MOST are sent to every task as a set, beyond that each text gets its own by a join; the
    result is the same. Null and empty texts have no personal data. start and end count characters from 0. Texts of any length are searched whole.
    """
    wanted = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).select("src_table", "rec_id", "field", "text")
    few = [r.w for r in parts.limit(most + 1).collect()]
    everywhere = frozenset(few) if len(few) <= most else None
    if everywhere is None:
        wanted = _with_known(wanted, parts)
        has_name = F.size("known") > 0
    else:
        wanted = wanted.withColumn("known", F.lit(None).cast("array<string>"))
        has_name = F.exists(_words_of(F.col("text")), lambda w: w.isin(sorted(everywhere))) if everywhere else F.lit(False)
    if prefilter:
        wanted = wanted.where((F.col("field") == "user_name") | proposed(F.col("text"), has_name))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [find(t, everywhere if everywhere is not None else set() if w is None else set(w), k) for t, k, w in zip(f["text"], f["field"], f["known"])]
            hit = [i for i, s in enumerate(found) if s]
            g = f.iloc[hit].copy()
            g["redacted"] = pd.Series([redact(f["text"].iat[i], found[i]) for i in hit], dtype=object, index=g.index)
            spans = [[{"start": a, "end": b, "kind": k, "score": float(s)} for a, b, k, s in found[i]] for i in hit]
            g["spans"] = pd.Series(spans, dtype=object, index=g.index)  # of object type even if the batch has no hit
            yield g[["src_table", "rec_id", "field", "redacted", "spans"]]

    return wanted.mapInPandas(run, f"src_table string, rec_id bigint, field string, redacted string, spans {_SPANS}")


def personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rec_id, field, text) of the free texts that may hold personal data."""
    m = table(spark, sf_dir, "messages").select(F.lit("messages").alias("src_table"), F.col("id").alias("rec_id"), F.lit("content").alias("field"), F.col("content").alias("text"))
    f = table(spark, sf_dir, "chat_feedback").select(F.lit("chat_feedback").alias("src_table"), F.col("id").alias("rec_id"), F.lit("user_name").alias("field"), F.col("user_name").alias("text"))
    return m.unionByName(f)


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with personal data: its text with placeholders. Rows stored twice come out once."""
    spans = personal_spans(personal_texts(spark, sf_dir), name_parts(table(spark, sf_dir, "chat_feedback")))
    return spans.groupBy("src_table", "rec_id", "field").agg(F.min("redacted").alias("redacted"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_spans(personal_texts(spark, sf_dir), name_parts(table(spark, sf_dir, "chat_feedback")))
    return spans.select("src_table", "rec_id", F.explode("spans.kind").alias("kind")).distinct()


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
ORACLE: dict[str, str] = {}
