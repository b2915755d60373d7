"""Text functions as Column expressions: folding, scripts, keywords, intents, trimming, quality."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.let import let

# Az and tr letters and what they fold to.
FOLD_FROM, FOLD_TO = "əƏıİşŞçÇöÖüÜğĞ", "eeiissccoouugg"
# Arabic terms and their Latin forms.
ARABIC = {"وضوء": "wudu", "صلاة": "salat", "صوم": "sawm", "زكاة": "zakat"}
# Words that are no keywords (short list, long list).
STOP_SHORT = ["və", "ve", "ile", "ilə", "üçün", "the", "and", "or", "for", "with"]
STOP_LONG = [
    "ve", "və", "ki", "da", "də", "ile", "ilə", "için", "üçün", "bu", "o", "bir", "mi", "mu", "mı", "mü", "ne", "nə", "nasıl", "necə", "hangi", "hansı",
    "the", "and", "or", "for", "with", "about", "how", "what", "which", "who", "when", "where", "why",
    "و", "في", "من", "على", "الى", "عن", "ما", "كيف", "متى", "أين", "اي", "که", "در", "با", "از", "برای", "چی", "چه",
]
# Endings that are cut from words.
SUFFIXES = ["ın", "in", "un", "ün", "nın", "nin", "nun", "nün", "ı", "i", "u", "ü", "a", "ə", "da", "də", "dan", "dən"]
# Variants of a word (simple search), and synonyms (smart search).
VARIANTS = {
    "vitr": ["vitr", "witir", "witr"],
    "rükət": ["rükət", "rukət", "ruket", "rakat", "raket"],
    "namaz": ["namaz", "salat", "salah"],
    "qunut": ["qunut", "qunut duası", "dua", "namazda qunut"],
    "dəstəmaz": ["dəstəmaz", "destemaz", "destamaz", "abdest", "wudu", "wudhu", "vuzu", "təharət", "teharet"],
    "abdest": ["abdest", "dəstəmaz", "destemaz", "wudu", "vuzu", "təharət"],
}
SYNONYMS = {
    "dəstəmaz": ["destamaz", "abdest", "vuzu", "wudu", "wudhu", "وضوء"],
    "abdest": ["dəstəmaz", "destamaz", "vuzu", "wudu", "wudhu", "وضوء"],
    "wudu": ["dəstəmaz", "abdest", "vuzu", "wudhu", "وضوء"],
    "vuzu": ["dəstəmaz", "abdest", "wudu", "wudhu", "وضوء"],
    "وضوء": ["dəstəmaz", "abdest", "wudu", "wudhu", "vuzu"],
    "namaz": ["salat", "prayer", "صلاة"],
    "salat": ["namaz", "prayer", "صلاة"],
    "صلاة": ["namaz", "salat", "prayer"],
    "oruc": ["sawm", "roza", "صوم"],
    "sawm": ["oruc", "roza", "صوم"],
    "صوم": ["oruc", "sawm", "roza"],
    "zəkat": ["zekat", "zakat", "زكاة"],
    "zekat": ["zəkat", "zakat", "زكاة"],
    "زكاة": ["zəkat", "zekat", "zakat"],
}
# Cues of a question, of talk about the service, of the service's field, and of other fields.
QUESTION_CUES = ["necə", "nece", "nədir", "nedir", "niyə", "niye", "hara", "hardadir", "olarmı", "olarmi", "düzdürmü", "duzdurmu", "mü", "mi", "mu", "mı"]
META_CUES = [
    "sen yalniz", "sən yalniz", "sən yalnız", "sen sadece", "yalniz serif", "yalniz şeri", "yalnız şəri", "yalnız şəriət", "yalniz serif sual", "yalnız şəriət sual",
    "sen ne edirs", "sən nə edirs", "sen ne is gorurs", "sən nə iş görürs", "sen kims", "sən kims", "kimsən sen", "bot san", "botsan", "chatbot", "çatbot", "ai botu", "ai bot",
    "nə edə bilirsən", "ne ede bilirs", "nə iş görürsən",
]
FIELD_TERMS = [
    "destemaz", "deste maz", "dəstəmaz", "abdest", "wudu", "vudu", "vuzu", "gusl", "qusl", "qüsl", "ghusl", "boyuk teheret", "böyük təhar", "teyemmum", "təyəmmüm",
    "namaz", "salat", "salah", "ibadet", "ibadət", "oruc", "siyam", "ruze", "ruzə", "zekat", "zəkat", "sadaka", "sədəqə", "hecc", "həcc", "hac", "qurban", "qurbani",
    "fiqh", "fiqhi", "fıqh", "şəriət", "seriet", "shariat", "sharia", "halal", "haram", "mekruh", "məkruh", "mubah", "mübah", "necaset", "nəcasət", "napak", "murdar",
    "qible", "qiblə", "kible", "dua", "qunut", "qunut duas", "cuma namazi", "cümə namaz",
]
OTHER_TERMS = [
    "php", "javascript", "python", "java", "css", "html", "react", "laravel", "server", "database", "mysql", "postgres", "mongodb", "api", "frontend", "backend",
    "bitcoin", "btc", "eth", "ethereum", "kripto", "crypto", "dollar", "usd", "eur", "seo", "marketing", "reklam", "smm",
]
# Greetings, questions after one's health, and thanks.
SHORT_GREETINGS = ["salam", "salamlar", "selam", "merhaba", "hello", "hi", "hey", "saqol", "sag ol", "sağ ol", "tesekkur", "tesekkurler", "təşəkkür"]
GREETING = r"^(salam|selam|salam aleykum|salamun aleykum|salamün aleykum|merhaba|hello|hi|hey)[.!?\s]*$"
WELLBEING = r"(necesen|haliniz necedir|hal-?iniz necedir)"
THANKS = r"^(tesekkur|tewekkur|sag ol|minnetdar(am)?)[.!?\s]*$"


def fold(c: Column) -> Column:
    """Without the marks of az and tr letters; case is kept only in other letters."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD), for which Spark has no function."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def fold_all(c: Column) -> Column:
    """fold(), and all other letters decomposed and without combining marks."""
    return F.regexp_replace(decomposed(fold(c)), r"\p{Mn}+", "")


def source_lines(c: Column, label: str = "Təlimat bazası", closed: bool = True) -> Column:
    """Lines that name a source with "Mənbə:" in bold: addresses stay as they are, training entries become LABEL.

    If the sources are CLOSED, LABEL takes the place of every other source too, and of bulleted lists of sources; else those stay, in bold. Lines
    that are bold already stay as they are.
    """
    bold = f"**Mənbə:** {label}"
    c = F.regexp_replace(c, r"(?<!\*)Mənbə:\s*Q&A Training[^\n]*", bold)
    c = F.regexp_replace(c, r"(?<!\*)Mənbə:\s*(https?://\S+)", "**Mənbə:** $1")
    if not closed:
        return F.regexp_replace(c, r"(?<!\*)Mənbə:\s*([^\n]+)", "**Mənbə:** $1")
    c = F.regexp_replace(c, r"(?<!\*)Mənbə:\s*(?![^\n]*https?://)[^\n]+", bold)
    return F.regexp_replace(c, r"(?miu)^\s*+(?:Mənbələr|Əsas mənbələr|Rəvayət mənbələri):?[^\S\n]*(?:\n\s*[-•].*)+", bold)


def search_form(c: Column) -> Column:
    """For comparison: folded, lower case, Arabic terms in Latin letters, composed accents kept, separate combining marks removed."""
    t = F.lower(fold(c))
    for a, b in ARABIC.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"\p{Mn}+", "")


def script(c: Column) -> Column:
    """arabic, cyrillic, latin, mixed (more than one) or unknown."""
    has = [c.rlike(r"\p{IsArabic}"), c.rlike(r"\p{IsCyrillic}"), c.rlike("[A-Za-zÇƏĞIİÖŞÜçəğıiöşü]")]
    n = has[0].cast("int") + has[1].cast("int") + has[2].cast("int")
    return F.when(n > 1, "mixed").when(has[0], "arabic").when(has[1], "cyrillic").when(has[2], "latin").otherwise("unknown")


def _lookup(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _tokens(c: Column, least: int, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(F.translate(c, "İ", "i")), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop))


def _expand(words: Column, table: dict[str, list[str]]) -> Column:
    more = _lookup(table)
    return F.array_distinct(F.flatten(F.transform(words, lambda t: F.concat(F.array(t), F.coalesce(more[t], F.array().cast("array<string>"))))))


def keywords_simple(c: Column, most: int = 12) -> Column:
    """Words of three letters and more with their stems and variants, in order, at most MOST."""
    words = _tokens(c, 3, STOP_SHORT)
    ends = F.array(*map(F.lit, SUFFIXES))

    def stems(t: Column) -> Column:
        cut = F.filter(ends, lambda s: t.endswith(s) & (F.length(t) - F.length(s) >= 3))
        return F.concat(F.array(t), F.transform(cut, lambda s: F.substring(t, F.lit(1), F.length(t) - F.length(s))))

    return F.slice(_expand(F.flatten(F.transform(words, stems)), VARIANTS), 1, most)


def by_length(words: Column) -> Column:
    """Distinct words, the longest first; the order in the text decides between equals."""
    placed = F.transform(words, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))
    return F.array_distinct(F.transform(F.array_sort(placed), lambda x: x["t"]))


def keywords_smart(c: Column) -> Column:
    """Words of two letters and more without stop words, the longest first, each followed by its synonyms."""
    return _expand(by_length(_tokens(c, 2, STOP_LONG)), SYNONYMS)


def contains_any(c: Column, words: list[str]) -> Column:
    """True if the text holds one of the words. C should be a column or a value named by let(), as it is looked at once per word."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))


def is_small_talk(c: Column) -> Column:
    """Nothing but a greeting or thanks, or a question after one's health."""
    return let(F.lower(fold(F.trim(c))), lambda t: _small_talk(c, t))


def _small_talk(c: Column, t: Column) -> Column:
    short = (F.length(t) <= 12) & ~c.contains("?") & t.isin(SHORT_GREETINGS)
    return (t != "") & (t.rlike(GREETING) | t.rlike(WELLBEING) | t.rlike(THANKS) | short)


def intent(c: Column) -> Column:
    """SMALL_TALK, META, FIQH_QUESTION or OUT_OF_SCOPE by rules; cues are looked for inside words too."""
    return let(F.lower(fold(F.trim(c))), lambda t: _intent(c, t))


def _intent(c: Column, t: Column) -> Column:
    question = c.contains("?") | contains_any(t, QUESTION_CUES)
    field = contains_any(t, FIELD_TERMS)
    return (
        F.when((t == "") | _small_talk(c, t), "SMALL_TALK")
        .when(contains_any(t, META_CUES), "META")
        .when(question & field, "FIQH_QUESTION")
        .when(contains_any(t, OTHER_TERMS) | question, "OUT_OF_SCOPE")
        .otherwise("SMALL_TALK")
    )


def is_howto(c: Column) -> Column:
    """Asks how something is done."""
    t = F.lower(c)
    return t.contains("necə") | t.contains("qayda") | t.contains("addım")


def collapse_space(c: Column) -> Column:
    """At most one blank line, single spaces, none at line ends, one after a full stop before a capital."""
    t = F.regexp_replace(c, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
    t = F.regexp_replace(t, r"\.([A-ZÇƏĞIİÖŞÜ])", ". $1")
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))


def limit(c: Column, n: int) -> Column:
    """The first N characters and '...', if there are more."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)


def ends_sentence(c: Column) -> Column:
    return c.rlike(r"[.!?…]\s*$")


def trim_to_sentence(c: Column, most: int) -> Column:
    """At most MOST characters, cut behind the last sentence end; a text without one (but at its first place) is only cut."""
    cut = F.substring(c, 1, most)
    whole = (F.length(c) <= most) & ends_sentence(c)
    head = F.regexp_extract(cut, r"(?s)^(.+[.!?…\n])", 1)
    right = lambda x: F.regexp_replace(x, r"\s+$", "")
    return F.when(whole, c).when(head != "", right(head)).otherwise(right(cut))


def truncate_smart(c: Column, target: int) -> Column:
    """About nine tenths of TARGET, cut at a sentence, else at a line, else at a word, with '...' if not at a sentence."""
    at = int(target * 0.9)
    t = F.substring(c, 1, at)
    last = lambda x: F.length(t) - F.locate(x, F.reverse(t))  # noqa: E731  the place from 0; the text's length if there is none
    has = lambda x, share: (F.locate(x, F.reverse(t)) > 0) & (last(x) > at * share)
    to = lambda n: F.substring(t, F.lit(1), n)
    dots = lambda x: F.concat(x, F.lit("..."))
    cut = F.when(has(".", 0.7), to(last(".") + 1)).when(has("\n", 0.8), dots(to(last("\n")))).when(has(" ", 0.85), dots(to(last(" ")))).otherwise(dots(t))
    return F.when(F.octet_length(c) <= target, c).otherwise(F.trim(cut))


def quality(c: Column) -> Column:
    """low, medium, high or excellent, by the number of bytes."""
    n = F.octet_length(c)
    return F.when(n < 500, "low").when(n < 2000, "medium").when(n < 5000, "high").otherwise("excellent")


def csv_cell(c: Column) -> Column:
    """A quoted cell: no tags, quotes doubled, white space collapsed; null, '' and '0' are the empty cell."""
    t = F.regexp_replace(c, "<[^>]*>", "")
    t = F.trim(F.regexp_replace(F.replace(t, F.lit('"'), F.lit('""')), r"\s+", " "))
    return F.when(c.isNull() | c.isin("", "0"), F.lit('""')).otherwise(F.concat(F.lit('"'), t, F.lit('"')))


def mojibake_score(c: Column) -> Column:
    """(letters, markers, question_marks, lost): what speaks for and against a text being decoded well."""
    return F.struct(
        F.regexp_count(c, F.lit("[əğıöüşçƏĞİÖÜŞÇ]")).alias("letters"), F.regexp_count(c, F.lit("[ÃÄÅÂÉ]")).alias("markers"),
        F.regexp_count(c, F.lit(r"\?")).alias("question_marks"), F.regexp_count(c, F.lit("�")).alias("lost"),
    )


def better_variant(a: Column, b: Column) -> Column:
    """Of two readings of a text the one with more native letters, then fewer markers, fewer lost characters, fewer question marks."""
    key = lambda x: (lambda s: F.struct(s["letters"], -s["markers"], -s["lost"], -s["question_marks"]))(mojibake_score(x))
    return F.when(key(b) > key(a), b).otherwise(a)


def is_corrupted(c: Column) -> Column:
    """Holds what well decoded text in Latin, Cyrillic or Arabic letters doesn't."""
    return c.rlike("[ÃÄÅ][\u0080-¿]") | c.contains("�") | c.rlike("[\u0080-\u009f]") | c.rlike("â€")


def clean_utf8(c: Column) -> Column:
    """Without control, zero-width and replacement characters."""
    return F.regexp_replace(c, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f​-‏⁠﻿�□■]", "")


def unsupported_words(answer: Column, context: Column, least: int = 7) -> Column:
    """Words of ANSWER of LEAST letters and more that CONTEXT doesn't hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0)))
    return let(F.lower(context), lambda low: F.filter(words, lambda w: ~low.contains(w)))


def is_supported(answer: Column, context: Column) -> Column:
    """Every word of five letters and more occurs in CONTEXT."""
    words = F.regexp_extract_all(F.lower(answer), F.lit(r"\p{L}{5,}"), F.lit(0))
    return let(F.lower(context), lambda low: F.forall(words, lambda w: low.contains(w)))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("bigint")


def shingles(c: Column, n: int = 5) -> Column:
    """The different runs of N words of a text in lower case; a shorter text is one run."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return let(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs(w))))


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))
