"""Keywords with greetings taken out and subject terms first, and texts reduced to their longest paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.let import let
from quern.functions.text import truncate_smart

# Greetings and fillers that are taken out of a question.
FILLERS = [
    "salam", "aleykum", "əleykum", "hörmətli", "əziz", "dostum", "qardaş", "bacı", "xanım", "cənab", "zəhmət olmasa", "xahiş edirəm", "xaiş", "lütfən", "buyurun",
    "mənə", "bizə", "ona", "sənə", "sizə", "bunun", "onun", "deyin", "deyə bilərsiniz", "bilərsiniz", "olar", "bir", "bu", "o", "nə", "kim", "harada", "niyə",
    "sual", "soruşuram", "öyrənmək istəyirəm", "bilmək istəyirəm", "cavab verin", "izah edin", "göstərin", "kömək edin", "var", "yox", "bəli", "xeyr", "hə",
]
# Words that are no keywords.
STOP = [
    "və", "ki", "da", "də", "ilə", "üçün", "bu", "o", "bir", "iki", "üç", "dörd", "beş", "necə", "nə", "niyə", "harada", "kim", "hansı", "etmək", "olmaq", "var", "yox",
    "edir", "edirəm", "edirsən", "istəyirəm", "istəyirsən", "bilirəm", "bilirsən", "ola", "olur", "olub", "olacaq", "idi", "imiş", "necədir", "nədir", "kimidir", "hardadır",
    "ve", "veya", "için", "ile", "the", "and", "or", "for", "with", "و", "في", "من", "على", "که", "در", "با", "از",
]
# Terms of the subject, which come first.
FIRST = [
    "dəstəmaz", "qüsl", "təyəmmüm", "namaz", "oruc", "zəkat", "həcc", "quran", "surə", "ayə", "hədis", "fiqh", "şəriət", "hökmü", "hökm", "vacib", "sünnət", "müstəhəb",
    "haram", "halal", "məkruh", "təharət", "nəcasət", "pak", "murdar", "su", "qiblə",
]
# Variations of a term, and endings that are cut from it.
VARIATIONS = {
    "dəstəmaz": ["destemaz", "dəstəmaz", "abdest", "təharət"],
    "destemaz": ["dəstəmaz", "destemaz", "abdest", "təharət"],
    "abdest": ["dəstəmaz", "destemaz", "abdest", "təharət"],
    "namaz": ["salat", "salah", "namaz", "ibadət"],
    "salat": ["namaz", "salat", "salah", "ibadət"],
    "oruc": ["siyam", "ruzə", "oruc", "oruclama"],
    "siyam": ["oruc", "siyam", "ruzə"],
    "qüsl": ["qusl", "qüsl", "böyük təharət", "tam yuyunma"],
    "qusl": ["qüsl", "qusl", "böyük təharət"],
    "təyəmmüm": ["teyemmum", "təyəmmüm", "torpaqla təharət"],
    "teyemmum": ["təyəmmüm", "teyemmum", "torpaqla təharət"],
    "necə": ["necə", "nece", "nasıl", "kimi"],
    "almaq": ["almaq", "etmək", "yerinə yetirmək"],
    "alınır": ["alınır", "edilir", "yerinə yetirilir"],
}
ENDINGS = ["ın", "in", "un", "ün", "nın", "nin", "nun", "nün", "ı", "i", "u", "ü"]
# Dimensions of embedding models by a part of their name, the first that fits; others have 1536.
DIMENSIONS = {"text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "deepseek-embed": 1536, "embedding-001": 768, "voyage": 1024}

_NONE = "array<string>"


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _forms(word: Column) -> Column:
    """The word, its variations, and what is left of it without an ending."""
    table = F.create_map(*[x for k, v in VARIATIONS.items() for x in (F.lit(k), _words(v))])
    low = F.lower(word)
    cut = F.transform(F.filter(_words(ENDINGS), lambda e: low.endswith(e)), lambda e: F.substring(low, F.lit(1), F.length(low) - F.length(e)))
    return F.concat(F.array(word), F.coalesce(table[low], F.array().cast(_NONE)), F.array(low), cut)


def keywords_enhanced(c: Column) -> Column:
    """Words of three letters and more without fillers and stop words, terms of the subject first, each followed by its forms.

    If nothing is left, the three longest words of the text. Null gives null.
    """
    plain = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))

    def pick(q: Column) -> Column:
        less = F.trim(F.regexp_replace(F.regexp_replace(q, r"(?U)\b(?:" + "|".join(FILLERS) + r")\b", ""), r"(?U)\s+", " "))
        kept = F.when(F.octet_length(less) < 3, q).otherwise(less)
        return F.filter(F.regexp_extract_all(kept, F.lit(r"\p{L}{2,}"), F.lit(0)), lambda t: ~t.isin(STOP) & (F.length(t) >= 3))

    def ordered(words: Column) -> Column:
        first = lambda w: F.exists(_words(FIRST), lambda t: w.contains(t) | t.contains(w))
        longest = F.array_sort(F.transform(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3), lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
        best = F.transform(F.slice(longest, 1, 3), lambda x: x["w"])
        return F.when(F.size(words) > 0, F.concat(F.filter(words, first), F.filter(words, lambda w: ~first(w)))).otherwise(best)

    words = let(let(plain, pick), ordered)
    return F.when(c.isNotNull(), F.array_distinct(F.flatten(F.transform(words, _forms))))


def model_dimension(model: Column) -> Column:
    """The dimension of an embedding model by its name; null for null and empty names."""
    out = F.lit(1536)
    for part, n in reversed(DIMENSIONS.items()):
        out = F.when(model.contains(part), F.lit(n)).otherwise(out)
    return F.when(model != "", out)


def reduced(c: Column, target: int) -> Column:
    """A text of more than TARGET bytes without paragraphs below 50 bytes; if that is too long still, its longest paragraphs up to nine tenths of it, the longest first."""
    parts = F.filter(F.split(c, "\n\n", -1), lambda p: F.octet_length(F.trim(p)) >= 50)
    placed = lambda ps: F.transform(F.array_sort(F.transform(ps, lambda p, i: F.struct((-F.octet_length(p)).alias("l"), i.alias("i"), p.alias("p")))), lambda x: x["p"])

    def take(acc: Column, p: Column) -> Column:
        fits = ~acc["done"] & (acc["n"] + F.octet_length(p) <= target * 0.9)
        more = F.struct(F.concat(acc["out"], F.array(p)).alias("out"), (acc["n"] + F.octet_length(p) + 2).alias("n"), F.lit(False).alias("done"))
        return F.when(fits, more).otherwise(F.struct(acc["out"].alias("out"), acc["n"].alias("n"), F.lit(True).alias("done")))

    zero = F.struct(F.array().cast(_NONE).alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    longest = lambda ps: F.array_join(F.aggregate(placed(ps), zero, take, lambda a: a["out"]), "\n\n")
    pick = lambda ps: F.when(F.octet_length(F.array_join(ps, "\n\n")) <= target, F.array_join(ps, "\n\n")).otherwise(let(longest(ps), lambda t: F.when(t != "", t).otherwise(truncate_smart(c, target))))
    return F.when(F.octet_length(c) <= target, c).otherwise(let(parts, pick))
