"""Problem 8: subject areas of documents, by class-association rules.

Transactions are the sentences of labelled documents: their words, and the document's subject as one more item. Parallel
frequent-pattern growth mines the rules "these words -> subject"; words that are spread over the subjects as in the whole are
left out beforehand, redundant rules (a more general rule is as good) afterwards. The rules' calibrated evidence decides each sentence of every document; a
document has the subjects that at least a fifth of its sentences deal with. Since labels are few, further rounds mine again
with the subjects that the round before found as labels. The evidence of the last rules is calibrated on hand-labelled documents that they
were not mined from: the odds that a sentence has no subject are those under which the documents' subjects agree best with their labels.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources import table, write_and_read

#: Share of a document's sentences that make a subject.
FIFTH = 0.2
#: Most hand-labelled documents from which rules are mined (by the hash of the id). Further rounds label and mine all documents.
LABELLED = 30_000
#: Rounds of mining after the first.
ROUNDS = 2
#: One in so many hand-labelled documents (by the hash of the id) is held out for calibration, and the odds of no subject that are tried.
HELD_OUT, NO_SUBJECT = 5, [0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 20.0]
#: Telling words of one transaction; a longer sentence is divided into several, so that mining can't explode.
TRANSACTION = 14
#: A rule rests on so many sentences at least, and on this share of all.
LEAST_SENTENCES, LEAST_SHARE = 4, 5e-5
#: A word carries rules if one subject is so many times likelier with it than anyway, over so many documents, and by so many standard
#: deviations.
LEAST_LIFT, LEAST_DOCUMENTS, LEAST_Z = 1.8, 3, 3.0
#: Weight of a subject's own frequency in the confidence of a rule.
PRIOR_WEIGHT = 2.0
#: Most words of a rule, and most rules that are broadcast.
MOST_WORDS, BROADCAST_RULES = 3, 200_000
#: A sentence deals with a subject at this probability.
SURE = 0.5
_NONE = "-"
# Labels of speakers, questions and answers before a line.
_SPEAKERS = "İstifadəçi|Kullanıcı|User|Гость|Bot|Assistant|Бот|Sual|Cavab|Soru|Cevap|Question|Answer|Вопрос|Ответ"

_FROM = "əğıöüşçâîûёйƏĞİIÖÜŞÇÂÎÛЁЙ"
_TO = "egiouscaiuеиegiiouscaiuеи"


def plain(text: Column) -> Column:
    """Lower case without marks on letters, composed or not, and without invisible characters."""
    return F.lower(F.regexp_replace(F.translate(text, _FROM, _TO), r"[\p{M}\p{Cf}]", ""))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence, words): one row per sentence with a letter. Lines and end marks divide sentences."""
    said = F.regexp_replace(F.col(text), rf"(?m)^[ \t]*(?:{_SPEAKERS}): ", "")
    parts = F.filter(F.split(said, r"(?<=[.!?…])\s+|[\r\n]+", -1), lambda s: s.rlike(r"\p{L}"))
    cut = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), parts.alias("s"))
    rows = cut.select("doc_id", F.size("s").alias("n_sentences"), F.posexplode("s").alias("sentence", "s"))
    words = F.array_distinct(F.regexp_extract_all(plain(F.col("s")), F.lit(r"\p{L}{2,}"), F.lit(0)))
    return rows.select("doc_id", "n_sentences", "sentence", words.alias("words"))


def clean_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) of documents with one subject, or none ('-'), by all their annotators; odd spellings are put right."""
    known = subjects.select(F.lower(F.trim("subject")).alias("s"), F.col("subject").alias("known")).where("s is not null").dropDuplicates(["s"])
    rows = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("s")).distinct()
    rows = rows.join(F.broadcast(known), "s", "left").where("s is null or known is not null")
    one = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.first(F.coalesce("known", F.lit(_NONE))).alias("subject"))
    return one.where("n = 1").select("doc_id", "subject")


def _bounded(labels: DataFrame, most: int) -> DataFrame:
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def mine(found: DataFrame, labels: DataFrame, least: int = LEAST_SENTENCES, words: DataFrame | None = None) -> DataFrame:
    """Rules (words, subject, evidence) from the sentences FOUND (doc_id, words) of documents with LABELS (doc_id, subject).

    evidence: by how much, in natural log-odds, the rule raises its subject over how frequent it is; smoothed for small counts.
    WORDS (doc_id, w) are the distinct words of the documents, if they are at hand.
    """
    marked = write_and_read(found.join(labels, "doc_id").select("doc_id", "words", "subject", F.monotonically_increasing_id().alias("id")), "marked")
    sums = marked.groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).collect()
    totals, docs = ({r["subject"]: r[c] for r in sums} for c in ("n", "docs"))
    every = sum(totals.values())
    schema = "words array<string>, subject string, evidence double"
    if not every:
        return found.sparkSession.createDataFrame([], schema)
    share = F.create_map(*[x for s, n in totals.items() for x in (F.lit(s), F.lit(n / every))])
    support = max(least, math.ceil(LEAST_SHARE * every))

    # sentences of one document are alike, so words are judged by documents
    doc_share = F.create_map(*[x for s, n in docs.items() for x in (F.lit(s), F.lit(n / sum(docs.values())))])
    own = words.join(labels, "doc_id") if words is not None else marked.select("doc_id", F.explode("words").alias("w"), "subject").distinct()
    by = own.groupBy("w", "subject").agg(F.count("*").alias("n"))
    p, of = doc_share[F.col("subject")], F.sum("n").over(Window.partitionBy("w"))
    by = by.withColumn("all", of).withColumn("p", p).where(F.col("all") >= LEAST_DOCUMENTS)
    z = (F.col("n") - F.col("all") * F.col("p")) / F.sqrt(F.col("all") * F.col("p") * (1 - F.col("p")) + 1e-9)
    telling = by.where((F.col("n") / F.col("all") >= F.col("p") * LEAST_LIFT) & (z >= LEAST_Z)).select("w").distinct()

    items = marked.select("id", "subject", F.explode("words").alias("w")).join(telling, "w").groupBy("id", "subject").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / TRANSACTION).cast("int")), lambda i: F.slice("ws", i * TRANSACTION + 1, F.lit(TRANSACTION)))
    items = items.select("subject", F.explode(pieces).alias("ws")).select(F.concat("ws", F.array(F.concat(F.lit("="), F.col("subject")))).alias("items"))
    items = write_and_read(items, "items")
    n = items.count()
    if not n:
        return found.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / n), minConfidence=0.0).fit(items)
    sets = model.freqItemsets.where(F.size("items") <= MOST_WORDS + 1)
    label = F.filter("items", lambda x: x.startswith("="))
    sets = sets.select(F.sort_array(F.array_except("items", label)).alias("words"), F.get(label, F.lit(0)).alias("c"), F.col("freq").alias("n"))
    sets = write_and_read(sets.where(F.size("words") > 0), "sets")
    whole = sets.where("c is null").select("words", F.col("n").alias("all"))
    rules = sets.where("c is not null").join(whole, "words").withColumn("subject", F.expr("substring(c, 2)"))
    prior = share[F.col("subject")]
    sure = (F.col("n") + PRIOR_WEIGHT * prior) / (F.col("all") + PRIOR_WEIGHT)
    rules = rules.withColumn("sure", sure).where((F.col("sure") > prior * LEAST_LIFT))
    # a rule is redundant if one with fewer words is as sure of its subject
    fewer = rules.where(F.size("words") > 1).select("words", "subject", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.filter("words", lambda x, j: j != i))).alias("sub"))
    general = rules.select(F.col("words").alias("sub"), "subject", F.col("sure").alias("general"))
    redundant = fewer.join(general, ["sub", "subject"]).join(rules.select("words", "subject", "sure"), ["words", "subject"]).where("general >= sure - 0.02").select("words", "subject").distinct()
    kept = rules.join(redundant, ["words", "subject"], "left_anti")
    odds = lambda p: F.log(p / (1 - p))
    return write_and_read(kept.select("words", "subject", (odds(F.least(F.col("sure"), F.lit(0.995))) - odds(prior)).alias("evidence")), "rules")


def _scored(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence, subject, best, all): of each sentence with a rule its likeliest subject, exp of the evidence for it and of that for all."""
    n = rules.count()
    heads = rules.select(F.get("words", F.lit(0)).alias("w"), F.slice("words", 2, MOST_WORDS).alias("rest"), "subject", "evidence")
    heads = F.broadcast(heads) if n <= BROADCAST_RULES else heads
    hits = found.select("doc_id", "n_sentences", "sentence", "words", F.explode("words").alias("w")).join(heads, "w")
    hits = hits.where(F.size(F.array_except("rest", "words")) == 0).select("doc_id", "n_sentences", "sentence", "subject", "evidence")
    hits = hits.repartition("doc_id")  # all further grouping is within a document, so this is the only shuffle
    by = hits.groupBy("doc_id", "n_sentences", "sentence", "subject").agg(F.exp(F.least(F.sum("evidence"), F.lit(30.0))).alias("e"))
    return by.groupBy("doc_id", "n_sentences", "sentence").agg(F.max_by("subject", F.struct("e", "subject")).alias("subject"), F.max("e").alias("best"), F.sum("e").alias("all"))


def calibrate(found: DataFrame, rules: DataFrame, labels: DataFrame) -> float:
    """The odds of no subject under which the subjects of the documents with LABELS (doc_id, subject) agree best with them (F1; of equals the middle one)."""
    scored = _scored(found.join(labels.select("doc_id"), "doc_id", "left_semi"), rules)
    tried = scored.withColumn("odds", F.explode(F.array(*map(F.lit, NO_SUBJECT)))).where(F.col("best") / (F.col("all") + F.col("odds")) >= SURE)
    counts = tried.where(F.col("subject") != _NONE).groupBy("odds", "doc_id", "subject").agg(F.count("*").alias("n"), F.max("n_sentences").alias("of"))
    got = counts.where("n * 5 >= of").join(labels.select("doc_id", F.col("subject").alias("label")), "doc_id")
    hits = {r["odds"]: (r["right"], r["n"]) for r in got.groupBy("odds").agg(F.count_if(F.col("subject") == F.col("label")).alias("right"), F.count("*").alias("n")).collect()}
    want = labels.where(F.col("subject") != _NONE).count()
    f1 = {odds: 2 * right / (n + want) for odds, (right, n) in hits.items() if n + want}
    if not f1:
        return NO_SUBJECT[len(NO_SUBJECT) // 2 - 1]
    best = sorted(odds for odds, f in f1.items() if f >= max(f1.values()) - 1e-9)
    return best[(len(best) - 1) // 2]


def decide(found: DataFrame, rules: DataFrame, odds: float = NO_SUBJECT[3]) -> DataFrame:
    """(doc_id, n_sentences, sentence, subject) of the sentences that deal with a subject, at most one each; ODDS are those of no subject."""
    return _scored(found, rules).where(F.col("best") / (F.col("all") + odds) >= SURE).select("doc_id", "n_sentences", "sentence", "subject")


def by_document(decided: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the subjects of at least a fifth of a document's sentences."""
    counts = decided.where(F.col("subject") != _NONE).groupBy("doc_id", "subject").agg(F.count("*").alias("n"), F.max("n_sentences").alias("of"))
    share = F.col("n") / F.col("of")
    return counts.where(F.col("n") * 5 >= F.col("of")).select("doc_id", "subject", share.alias("share"))


def fit_rules(found: DataFrame, labels: DataFrame, subjects: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, float]:
    """The rules after all rounds and the calibrated odds of no subject. FOUND is read several times."""
    known = write_and_read(_bounded(clean_labels(labels, subjects), LABELLED), "labels")
    held = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0)
    rules = mine(found, known, 3)
    for k in range(ROUNDS):
        counts = decide(found, rules).groupBy("doc_id", "subject").agg(F.count("*").alias("n"), F.max("n_sentences").alias("of"))
        counts = counts.withColumn("decided", F.sum("n").over(Window.partitionBy("doc_id")))
        sure = counts.where("n >= 0.75 * decided and n >= 0.3 * of and (n >= 2 or of = 1)").select("doc_id", "subject")
        if k == ROUNDS - 1:
            sure = sure.join(held.select("doc_id"), "doc_id", "left_anti")
        rules = mine(found, write_and_read(sure, "relabelled"), LEAST_SENTENCES, words)
    return rules, calibrate(found, rules, held)


def document_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, w): the distinct words of each document, found without a shuffle."""
    said = F.regexp_replace(F.col(text), rf"(?m)^[ \t]*(?:{_SPEAKERS}): ", "")
    words = F.array_distinct(F.regexp_extract_all(plain(said), F.lit(r"\p{L}{2,}"), F.lit(0)))
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.explode(words).alias("w"))


def assign(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of every document with a subject, labelled or not.

    Null, empty and wordless texts have none. doc_id is meant to be unique; texts of one id count as one. Without usable labels
    nothing is found. Texts are read whole, whatever their length.
    """
    found = write_and_read(sentences(docs), "sentences")
    return by_document(decide(found, *fit_rules(found, labels, subjects, document_words(docs))))


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of the corpus: (subject, n_docs, share_of_docs)."""
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("all"))
    found = p8_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"))
    return found.join(F.broadcast(docs), F.lit(True)).select("subject", "n_docs", F.round(F.col("n_docs") / F.col("all"), 6).alias("share_of_docs"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
