import random

from pyspark.sql import functions as F

from quern.llm import boilerplate as B
from quern.llm import subjects as S


def test_simple_tree_match():
    t = lambda x, *c: (x, c)
    a = t("r", t("x"), t("y", t("1"), t("2")), t("z"))
    assert B.simple_tree_match(a, a) == 6
    assert B.simple_tree_match(a, t("r", t("y", t("2")), t("x"))) == 3
    assert B.simple_tree_match(a, t("other")) == 0


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def tree_size(a, b):
    """The classic recursion, over all pairs of children."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + tree_size(p, q))
    return m[-1][-1] + 1


def test_matching_is_the_largest():
    rng = random.Random(4)
    for _ in range(80):
        leaf = lambda: (rng.choice("xyz"), ())
        a, b = ([(rng.choice("abcd"), tuple(leaf() for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(0, 9))] for _ in range(2))
        size, pairs = B.matching(a, b)
        assert size + 1 == tree_size(("r", tuple(a)), ("r", tuple(b))) == B.simple_tree_match(("r", tuple(a)), ("r", tuple(b)))
        assert all(a[i][0] == b[j][0] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        flat = [[(n[0], ()) for n in t] for t in (a, b)]
        assert B.matching(*flat)[0] == lcs(*[[n[0] for n in t] for t in flat])


def test_tree_of_a_host_keeps_what_pages_share():
    p = lambda *x: [(n, ()) for n in x]
    tree = B.host_tree([p("nav", "a1", "foot"), p("nav", "a2", "ad", "foot"), [*p("nav", "b"), ("|", (("x", ()), ("y1", ()))), *p("ad", "foot")], [("|", (("x", ()), ("y2", ()))), *p("foot")]])
    assert [n[0] for n in tree] == ["nav", "|", "ad", "foot"] or [n[0] for n in tree] == ["nav", "ad", "|", "ad", "foot"]
    assert [n[1] for n in tree if n[0] == "|"][0] == (("x", ()),)


def test_long_notices_and_long_slots(spark):
    """A notice of over 300 characters and nine titles below a heading are furniture too."""
    notice = "We keep data on your device to make this site work for all of its readers. " * 6
    rng = random.Random(1)
    rows, want = [], {}
    word = lambda: "".join(rng.choice("abdegiklmnorstuz") for _ in range(8))
    for i in range(40):
        title = f"Page {word()} {word()}"
        lines = ["Home | News | Contact", notice, title, f"{word()} {word()} {word()}. " * 5, "Most read:", *[f"Story {word()} {word()}" for _ in range(9)], f"{word()} {word()} {word()} ends here. " * 4, "Imprint and contact"]
        rows.append((i, "https://www.site.example/p", title, "\n".join(lines)))
        want[i] = {1, 2, 5, *range(6, 15), 16}
    got = {}
    for r in B.furniture(spark.createDataFrame(rows, PAGE)).collect():
        got.setdefault(r.kb_id, set()).add(r.line_no)
    assert sum(got[i] == w for i, w in want.items()) >= 38, [(got[i], w) for i, w in want.items() if got[i] != w][:2]


PAGE = "kb_id bigint, url string, title string, content string"


def pages(n=30):
    rng = random.Random(7)
    out, body = [], {}
    for i in range(n):
        words = lambda k: " ".join("".join(rng.choice("abdegiklmnorstuz") for _ in range(7)) for _ in range(k))
        lines = [("Home | News | Contact", False), (f"Basket ({i})", False), (f"Title {i} of the page", True), ("", None), (words(14) + ". " + words(9) + ".", True)]
        if i % 3 == 0:
            lines += [("Read next:", False), (f"Other heading {rng.randint(1, 99)} here", False), (f"Some {rng.randint(1, 99)} heading", False)]
        lines += [("- " + words(1), True), (words(16) + ". " + words(3) + ".", True), (f"© 20{10 + i % 9} Site. All rights reserved.", False)]
        out.append((i, f"https://www.site.example/p/{i}?x", f"Title {i} of the page | Site", "\n".join(x for x, _ in lines)))
        body[i] = {k + 1 for k, (_, b) in enumerate(lines) if b is False}
    return out, body


def test_furniture(spark):
    data, want = pages()
    df = spark.createDataFrame([*data, (900, "https://a.example/x", "", ""), (901, "no url", None, "x")], PAGE)
    found = B.furniture(df)
    got = {}
    for r in found.collect():
        got.setdefault(r.kb_id, set()).add(r.line_no)
    right = sum(got.get(i, set()) == w for i, w in want.items())
    assert right >= 27, [(i, got.get(i), w) for i, w in want.items() if got.get(i) != w][:3]
    bodies = {r.kb_id: r.body for r in B.main_text(df, found).collect()}
    assert "Basket" not in bodies[1] and "Title 1" in bodies[1]


def test_no_pages(spark):
    assert B.furniture(spark.createDataFrame([], PAGE)).count() == 0
    kb = spark.createDataFrame([(1, None, "t", "c"), (2, " ", "t", "c"), (3, "http://a.example", None, "c"), (3, "http://a.example", None, "c")], "id bigint, source_url string, title string, content string")
    assert [r.kb_id for r in B.pages_of(kb).collect()] == [3]


def test_subjects_held_out(spark):
    rng = random.Random(9)
    terms = {"food": ["çörək", "pilav", "şorba", "xəmir"], "law": ["məhkəmə", "vəkil", "müqavilə", "iddia"], "sport": ["futbol", "qol", "hakim", "turnir"]}
    frames = ["Sonrakı bölmədə {} daha geniş izah edilir.", "Hər {} üçün ən azı {} gün ayırmaq olar.", "Oxucu soruşur ki, {} nə vaxt başlayır?"]
    talk = ["Yaxşı, gözləyirəm.", "Çox sağ olun!", "Bir az sonra yazaram."]
    docs, truth, labels = [], {}, []
    for i in range(240):
        s = rng.choice([*terms, None])
        text = [rng.choice(frames).format(rng.choice(terms[s]), rng.randint(1, 9)) for _ in range(6)] if s else []
        docs.append((i, " ".join([*text, rng.choice(talk)]), "x"))
        truth[i] = s
        if i % 2 == 0:
            labels.append((i, rng.choice([*terms]) if rng.random() < 0.06 else s and rng.choice([s, s.upper(), f" {s}"]), "ann"))
    docs += [(1000, None, ""), (1001, "", ""), (1002, " 12 ", "")]
    areas = spark.createDataFrame([(s, s) for s in terms], "subject string, name string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    got = {}
    for r in S.assign(d, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 2]
    right = sum(got.get(i, set()) == ({truth[i]} if truth[i] else set()) for i in held)
    assert right >= 0.95 * len(held)
    assert not {1000, 1001, 1002} & set(got)


def test_further_rounds_take_every_document(spark, monkeypatch):
    monkeypatch.setattr(S, "RELABELLED", 5, raising=False)
    seen, mine = [], S.mine
    monkeypatch.setattr(S, "mine", lambda found, *rest: seen.append(found.select("doc_id").distinct().count()) or mine(found, *rest))
    words = ["çörək pilav", "futbol turnir"]
    d = spark.createDataFrame([(i, f"{words[i % 2]} sözü var. {words[i % 2]} olur.") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, ("food", "sport")[i % 2]) for i in range(10)], "doc_id bigint, subject string")
    S.fit_rules(S.sentences(d), labels, spark.createDataFrame([("food",), ("sport",)], "subject string"))
    assert seen == [40] * (1 + S.ROUNDS)


def test_calibration_takes_the_odds_that_agree_best(spark):
    rows = [(i, 1, 0, ["w"]) for i in range(20)] + [(100 + i, 1, 0, ["v"]) for i in range(20)]
    found = spark.createDataFrame(rows, "doc_id bigint, n_sentences int, sentence int, words array<string>")
    rules = spark.createDataFrame([(["w"], "food", 4.0), (["v"], "food", 1.2)], "words array<string>, subject string, evidence double")
    labels = spark.createDataFrame([(i, "food") for i in range(20)] + [(100 + i, "-") for i in range(20)], "doc_id bigint, subject string")
    odds = S.calibrate(found, rules, labels)
    assert {r.doc_id for r in S.decide(found, rules, odds).collect()} == set(range(20))
    assert S.calibrate(found, rules, labels.where("doc_id < 0")) in S.NO_SUBJECT


def test_long_sentences_with_many_telling_words(spark):
    words = {"food": [f"f{c}x" for c in "abcdefghijklmnopqrstuvwxyz"], "sport": [f"s{c}x" for c in "abcdefghijklmnopqrstuvwxyz"]}
    docs = [(i, f"{' '.join(words[k])}. {' '.join(words[k])}.") for i, k in enumerate(["food", "sport"] * 20)]
    labels = [(i, k) for i, k in enumerate(["food", "sport"] * 20)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = S.assign(d, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([("food",), ("sport",)], "subject string"))
    assert {(r.doc_id, r.subject) for r in got.collect()} == set(labels)


def test_subjects_without_labels(spark):
    d = spark.createDataFrame([(1, "Bir söz.")], "doc_id bigint, text string")
    areas = spark.createDataFrame([("food",)], "subject string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    assert S.assign(d, none, areas).count() == 0
    assert S.sentences(d).select(F.col("n_sentences")).collect()[0][0] == 1


def test_tree_of_a_host_grows_from_all_pages(spark):
    """Fifty notices, each on a fiftieth of the pages only: the tree has them all."""
    name = lambda k: "abcdefghij"[k // 10] + "klmnopqrst"[k % 10]
    rows = [(i, "https://www.site.example/p", f"T{i}", f"Home\nNotice {name(i % 50)}\nOwn {'x' * i}\nImprint") for i in range(300)]
    trees = B.host_trees(B.site_columns(spark.createDataFrame(rows, PAGE))).collect()
    assert len(trees) == 1 and {x["label"] for x in trees[0]["tree"]} == {"home", "imprint", *(f"notice {name(k)}" for k in range(50))}


def test_trees_in_spark_are_those_of_all_pages(spark):
    data, _ = pages()
    df = B.site_columns(spark.createDataFrame(data, PAGE))
    rows = sorted(df.collect(), key=lambda r: r.kb_id)
    want = B.host_tree([B.Page(r.content, r.title, r.word).nodes for r in rows])
    assert [B._tree(r["tree"]) for r in B.host_trees(df).collect()] == [want]


def test_parts_of_a_large_host(spark, monkeypatch):
    data, _ = pages(60)
    df = spark.createDataFrame(data, PAGE)
    whole = {tuple(r) for r in B.furniture(df).collect()}
    monkeypatch.setattr(B, "HOT_PAGES", 10)
    monkeypatch.setattr(B, "KNOWN", 1)
    assert {tuple(r) for r in B.furniture(df).collect()} == whole
