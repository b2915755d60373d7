import os
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import packing as K
from quern.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(T.vocabulary()), reason="no vocabulary file")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n \t", "a", "don't we'll 'S", "Salam, dünya! 123 456", "𝒜𝓁𝒾 é ​ x", "=" * 300, " " * 57 + "x", "ə" * 90, "<|endoftext|>", "línea\r\nдва  три"]
    return out + ["".join(rng.choice("ab cə\n,.1 éЖ𝒜 'st") for _ in range(rng.randint(1, 120))) for _ in range(60)]


def test_ids_match_the_public_tokenizer_and_decode(spark):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(T.ranks(T.vocabulary())), special_tokens={})
    data = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, [1]) for i, t in data], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in T.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in data}
    sizes = {r.doc_id: r.n_tokens for r in T.count_tokens(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in T.decode(T.encode(df)).collect()}
    assert back == {i: t or "" for i, t in data}


def test_empty_table(spark):
    assert T.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def best_bins(sizes, cap):
    """The least number of bins by brute force."""
    sizes = sorted(sizes, reverse=True)
    for k in range(1, len(sizes) + 1):
        def place(i, room):
            if i == len(sizes):
                return True
            return any(room[j] >= sizes[i] and place(i + 1, room[:j] + (room[j] - sizes[i],) + room[j + 1 :]) for j in range(k) if room[j] not in room[:j])
        if place(0, (cap,) * k):
            return k
    return 0


def test_plan_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.randint(5, 30)
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        bins, used, fixed = 0, {}, True
        for pattern, m, is_fixed in K.plan(counts, cap):
            assert sum(s * k for s, k in pattern.items()) <= cap
            bins += m
            fixed &= is_fixed
            for s, k in pattern.items():
                used[s] = used.get(s, 0) + k * m
        assert used == counts
        best = best_bins(sizes, cap)
        assert bins == best if fixed else bins <= best + 1  # what dominance fixes is never worse than the best


def test_pack(spark):
    rng = random.Random(2)
    sizes = [(i, n) for i, n in enumerate([rng.randint(1, 40) for _ in range(300)] + [17] * 200 + [0, None, 100, 101, 350])]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    windows = spark.createDataFrame([(1, "a", 50), (2, "b", 120), (3, "c", 0), (4, "d", None)], "window_id int, window_name string, capacity_tokens int")
    rows = K.pack(df, windows)[0].collect()
    for w, cap in ((1, 50), (2, 120)):
        mine = [r for r in rows if r.window_id == w]
        assert {r.doc_id for r in mine} == set(range(len(sizes)))
        per_doc, per_bin = {}, {}
        for r in mine:
            per_doc.setdefault(r.doc_id, []).append(r)
            if r.container:
                per_bin[r.container] = per_bin.get(r.container, 0) + r.tokens
        assert max(per_bin.values()) <= cap
        for i, n in sizes:
            p = sorted(per_doc[i], key=lambda r: r.piece)
            assert sum(r.tokens for r in p) == (n or 0) and (len(p) == 1 or n > cap)
            assert [r.first_token for r in p] == [cap * r.piece for r in p]
        assert len(per_bin) <= 1.15 * sum(n or 0 for _, n in sizes) / cap
    assert not [r for r in rows if r.window_id in (3, 4)]


def test_merge_branch_gives_the_same_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Salam, necəsən? Salam!", "", None, "a " * 300, "Привет мир", "x" * 700])], "doc_id bigint, text string")
    a = {r.doc_id: r.ids for r in T.encode(docs).collect()}
    monkeypatch.setattr(T, "BROADCAST_WORDS", 0)
    assert {r.doc_id: r.ids for r in T.encode(docs).collect()} == a and {r.doc_id: r.n_tokens for r in T.count_tokens(docs).collect()} == {k: len(v) for k, v in a.items()}


def test_pack_empty(spark):
    windows = spark.createDataFrame([(1, 50)], "window_id int, capacity_tokens int")
    assert K.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), windows)[0].count() == 0


def test_best_fit_is_that_of_single_items():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.randint(5, 60)
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 40))), reverse=True)
        rooms = []
        for s in sizes:
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else cap) - s)
        plan = K.best_fit({s: sizes.count(s) for s in sizes}, cap)
        used = {}
        for pattern, m in plan:
            for s, k in pattern.items():
                used[s] = used.get(s, 0) + k * m
        assert used == {s: sizes.count(s) for s in sizes}
        assert sorted(cap - sum(s * k for s, k in p.items()) for p, m in plan for _ in range(m)) == sorted(rooms)


def test_many_different_sizes():
    counts = {s: 1 + s % 3 for s in range(1, 20_000)}
    plan = K.plan(counts, 20_000)
    assert sum(m for _, m, _ in plan) <= 1.02 * -(-sum(s * n for s, n in counts.items()) // 20_000) + 1


def test_report(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(1, 700)) for i in range(400)], "doc_id bigint, n_tokens bigint")
    windows = spark.createDataFrame([(1, 256), (2, 512)], "window_id int, capacity_tokens int")
    total = df.groupBy().sum("n_tokens").first()[0]
    for r in K.report(K.pack(df, windows)[0], windows).collect():
        assert r.tokens == total and r.least_containers == -(-total // r.capacity_tokens) <= r.n_containers <= 1.1 * r.least_containers
