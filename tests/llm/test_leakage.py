import random
from collections import Counter

import numpy as np
import pytest

from foliant.llm import leakage
from foliant.llm.words import plain, words

VOCAB = [f"w{i}" for i in range(60)] + ["é", "straße", "ﬁeld"]


def brute(docs, items, n=12):
    out = set()
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        parts = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if size else set()
        for d, x in docs:
            v = words(x)
            if any(tuple(v[j : j + size]) in parts for j in range(len(v) - size + 1)):
                out.add((d, i))
    return out


def made(seed, n_docs=60):
    rnd = random.Random(seed)
    say = lambda k: [rnd.choice(VOCAB) for _ in range(k)]
    items = [(i, say(rnd.choice([1, 3, 8, 12, 20, 40]))) for i in range(15)]
    docs = []
    for d in range(n_docs):
        body = say(rnd.randrange(0, 90))
        if rnd.random() < 0.6:
            w = rnd.choice(items)[1]
            k = rnd.choice([11, 12, 13, len(w)])
            a = rnd.randrange(max(1, len(w) - k + 1))
            at = rnd.randrange(len(body) + 1)
            body[at:at] = w[a : a + k]
        text = rnd.choice([" ", "  \n", ", ", " - "]).join(rnd.choice([str.upper, str.title, str])(x) for x in body)
        docs.append((d, text.replace("w1", "w­1") if d % 3 == 0 else text))
    return docs, [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("seed,block", [(0, 50_000), (1, 50_000), (2, 20)])
def test_exact_passages(spark, seed, block):
    docs, items = made(seed)
    docs += [(900, None), (901, ""), (902, "!!"), (None, items[0][1])]
    items += [(77, None), (78, ""), (79, "...")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    got = leakage.leaks(d, i, block=block).filter("exact").collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute([x for x in docs if x[0] is not None], items)
    assert all(r.similarity == pytest.approx(1) for r in got)


def test_long_texts_are_searched_to_the_end(spark, monkeypatch):
    rnd = random.Random(5)
    item = [rnd.choice(VOCAB) for _ in range(14)]
    text = [rnd.choice(VOCAB[:30]) for _ in range(50_000)]
    monkeypatch.setattr(leakage, "PIECE", 16_000)
    for at in (0, 15_990, 16_005, 49_980):
        x = list(text)
        x[at : at + 14] = item
        d = spark.createDataFrame([(1, " ".join(x)), (2, "short"), (3, " ".join(item[:12]))], "doc_id bigint, text string")
        got = leakage.leaks(d, spark.createDataFrame([(4, " ".join(item))], "item_id bigint, text string")).filter("exact").collect()
        assert {r.doc_id for r in got} == {1, 3}


def test_near_passages_are_found_with_their_similarity(spark):
    w = [f"word{i}{'x' * (i % 5)}" for i in range(40)]
    changed = [*w[:39], "other"]
    d = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(reversed(w)))], "doc_id bigint, text string")
    i = spark.createDataFrame([(9, " ".join(w))], "item_id bigint, text string")
    got = leakage.leaks(d, i, passage=40, radius=7).collect()
    assert [(r.doc_id, r.exact) for r in got] == [(1, False)] and 0.8 <= got[0].similarity < 1


def test_windows_are_as_long_as_the_item(spark):
    """Words changed far apart: 12-word runs between them are alike, and so is the whole."""
    w = [f"word{i}" for i in range(150)]
    edited = [x if i % 60 != 30 else "other" for i, x in enumerate(w)]
    d = spark.createDataFrame([(1, " ".join(["before", *edited, "after"])), (2, " ".join(w[:9] + ["x"] + w[10:18]))], "doc_id bigint, text string")
    got = leakage.leaks(d, spark.createDataFrame([(9, " ".join(w))], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.exact) for r in got] == [(1, True)]
    got = leakage.leaks(d, spark.createDataFrame([(9, " ".join(w[20:41]))], "item_id bigint, text string")).filter("NOT exact").collect()
    assert got == []  # 5 of 17 shingles differ


def test_each_window_counts_once(spark):
    text = ["filler"] * 20_000
    text[15_990:15_993] = ["one", "two", "three"]
    d = spark.createDataFrame([(1, " ".join(text)), (2, "one two three and one two three")], "doc_id bigint, text string")
    i = spark.createDataFrame([(4, "One two, three"), (5, "one two three"), (6, " ".join(f"w{k}" for k in range(300)))], "item_id bigint, text string")
    import foliant.llm.leakage as module

    keep = module.PIECE
    try:
        for module.PIECE, block in ((16_000, 50_000), (16_000, 10), (64_000, 50_000)):
            got = {(r.doc_id, r.item_id): r.n_windows for r in leakage.leaks(d, i, block=block).collect()}
            assert got == {(1, 4): 1, (1, 5): 1, (2, 4): 2, (2, 5): 2}
    finally:
        module.PIECE = keep


def test_near_passages_are_all_found_with_the_production_parameters(spark):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([1, 2, 5, 9, 12]))) for _ in range(300)]
    say = lambda k: [rnd.choice(vocab) for _ in range(k)]
    items = [(i, say(rnd.choice([7, 12, 20]))) for i in range(40)] + [(40, ["x", "y"] * 8)]
    docs = []
    for d in range(250):
        w = list(rnd.choice(items)[1])
        at = rnd.randrange(max(1, len(w) - 11))
        w = w[at : at + 12]
        w[rnd.choice([0, 0, -1, -1, -2])] = rnd.choice("qrstuv")
        docs.append((d, say(rnd.randrange(20)) + w + say(rnd.randrange(20))))

    def bag(w):
        n = min(5, len(w))
        out = Counter()
        for j in range(len(w) - n + 1):
            out[tuple(w[j : j + n])] += sum(map(len, w[j : j + n]))
        return out

    want = {}
    for i, w in items:
        parts = [w, *(w[j : j + 12] for j in range(len(w) - 11) if len(w) > 12)]
        for size, a in ((len(x), bag(x)) for x in parts):
            for d, v in docs:
                for j in range(len(v) - size + 1):
                    b = bag(v[j : j + size])
                    if shared := (a & b).total():
                        if (s := shared / (a | b).total()) >= 0.8:
                            n, most = want.get((d, i), (0, 0))
                            want[d, i] = n + 1, max(most, s)
    join = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.similarity) for r in leakage.leaks(join(docs, "doc_id"), join(items, "item_id")).collect()}
    assert got.keys() == want.keys() and sum(s < 1 for _, s in want.values()) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocks_find_all_prints_within_the_radius():
    rng = np.random.default_rng(0)
    for radius in (0, 2, 3, 5):
        n = 6
        h = rng.integers(0, 2**63, (300, n), dtype=np.uint64)
        index = leakage.passage_index(n, np.arange(300), h, np.ones((300, n), np.int32), 5, radius)
        p = index["prints"][rng.integers(0, 300, 400)].copy()
        for j in range(len(p)):
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                p[j] ^= np.uint64(1) << np.uint64(b)
        a, b = leakage.search(index, p)
        want = np.bitwise_count(p[:, None] ^ index["prints"][None]) <= radius
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, (x.tolist() for x in np.nonzero(want)))))


def test_similarity_is_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, 6).astype(np.uint64), rng.integers(0, 5, 6).astype(np.uint64)
        weight = {x: int(x) + 1 for x in range(5)}
        wa, wb = (np.array([weight[int(x)] for x in y]) for y in (a, b))
        inter = sum(min((a == x).sum(), (b == x).sum()) * weight[x] for x in range(5))
        union = sum(max((a == x).sum(), (b == x).sum()) * weight[x] for x in range(5))
        assert leakage.similarity(a[None], wa[None], b[None], wb[None])[0] == pytest.approx(inter / union)


def test_words():
    assert words("Cáfé_ＡＢ ﬁeld²​x STRAẞE, İ") == ["cafe", "ab", "field2x", "strasse", "i"] and plain("ABC") == "abc" and words(None) == [] and words("leaf™ x") == ["leaf", "x"]


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert leakage.leaks(d, i).count() == 0 and leakage.leaks(d, some).count() == 0


def test_repeats_ties_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, text, 5, "x", 0.1), (1, text, 6, "y", 0.2), (2, f"{text} and {text}", 7, "z", 0.3)], "doc_id bigint, text string, item_id bigint, ws string, similarity double")
    i = spark.createDataFrame([(4, text, 1), (4, text, 2), (5, text, 3)], "item_id bigint, text string, doc_id bigint")
    got = {(r.doc_id, r.item_id): (r.exact, r.similarity) for r in leakage.leaks(d, i).collect()}
    assert got == {(a, b): (True, 1.0) for a in (1, 2) for b in (4, 5)}
