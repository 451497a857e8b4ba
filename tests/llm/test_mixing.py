import itertools
import random
from collections import defaultdict

import pytest

from foliant.llm import mixing
from foliant.llm.words import with_token_count

DOCS = "doc_id bigint, sources array<string>, tokens bigint, source string"
TARGETS = "source string, target_bp int, max_repeats int"


def test_flow_is_largest_and_cheapest():
    rnd = random.Random(0)
    for _ in range(60):
        arcs = [("s", "a", rnd.randrange(4), 1), ("s", "a", rnd.randrange(4), 3), ("s", "b", rnd.randrange(4), 1), ("s", "b", rnd.randrange(4), 3), ("a", "x", rnd.randrange(4), 0), ("a", "y", rnd.randrange(4), 0), ("b", "y", rnd.randrange(4), 0), ("x", "t", rnd.randrange(5), 0), ("y", "t", rnd.randrange(5), 0)]
        f = mixing.min_cost_flow(arcs, "s", "t")
        best = None
        for v in itertools.product(*(range(a[2] + 1) for a in arcs[:4])):
            for x in itertools.product(*(range(a[2] + 1) for a in arcs[4:7])):
                if v[0] + v[1] == x[0] + x[1] and v[2] + v[3] == x[2] and x[0] <= arcs[7][2] and x[1] + x[2] <= arcs[8][2]:
                    key = (-sum(v), sum(n * a[3] for n, a in zip(v, arcs)))
                    best = key if best is None or key < best else best
        assert best == (-sum(f[:4]), sum(n * a[3] for n, a in zip(f, arcs)))
        for node in "abxy":
            assert sum(n for n, a in zip(f, arcs) if a[1] == node) == sum(n for n, a in zip(f, arcs) if a[0] == node)


def test_shared_documents_go_where_they_are_needed():
    # z is wanted by nobody else, the shared pattern serves both; b alone is too small
    flow = mixing.route({"a": (["a"], 100), "a\x1fb": (["a", "b"], 50), "b": (["b"], 10), "z": (["z"], 9)}, {"a": (100 * mixing.UNIT, 1), "b": (60 * mixing.UNIT, 1)})
    assert flow == {("a", "a"): 100 * mixing.UNIT, ("a\x1fb", "b"): 50 * mixing.UNIT, ("b", "b"): 10 * mixing.UNIT}


def test_mix(spark):
    rnd = random.Random(1)
    data = [(i, [["big"], ["big"], ["big"], ["small"], ["tiny"], [None], None][i % 7], rnd.randrange(0, 30), "x") for i in range(700)] + [(900, ["small"], None, "x")]
    df = spark.createDataFrame(data, DOCS).repartition(4)
    targets = spark.createDataFrame([("big", 3000, 1), ("small", 4000, 3), ("tiny", 6000, 2), ("gone", 10, 5), ("none", 0, 1)], TARGETS)
    chosen, report = mixing.mix(df, targets)
    total = sum(t or 0 for _, _, t, _ in data)
    have = defaultdict(int)
    for _, s, t, _ in data:
        for x in s or []:
            have[x] += t or 0
    r = {x.source: x for x in report.collect()}
    for s, (bp, cap) in {"big": (3000, 1), "small": (4000, 3), "tiny": (6000, 2), "gone": (10, 5), "none": (0, 1)}.items():
        assert r[s].is_short == (cap * have[s] * 10_000 < bp * total)
        assert r[s].most_uses <= cap and r[s].tokens == have[s]
        assert abs(r[s].chosen - min(bp * total / 10_000, cap * have[s])) < 30
    assert sum(x.share for x in r.values()) == pytest.approx(1)
    uses = {(x.doc_id, x.source): x.n_uses for x in chosen.collect()}
    assert uses == {(x.doc_id, x.source): x.n_uses for x in mixing.mix(df.repartition(1), targets)[0].collect()}
    small = [n for (d, s), n in uses.items() if s == "small"]
    assert max(small) - min(small) <= 1  # no document is repeated before all have been used as often


def test_overlapping_sources(spark):
    data = [(i, [["a"], ["a", "b"], ["b", "a", "a"]][i % 3], 10, "x") for i in range(300)]
    chosen, report = mixing.mix(spark.createDataFrame(data, DOCS), spark.createDataFrame([("a", 4000, 1), ("b", 6000, 1)], TARGETS))
    r = {x.source: x for x in report.collect()}
    assert not r["a"].is_short and not r["b"].is_short and abs(r["a"].share - 0.4) < 0.01
    assert max(x.n for x in chosen.groupBy("doc_id").sum("n_uses").toDF("doc_id", "n").collect()) == 1


def test_empty(spark):
    chosen, report = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 10000, 1)], TARGETS))
    assert chosen.count() == 0 and report.first().is_short is False and report.first().share == 0


TEXTS = [("Two words, x_1!",), ("",), (None,), ("äöü — 3²",)]


def test_token_rule(spark):
    assert [r.n for r in with_token_count(spark.createDataFrame(TEXTS, "t string"), "t", "n").collect()] == [5, 0, 0, 3]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_public_tokenizers(spark, name):
    path = f"/opt/tokenizers/{name}"
    pytest.importorskip("os").path.exists(path) or pytest.skip("no tokenizer files")
    n = [r.n for r in with_token_count(spark.createDataFrame(TEXTS, "t string"), "t", "n", path).collect()]
    assert n[0] >= 5 and n[1] == n[2] == 0 and n[3] >= 3


def test_repeats_and_long_texts(spark):
    # repeated rows are rows of their own; together they fill the quota of one
    df = spark.createDataFrame([(7, ["a"], 10, "x")] * 6 + [(7, ["b"], 10, "x")] * 4, DOCS)
    chosen, report = mixing.mix(df, spark.createDataFrame([("a", 6000, 1), ("b", 4000, 1)], TARGETS))
    assert {r.source: (r.chosen, r.is_short) for r in report.collect()} == {"a": (60, False), "b": (40, False)} and chosen.count() == 10
    long = spark.createDataFrame([("ab, " * 300_000,)], "t string")
    assert with_token_count(long, "t", "n").first().n == 600_000


def test_other_sources_make_no_patterns(spark):
    data = [(d, [f"host{d}", "ab"[d % 2]], 10) for d in range(20)] + [(d, [f"host{d}", None], 10) for d in range(20, 40)]
    chosen, report = mixing.mix(spark.createDataFrame(data, "doc_id bigint, sources array<string>, tokens bigint"), spark.createDataFrame([("a", 2500, 1), ("b", 5000, 1)], TARGETS))
    got = {r.source: (r.tokens, r.quota, r.chosen, r.is_short) for r in report.collect()}
    assert got == {"a": (100, 100.0, 100, False), "b": (100, 200.0, 100, True)} and chosen.count() == 20


def test_many_patterns_flow_quickly():
    import random
    import time

    rnd = random.Random(3)
    names = [f"s{i}" for i in range(14)]
    patterns = {f"p{i}": (rnd.sample(names, rnd.randrange(1, 6)), rnd.randrange(1, 10**9)) for i in range(4_000)}
    total = sum(t for _, t in patterns.values())
    quotas = {s: (rnd.randrange(300, 1500) * total, rnd.randrange(1, 4)) for s in names}
    t = time.time()
    flow = mixing.route(patterns, quotas)
    assert time.time() - t < 60
    for s in names:
        got = sum(f for (_, x), f in flow.items() if x == s)
        assert got <= quotas[s][0]
    for p, (sources, tokens) in patterns.items():
        used = sum(f for (x, _), f in flow.items() if x == p) if p in ("p0", "p1", "p2") else 0
        assert used <= tokens * mixing.UNIT * sum(quotas[s][1] for s in sources)
