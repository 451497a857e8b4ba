import random

import pytest

from foliant.llm import overlap


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def mutate(rnd, s, k, indels=True):
    s = list(s)
    for _ in range(k):
        at, how = rnd.randrange(len(s) + 1), rnd.randrange(3) if indels else 2
        if how == 0:
            s.insert(at, rnd.choice("ab"))
        elif s and how == 1:
            s.pop(at % len(s))
        elif s:
            s[at % len(s)] = rnd.choice("ab")
    return "".join(s)


@pytest.mark.parametrize("k,hot", [(0, 4096), (1, 4096), (2, 4096), (3, 4096), (1, 1), (2, 2)])
def test_edit_join_loses_nothing(spark, k, hot):
    rnd = random.Random(k)
    base = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 24 if hot < 9 else 14))) for _ in range(25)] + [""]
    left = [(i, mutate(rnd, rnd.choice(base), rnd.randrange(k + 2))) for i in range(60)] + [(60, None)]
    right = [(100 + i, mutate(rnd, rnd.choice(base), rnd.randrange(k + 2))) for i in range(60)]
    got = {(r.a, r.b): r.edits for r in overlap.edit_join(spark.createDataFrame(left, "cid bigint, value string"), spark.createDataFrame(right, "cid bigint, value string"), k, hot=hot).collect()}
    want = {(a, b): levenshtein(x, y) for a, x in left for b, y in right if x is not None and levenshtein(x, y) <= k}
    assert got == want


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_fixed_width_with_hot_segments(spark, hot):
    rnd = random.Random(hot)
    base = ["a" * 20, "a" * 12 + "b" * 8, "".join(rnd.choice("ab") for _ in range(20))]
    values = list({mutate(rnd, rnd.choice(base), rnd.randrange(4), indels=False) for _ in range(120)})
    l = [(i, v) for i, v in enumerate(values[::2])]
    r = [(1000 + i, v) for i, v in enumerate(values[1::2])]
    got = {(x.a, x.b) for x in overlap.edit_join(spark.createDataFrame(l, "cid bigint, value string"), spark.createDataFrame(r, "cid bigint, value string"), 3, width=20, hot=hot).filter("edits <= 3").collect()}
    near = {(a, b) for a, x in l for b, y in r if sum(p != q for p, q in zip(x, y)) <= 3}
    assert near <= got and got <= {(a, b) for a, x in l for b, y in r if levenshtein(x, y) <= 3}


def brute(data, bits=4, size=5120):
    out = set()
    for a, sa, ma, ha, za in data:
        for b, sb, mb, hb, zb in data:
            if sa == "train" and sb == "eval":
                same = ma is not None and ma == mb
                ok = all(h is not None and len(h) == 32 and h not in (bytes(32), b"\xff" * 32) for h in (ha, hb)) and za is not None and zb is not None
                if same or ok and abs(za - zb) <= size and (int.from_bytes(ha) ^ int.from_bytes(hb)).bit_count() <= bits:
                    out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cross_split_pairs(spark, seed):
    rnd = random.Random(seed)

    def flip(h, n):
        x = int.from_bytes(h)
        for b in rnd.sample(range(256), n):
            x ^= 1 << b
        return x.to_bytes(32)

    base = [rnd.randbytes(32) for _ in range(12)] + [bytes(32), b"\xff" * 32]
    data = []
    for i in range(260):
        h = rnd.choice([None, b"", *base, *base, *base])
        h = flip(h, rnd.randrange(7)) if h and rnd.random() < 0.6 else h
        data.append((i, rnd.choice(["train", "train", "eval", None, "other"]), rnd.choice([None, None, "m1", "m2"]), h, rnd.choice([None, *[rnd.randrange(20_000) for _ in range(5)]])))
    df = spark.createDataFrame(data, "row_id bigint, side string, md5 string, ahash binary, size bigint").repartition(3)
    got = [(r.id_lo, r.id_hi) for r in overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
    # the same without pairs
    side = {r[0]: r[1] for r in data}
    of = {}
    for i, s, _, h, z in data:
        if s in ("train", "eval") and h is not None and len(h) == 32 and h not in (bytes(32), b"\xff" * 32) and z is not None:
            of[h] = min(of.get(h, i), i)
    rows = overlap.overlapping_rows(df).collect()
    assert sorted(r.row_id for r in rows) == [i for i, s, *_ in data if s == "eval"]
    assert {r.row_id for r in rows if r.same_md5 or r.near} == {i for p in got for i in p if side[i] == "eval"}
    without = brute([(i, s, None, h, z) for i, s, _, h, z in data])
    assert {r.row_id for r in rows if r.near} == {i for p in without for i in p if side[i] == "eval"}
    assert all(r.class_id == (of.get(bytes(r.ahash)) if r.ahash is not None and r.size is not None else None) for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, side string, md5 string, ahash binary, size bigint, value string")
    assert overlap.cross_split_pairs(df).count() == 0 and overlap.overlapping_rows(df).count() == 0
