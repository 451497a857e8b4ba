import random

import numpy as np
import pytest

from foliant.operators import neardup

SCHEMA = "id bigint, label string, ahash binary, size bigint"
BASE = bytes(range(32))


def flip(h: bytes, *bits: int) -> bytes:
    n = int.from_bytes(h, "big")
    for b in bits:
        n ^= 1 << b
    return n.to_bytes(32, "big")


def brute(data, max_bits=4, max_size=5120):
    root = {r[0]: r[0] for r in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, la, ha, sa) in enumerate(data):
        for b, lb, hb, sb in data[:i]:
            if la == lb and ha and hb and len(ha) == len(hb) == 32 and sa is not None and sb is not None and ha[:31] == hb[:31] and (ha[31] ^ hb[31]).bit_count() <= max_bits and abs(sa - sb) <= max_size:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in root}


def got(spark, data):
    return {r.id: r.root for r in neardup.clusters(spark.createDataFrame(data, SCHEMA), "id", "label", "ahash", "size").collect()}


def test_pair_rules(spark):
    data = [
        (1, "a", BASE, 9000), (2, "a", flip(BASE, 0, 1, 2, 3), 14120),  # four of the low bits, exactly the size: linked
        (3, "b", BASE, 9000), (4, "b", flip(BASE, 0), 14121), (5, "c", BASE, 1), (6, "c", flip(BASE, 8), 1), (7, "d", BASE, 1), (8, "d", flip(BASE, 0, 1, 2, 3, 4), 1),
        (9, "e", None, 1), (10, "e", BASE, None), (11, "e", b"", 1), (12, None, BASE, 1), (13, None, BASE, 2),
    ]
    assert got(spark, data) == {**{i: i for i in range(1, 14)}, 2: 1, 13: 12}


def test_chain_and_copies(spark):
    data = [(i, "a", flip(BASE, *range(i % 8)), 5000 * i) for i in range(40)] + [(100 + i, "b", bytes(32), i) for i in range(300)]
    assert got(spark, data) == brute(data)
    assert got(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_random_against_union_find(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.choice(["a", "b", None]), flip(BASE, *rnd.sample(range(10), rnd.randrange(5))), rnd.randrange(0, 60_000)) for i in range(250)]
    assert got(spark, data) == brute(data)


def test_long_path_settles(spark):
    ids = list(range(600))
    random.Random(3).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    assert {r.root for r in neardup.smallest_reachable(links).collect()} == {0}


def test_vector_hash(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 2.0],), ([],), (None,), ([1.0, None],)], "v array<double>")
    assert [r.h for r in df.select(neardup.vector_hash("v").alias("h")).collect()] == [0b011, 0b11, None, None, None]


def test_grid_hash(spark):
    g = [0.0] * 255 + [256.0]
    df = spark.createDataFrame([(g,), ([1.0] * 256,), ([1.0],), (None,)], "g array<double>")
    assert [bytes(r.h) if r.h is not None else None for r in df.select(neardup.grid_hash("g").alias("h")).collect()] == [bytes(31) + b"\x01", b"\xff" * 32, None, None]


def test_crowded_parts_and_long_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, 150)
    data = []
    for i in range(120):  # all share most of their parts
        v = base.copy()
        v[rng.choice(40, 4, replace=False)] ^= 1
        data.append((i, 1 if i % 2 else None if i % 10 == 0 else 2, [float(x) for x in v]))
    data += [(200, 1, [1.0, 0.0]), (201, 1, [0.0, 1.0]), (202, 1, []), (203, 1, None), (204, 2, [1.0])]
    code = {i: "".join("1" if x >= sum(v) / len(v) else "0" for x in v) for i, _, v in data if v}
    rep = {}
    for i, l, v in data:
        if v and l is not None:
            rep.setdefault((l, code[i]), i)
    want = {(a, b, n) for (la, ca), a in rep.items() for (lb, cb), b in rep.items() if a < b and la == lb and len(ca) == len(cb) and (n := sum(x != y for x, y in zip(ca, cb))) <= 5}
    df = spark.createDataFrame(data, "id int, label int, v array<double>")
    assert {tuple(r) for r in neardup.vector_pairs(df, "id", "label", "v", 5, hot=8).collect()} == want and len(want) > 10
    assert neardup.vector_pairs(df.limit(0), "id", "label", "v", 5).count() == 0


def test_large_ids_settle(spark):
    top = 2**63 - 1
    links = spark.createDataFrame([(top - i - 1, top - i) for i in range(20)], "a bigint, b bigint")
    assert {r.root for r in neardup.smallest_reachable(links).collect()} == {top - 20}


def test_vector_pairs_lose_none(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 64))
    v = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0, 0.2, 0.5, 1)])
    data = [(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(data, "id int, label int, v array<double>")
    bits = {i: int("".join("1" if x >= sum(r) / 64 else "0" for x in r), 2) for i, _, r in data}
    rep = {}
    for i, l, _ in data:
        rep.setdefault((l, bits[i]), i)
    want = {(a, b) for (la, ha), a in rep.items() for (lb, hb), b in rep.items() if a < b and la == lb and (ha ^ hb).bit_count() <= 9}
    assert {(r.a, r.b) for r in neardup.vector_pairs(df, "id", "label", "v", 9).collect()} == want
    assert {(r.a, r.b) for r in neardup.vector_pairs(df, "id", "label", "v", 9, hot=1).collect()} == want


def test_cell_code_is_that_of_the_vector(spark):
    rng = np.random.default_rng(2)
    hashes = [bytes(32), b"\xff" * 32, b"\x00" * 31 + b"\x01", b"\xff" * 31 + b"\xfe", b"\x11" * 32, b"\x0f" * 32, b"\x12", b"", None]
    hashes += [np.packbits(rng.random(256) < p).tobytes() for p in (0.02, 0.24, 0.25, 0.26, 0.5, 0.5, 0.75, 0.9) for _ in range(20)]

    def want(h):
        v = [int(x, 16).bit_count() for x in h.hex()] if h else []
        return "".join("1" if x >= sum(v) / len(v) else "0" for x in v) or None

    vectors = [None if h is None else [float(int(x, 16).bit_count()) for x in h.hex()] for h in hashes]
    df = spark.createDataFrame([(i, h, v) for i, (h, v) in enumerate(zip(hashes, vectors))], "id int, h binary, v array<double>")
    got = {r.id: (r.c, r.v) for r in df.select("id", neardup.cell_code("h").alias("c"), neardup.vector_code("v").alias("v")).collect()}
    assert got == {i: (want(h), want(h)) for i, h in enumerate(hashes)}
