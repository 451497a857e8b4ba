import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import grouping

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
ROWS = "row_id bigint, source string, cluster bigint, stratum string, present string"


def split(spark, data):
    rows = grouping.linked_rows(spark.createDataFrame(data, ROWS), "row_id", [["source", "cluster"]])
    units = grouping.balance(grouping.units_of(rows).withColumn("order_key", F.xxhash64("unit")), SHARES)
    names = rows.filter("row_id = unit").select("row_id", "source", F.col("cluster").alias("cluster"), F.when(F.col("cluster").isNull(), F.col("row_id")).alias("single_id"))
    return units.join(names, F.col("unit") == F.col("row_id"))


def test_differencing_is_balanced():
    assert grouping.differencing([], 3) == []
    rnd = random.Random(0)
    for bins in (2, 5, 20):
        w = [rnd.randrange(1, 100) for _ in range(300)]
        sums = [0] * bins
        for x, b in zip(w, grouping.differencing(w, bins)):
            sums[b] += x
        assert max(sums) - min(sums) <= 2
    b = grouping.differencing([8, 7, 6, 5, 4], 2)  # the known case: differencing leaves 2
    s = [sum(x for x, i in zip([8, 7, 6, 5, 4], b) if i == j) for j in (0, 1)]
    assert sorted(s) == [14, 16]


def test_allocation_follows_the_shares():
    got = grouping.allocate([5] * 20, SHARES)
    assert (got.count("train"), got.count("val"), got.count("test")) == (14, 3, 3)
    assert grouping.allocate([], SHARES) == [] and grouping.allocate([0, 0], SHARES) == ["train", "train"]


@pytest.mark.parametrize("seed", range(2))
def test_units_stay_together_and_labels_are_balanced(spark, seed):
    rnd = random.Random(seed)
    data, i = [], 0
    for c in range(900):
        for _ in range(rnd.choice([1, 1, 2, 3, 8])):
            data.append((i, rnd.choice("pq") if c % 2 else "p", c if c % 9 else None, "hot" if c % 3 else rnd.choice(["a", "b", None]), "train"))
            i += 1
    got = split(spark, data).collect()
    unit = {(r.source, r.cluster, r.single_id): r.new_split for r in got}
    assert len(unit) == len(got) and sum(r.weight for r in got) == len(data)
    per = defaultdict(lambda: defaultdict(int))
    for r in got:
        per[r.stratum][r.new_split] += r.weight
    for label, n in per.items():
        total = sum(n.values())
        for s, share in SHARES.items():
            assert abs(n[s] - share * total) <= max(3, 0.02 * total), (label, dict(n))


def test_a_giant_unit_ties_and_torn_clusters(spark):
    data = [(i, "p", 1, "a", ["train", "VAL", None][i % 3]) for i in range(60)] + [(100 + i, "p", 100 + i, "a", "test") for i in range(60)] + [(900, None, 7, None, "val"), (901, None, 7, "z", "test"), (902, None, None, None, None)]
    got = {(r.source, r.cluster, r.single_id): r for r in split(spark, data).collect()}
    big = got["p", 1, None]
    assert big.weight == 60 and big.mask == 1 and got[None, 7, None].mask == 6 and got[None, 7, None].stratum == "z" and got[None, None, 902].mask == 0
    small = [r.new_split for k, r in got.items() if k[0] == "p" and k[1] != 1]
    assert big.new_split == "train" and small.count("val") == 18 and small.count("test") == 18  # the giant takes most of the share of train


def test_empty(spark):
    assert split(spark, []).count() == 0


def test_several_keys_join_through_components(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", "s"), (3, "y", "s"), (4, None, None), (5, "z", "t"), (6, None, "t")], "id bigint, author string, source string")
    got = {r.id: r.unit for r in grouping.linked_rows(rows, "id", [["author"], ["source"]]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    one = {r.id: r.unit for r in grouping.linked_rows(rows, "id", [["author"]]).collect()}
    assert one == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert grouping.linked_rows(rows.limit(0), "id", [["author"], ["source"]]).count() == 0


def test_torn_units_are_those_that_the_assignment_would_move(spark):
    for mask in range(8):
        for new in SHARES:
            df = spark.range(1).select(grouping.torn(F.lit(mask), F.lit(new)).alias("t"))
            if new == "train" or mask in (3, 5, 6, 7):
                assert df.first().t == (mask.bit_count() > 1), (mask, new)


def test_clashing_columns(spark):
    data = [(1, "p", 1, "a", "train", 9, 9, 9), (3, "p", 1, "a", "train", 9, 9, 9), (5, "p", 1, None, "train", 9, 9, 9), (2, "p", None, "a", "val", 9, 9, 9)]
    rows = grouping.linked_rows(spark.createDataFrame(data, ROWS + ", n int, mask int, rank int"), "row_id", [["source", "cluster"]])
    units = grouping.units_of(rows).withColumn("order_key", F.lit(0).cast("bigint")).withColumn("upto", F.lit("x")).drop("upto")
    got = {r.unit: (r.weight, r.stratum) for r in grouping.balance(units, SHARES).collect()}
    assert got == {1: (3, "a"), 2: (1, "a")}
