"""Ranking, skewed keys, profiles, manifests and splits."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import manifest, profile, skew, split
from foliant.operators.ranking import ranked


def test_ranked_matches_a_window(spark):
    rnd = random.Random(1)
    # one key holds most rows, one is null, weights are null now and then; clashing columns are replaced
    data = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}", i, rnd.randrange(9) if i % 7 else None, -1, "x") for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, w int, rank int, before string").repartition(7)
    got = ranked(df, ["k"], ["i"], "w").toPandas().sort_values("i")
    p = pd.DataFrame(data, columns=["k", "i", "w", "rank", "before"]).fillna({"k": "~", "w": 0}).sort_values("i")
    g = p.groupby("k")
    assert got["rank"].tolist() == (g.cumcount() + 1).tolist()
    assert got["group_rows"].tolist() == g["i"].transform("size").tolist()
    assert got["before"].tolist() == (g["w"].cumsum() - p["w"]).tolist()
    assert got["group_weight"].tolist() == g["w"].transform("sum").tolist()


def test_ranked_over_all_rows_ties_and_empty(spark):
    df = spark.createDataFrame([(5,)] * 9 + [(1,)], "x int")
    got = sorted((r.rank, r.x) for r in ranked(df, [], ["x"]).collect())
    assert got == [(1, 1)] + [(i, 5) for i in range(2, 11)]
    assert ranked(df.filter("x > 9"), ["x"], ["x"]).count() == 0


def test_key_profile(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 5), ("b", 2), (None, 7)], "k string, s int").withColumn("key", F.lit(0))
    assert rows(skew.key_profile(df, "k", "s", (2, 5)), "key", "n_rows", "n_sized", "total_size", "min_size", "max_size", "share", "is_hot") == [
        ("a", 3, 2, 6, 1, 5, 0.6, True), ("b", 1, 1, 2, 2, 2, 0.2, False), (None, 1, 1, 7, 7, 7, 0.2, False),
    ]
    assert skew.key_profile(df.limit(0), "k", "s").count() == 0
    assert rows(skew.key_profile(df, "k", "s", (3, 5)).filter("is_hot"), "key") == [("a",)]  # exactly the share


def test_largest_per_key_limits_before_the_shuffle(spark, rows):
    df = spark.createDataFrame([("a", i, i % 4) for i in range(10)] + [(None, 10, 1), ("b", 11, None)], "k string, id int, s int")
    top = skew.largest_per_key(df, "k", "s", "id", 2)
    assert rows(top, "key", "rank", "row_id", "size") == [("a", 1, 3, 3), ("a", 2, 7, 3), (None, 1, 10, 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


@pytest.mark.parametrize("seed", [1, 3])
def test_median(spark, seed):
    rnd = random.Random(seed)
    data = [("hot" if i % 3 else rnd.choice("abc"), rnd.choice([rnd.randrange(50), rnd.randrange(10**6), None])) for i in range(800)] + [("one", 4), ("none", None), (None, 2), (None, 3)]
    got = {r.k: r.median for r in skew.exact_medians(spark.createDataFrame(data, "k string, v bigint"), ["k"], ["v"]).collect()}
    p = pd.DataFrame(data, columns=["k", "v"]).dropna(subset=["v"]).fillna({"k": "~"}).groupby("k")["v"].median()
    assert {k or "~": v for k, v in got.items()} == p.to_dict()


FILES = [
    ("d", "A", "p1", "m1", 10, 100, 50, True), ("d", "B", "p0", "m1", 10, 60, 200, True), ("d", "A", "p2", None, 4, 0, 0, False),
    ("d", "A healthy", "p3", "m2", 7, 64, 64, True), ("e", "A", "p4", "m1", 10, 100, 100, True), ("e", None, "p5", "", None, None, None, None),
]
SCHEMA = "ds string, label string, path string, md5 string, size bigint, width int, height int, ok boolean"


def test_profiles(spark, rows):
    df = spark.createDataFrame(FILES, SCHEMA)
    assert rows(profile.imbalance(df, "ds", "label"), "ds", "classes", "n", "min_n", "max_n", "imbalance") == [("d", 3, 4, 1, 2, 2.0), ("e", 2, 2, 1, 1, 1.0)]
    assert rows(profile.integrity(df, "ds", "ok")) == [("d", 4, 3, 1, 0), ("e", 2, 1, 1, 0)]
    assert rows(profile.duplicate_groups(df.filter("ok"), "md5", "size")) == [("m1", 3, 20, 2)]
    t = {r.ds if not r.is_total else "*": r for r in profile.totals(df, "ds", "ok", "md5", "size").collect()}
    assert (t["*"].n_files, t["*"].n_ok, t["*"].dup_files, t["d"].dup_files, t["d"].wasted_bytes, t["e"].dup_groups) == (6, 4, 1, 1, 10, 0)
    s = profile.size_profile(df, "ds", "size", "width", "height").filter("ds = 'd'").first()
    assert (s.min_width, s.min_height, s.median_size, s.n_tiny) == (0, 0, 8.5, 3)
    assert rows(profile.tasks_supported(df, "ds", "label", ("d",)), "ds", "plant_identification", "health_classification", "disease_classification") == [("d", True, True, True), ("e", False, False, True)]
    assert rows(profile.value_counts(df, ["md5"], "ds").filter("ds = 'e'"), "value", "n") == [("", 1), ("m1", 1)]
    assert profile.first_examples(df, "ds", ["path"], 1).count() == 2
    for f in (lambda x: profile.imbalance(x, "ds", "label"), lambda x: profile.size_profile(x, "ds", "size", "width", "height"), lambda x: profile.duplicate_groups(x, "md5", "size")):
        assert f(df.limit(0)).count() == 0


def test_keep_first_and_quarantine(spark, rows):
    df = spark.createDataFrame(FILES, SCHEMA).withColumn("md5", F.nullif("md5", F.lit("")))
    kept = manifest.keep_first(df, "md5", ["label", "path"])
    assert rows(kept, "path", "label") == [("p1", "A"), ("p2", "A"), ("p3", "A healthy"), ("p5", None)]  # across labels and datasets; null sums are all kept
    assert rows(manifest.keep_first(kept, "md5", ["label", "path"])) == rows(kept)
    q = manifest.quarantine(df.filter("path <> 'p5'"), "path", "label", "ok", "md5", ["label", "path"])
    assert rows(q, "path", "reason") == [("p0", "duplicate"), ("p2", "corrupt"), ("p4", "duplicate")]


def test_numbers(spark, rows):
    df = spark.createDataFrame([("x", 3), ("y", 1), (None, 2), ("x", 0), ("y", 5)], "g string, o int")
    assert rows(manifest.dense_ids(df, "g", ["o"], "c"), "o", "c") == [(0, 0), (1, 1), (2, 2), (3, 0), (5, 1)]
    assert rows(manifest.row_ids(df, ["o"], "c"), "o", "c") == [(0, 0), (1, 1), (2, 2), (3, 3), (5, 4)]
    assert rows(manifest.label_index(df, "g")) == [("x", 0), ("y", 1)]


def test_samples(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "l string, i int")
    assert rows(manifest.fraction_per_label(df, "l", ["i"], 0.25)) == [("a", 0), ("a", 1), ("b", 1)]  # rint(2.5) = 2, at least 1
    with pytest.raises(ValueError):
        manifest.fraction_per_label(df, "l", ["i"], 0)
    ids = spark.range(500)
    a, b = (rows(manifest.hash_sample(x, "id", 50, 7)) for x in (ids, ids.repartition(9)))
    assert len(a) == 50 and a == b and manifest.hash_sample(ids, "id", 900, 7).count() == 500


@pytest.mark.parametrize("n,train,val", [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 3, 1), (5, 4, 1), (6, 4, 1), (10, 7, 2), (15, 10, 2), (30, 21, 4), (50, 35, 8), (90, 63, 14)])
def test_split_rounding(spark, n, train, val):
    s = [r.split for r in split.assign(spark.createDataFrame([(i, "a", 1) for i in range(n)], "c int, label string, size int"), ["c"]).collect()]
    assert (s.count("train"), s.count("val"), len(s)) == (train, val, n)


def test_split_by_cluster(spark, rows):
    df = spark.createDataFrame([(c, "a") for c in (0, 1, 2, 3, 4, 5, 5, 5, 5, 5)], "c int, label string")
    s = split.assign(split.cluster_rollup(df, ["c"], "label"), ["c"])
    assert dict(rows(s.groupBy("split").agg(F.sum("size")))) == {"train": 4, "val": 1, "test": 5}
    assert rows(s.filter("size = 5"), "split") == [("test",)]
    assert rows(split.split_counts(s, "label", "split")) == [("a", 4, 1, 1)]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "l string")
    w = {r.l: r for r in split.class_weights(df, "l").collect()}
    assert abs(w["b"].weight_inverse - 1.5) < 1e-9 and abs(w["a"].weight_balanced - 0.25) < 1e-9 and len(w) == 2
    x = {r.l: r.weight for r in split.label_weights(df, spark.createDataFrame([("a",), ("c",)], "l string"), "l").collect()}
    assert abs(x["a"] - 0.5) < 1e-9 and abs(x["c"] - 1.5) < 1e-9
