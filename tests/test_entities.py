"""Monitoring, lookups and changes of tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import changes, monitor, reference

T = [datetime(2024, 1, i) for i in range(1, 9)]
OBS = [(1, 20, T[0], "sick", 0.72, 5), (2, 30, T[2], "sick", 0.72, 6), (3, 30, T[1], "Healthy now", 0.81, None), (4, 30, T[3], None, None, 99), (5, None, T[4], "sick", 0.3, None)]


@pytest.fixture
def obs(spark):
    return spark.createDataFrame(OBS, "id bigint, plant_id bigint, created_at timestamp_ntz, health_status string, confidence double, image_id bigint").withColumn("predicted_disease", F.lit("x"))


@pytest.fixture
def plants(spark):
    return spark.createDataFrame([(10, "a"), (20, "b"), (30, "c"), (None, "d")], "id bigint, n_observations string").withColumn("rank", F.lit(7))


@pytest.fixture
def images(spark):
    return spark.createDataFrame([(5, 20, "p5", "n5"), (6, 30, "p6", "n6")], "id bigint, plant_id bigint, file_path string, file_name string")


def test_overview(obs, plants, rows):
    out = monitor.overview(plants, obs, "id", "plant_id", "id", "health_status")
    assert rows(out, "id", "n_observations", "latest_status") == [(10, 0, None), (20, 1, "sick"), (30, 3, None), (None, 0, None)]


def test_numbers_and_timeline(obs, images, rows):
    n = monitor.numbered(obs, "plant_id", "created_at", "id")
    assert rows(n, "id", "number_newest", "number_oldest") == [(1, 1, 1), (2, 2, 2), (3, 3, 1), (4, 1, 3), (5, 1, 1)]
    t = monitor.timeline(obs, images, "plant_id", "created_at", "id").filter("plant_id = 30")
    assert rows(t, "position", "at", "id", "image_path") == [(1, 0.0, 3, None), (2, 0.5, 2, "p6"), (3, 1.0, 4, None)]


def test_summary_and_compare(spark, obs, plants, rows):
    assert rows(monitor.timeline_summary(plants, obs, "id", "plant_id"), "id", "n_observations", "trend") == [(10, 0, "no_data"), (20, 1, "insufficient_data"), (30, 3, "insufficient_data"), (None, 0, "no_data")]
    assert rows(monitor.first_and_last(obs, "plant_id", "created_at", "id")) == [(30, 3, 4)]
    req = spark.createDataFrame([(30, 2, 3), (30, 1, 2), (20, 1, 1)], "entity bigint, id_1 bigint, id_2 bigint")
    assert rows(monitor.compare(obs, req, "plant_id", "id", ["confidence"])) == [(20, 1, 1, 0.72, 0.72), (30, 2, 3, 0.72, 0.81)]


def test_progress_of_the_sample(spark, obs):
    s = spark.createDataFrame([(1, i, c, "healthy" if h else "sick") for i, (c, h) in enumerate([(0.72, 0), (0.81, 0), (0.77, 1), (0.86, 1), (0.91, 1)])], "p int, id int, c double, s string")
    r = monitor.progress(s, "p", "id", "id", "c", "s").first()
    assert (r.n, r.n_healthy, r.trend) == (5, 3, "up") and r.mean_confidence == pytest.approx(0.814) and (r.axis_low, r.axis_high) == (pytest.approx(0.635), pytest.approx(0.995))
    p = {x.plant_id: x for x in monitor.progress(obs, "plant_id", "created_at", "id", "confidence", "health_status").collect()}
    assert p[20].trend is None and p[30].trend == "down" and p[30].n_healthy == 1
    none = monitor.progress(obs.filter("id = 4"), "plant_id", "created_at", "id", "confidence", "health_status").first()
    assert none.axis_low is None and none.mean_confidence is None


def test_sorted_map(spark):
    df = spark.createDataFrame([({"b": 0.5, "a": 0.5, "c": 0.9},), ({},), (None,)], "m map<string,double>")
    got = [r.x for r in df.select(monitor.sorted_map("m").alias("x")).collect()]
    assert [e.key for e in got[0]] == ["c", "a", "b"] and got[1] == [] and got[2] is None


def test_lookup_and_care_plan(spark, rows):
    kb = spark.createDataFrame([("Fig___rot", "Fig - rot", "d", "t")], "class string, common_name string, description string, treatment string")
    df = spark.createDataFrame([(1, "Fig___rot"), (2, "Foo_x___Bar_y"), (3, None)], "id int, cls string")
    assert rows(reference.lookup(df, "cls", kb, "dd", "tt"), "id", "common_name", "treatment", "known") == [(1, "Fig - rot", "t", True), (2, "Foo x - Bar y", "tt", False), (3, None, None, False)]
    plan = lambda b, n: (b, [b], [], [n], [])
    plans = spark.createDataFrame([plan("rot", "n1"), plan("gen", "n2"), plan("well", "n3")], "base string, actions array<string>, products array<string>, nutrition array<string>, prevention array<string>")
    cls = spark.createDataFrame([("Fig___rot",), ("Foo___x",), ("Fig___healthy",), (None,), ("Figgy___rot",)], "cls string")
    base = spark.createDataFrame([("Fig___rot", "rot"), ("Figgy___rot", "rot")], "class string, base string")
    nuance = spark.createDataFrame([("Fi", ["short"]), ("Figgy", ["long"])], "prefix string, nutrition array<string>")
    assert rows(reference.care_plans(cls, "cls", base, plans, nuance, "gen", "well").selectExpr("cls", "actions[0]", "nutrition[0]")) == [
        ("Fig___healthy", "well", "n3"), ("Fig___rot", "rot", "short"), ("Figgy___rot", "rot", "long"), ("Foo___x", "gen", "n2"), (None, None, None),
    ]


def test_changes(spark, rows):
    hist = spark.createDataFrame([("PG-000012",), ("PG-7",), ("bad",), (None,)], "code string")
    new = spark.createDataFrame([("b", 2), ("a", 1)], "name string, o int").withColumn("code", F.lit(None).cast("string"))
    assert rows(changes.next_ids(new, hist, "code", ["o"]), "name", "code") == [("a", "PG-000013"), ("b", "PG-000014")]
    assert rows(changes.next_ids(new, hist.limit(0), "code", ["o"]), "code") == [("PG-000001",), ("PG-000002",)]
    full = spark.createDataFrame([("PG-999999",), ("PG-99999999999999999999999",)], "code string")  # the latter is no number that ids could follow
    assert rows(changes.next_ids(new, full, "code", ["o"]), "code") == [("PG-1000000",), ("PG-1000001",)]
    maps = spark.createDataFrame([("v2", {"x": 2}, 1), ("v2", {"x": 1}, 1), ("v1", {}, 1)], "version string, classes map<string,int>, n int")
    assert rows(changes.insert_if_absent(maps.filter("version = 'v1'"), maps, "version"), "version", F.col("classes")["x"]) == [("v1", None), ("v2", 1)]
    old = spark.createDataFrame([(1, "x", "y"), (2, "x", "y"), (None, "q", "q")], "id int, a string, b string")
    patch = spark.createDataFrame([(1, None, True, "z", False), (9, "n", True, "n", True)], "id int, a string, has_a boolean, b string, has_b boolean")
    assert rows(changes.patch(old, patch, "id", ["a", "b"])) == [(1, None, "y"), (2, "x", "y"), (None, "q", "q")]
    assert rows(changes.insert_if_absent(old, spark.createDataFrame([(2, "n", "n"), (3, "n", "b"), (3, "n", "a"), (None, "n", "n")], old.schema), "id"), "id", "b") == [(1, "y"), (2, "y"), (3, "a"), (None, "q")]
    left = changes.delete_cascade(old.filter("id = 1"), "id", old, {"kids": (spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, fk int"), "fk")})
    assert left["entities"].count() == 2 and rows(left["kids"], "k") == [(2,), (3,)]


def test_append(obs, images, spark, rows):
    new = spark.createDataFrame([(30, T[6], "healthy", 0.9), (30, T[5], "sick", 0.8), (10, T[7], "sick", 0.1)], "plant_id bigint, created_at timestamp_ntz, health_status string, confidence double").withColumn("file_name", F.lit("up.png"))
    many = spark.range(999).select(F.col("id"), F.lit(5_000_000).cast("bigint").alias("plant_id"))
    up = new.filter("plant_id = 10").withColumn("plant_id", F.lit(5_000_000).cast("bigint"))
    assert rows(changes.append_observations(many, images, up)[1].filter("plant_id = 5000000"), "file_path") == [("data/plants/PG-5000000/observation_1000.jpg",)]
    o, i = changes.append_observations(obs, images, new)
    assert rows(o.filter("id > 5"), "id", "plant_id", "image_id", "confidence") == [(6, 30, 7, 0.8), (7, 30, 8, 0.9), (8, 10, 9, 0.1)]
    assert rows(i.filter("id > 6"), "id", "file_path") == [(7, "data/plants/PG-000030/observation_004.jpg"), (8, "data/plants/PG-000030/observation_005.jpg"), (9, "data/plants/PG-000010/observation_001.jpg")]
