"""Declared tables, lookups, states at a moment, names of uploads and the input of models."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import changes, metrics, monitor, profile
from foliant.plans import schemas
from foliant.sources import pixels

T = datetime.datetime


def test_tables_are_made_once_and_conform(spark, tmp_path, rows):
    made = schemas.create_if_missing(spark, str(tmp_path))
    assert sorted(made) == sorted(schemas.TABLES) and schemas.create_if_missing(spark, str(tmp_path)) == []
    for name in schemas.TABLES:
        df = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.declared(name)] and df.count() == 0
    odd = spark.createDataFrame([("7", 1, "x"), (None, 2, "y")], "id string, plant_id int, more string")
    got = schemas.conform(odd, "treatments")
    assert got.columns == [f.name for f in schemas.declared("treatments")] and rows(got, "id", "plant_id", "notes") == [(7, 1, None), (None, 2, None)]
    assert rows(schemas.violations(got, "treatments")) == [("id", 1), ("plant_id", 0), ("treatment_name", 2)]
    assert rows(schemas.violations(got.limit(0), "treatments"), "n") == [(0,), (0,), (0,)]


def test_a_moment_and_the_clock(spark, rows):
    df = spark.createDataFrame([(1, T(2024, 1, 1)), (2, T(2024, 1, 2)), (3, None), (4, T(2999, 1, 1))], "id int, at timestamp_ntz")
    assert rows(monitor.as_of(df, "at", "2024-01-01 00:00:00"), "id") == [(1,)]
    assert rows(monitor.as_of(df, "at"), "id") == [(1,), (2,)]


def test_lookups_say_what_was_not_found(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, v int")
    asked = spark.createDataFrame([("a",), ("b",), ("z",), (None,), ("a",)], "k string")
    assert rows(monitor.find(asked, df, "k"), "k", "v", "found") == [("a", 1, True), ("a", 1, True), ("b", None, True), ("z", None, False), (None, None, False)]


def test_only_empty_diagnoses_are_filled(spark):
    kind = "struct<disease:string,health_status:string,confidence:double,model_version:string,timestamp:string>"
    plants = spark.createDataFrame([(1, None), (2, (None, None, None, None, None)), (3, ("old", None, None, None, None)), (4, None)], f"id bigint, initial_diagnosis {kind}")
    first = spark.createDataFrame([(i, "new", "sick", 0.5, "v", "d") for i in (1, 2, 3, None)], "plant bigint, disease string, health_status string, confidence double, model_version string, date string")
    got = {r.id: r.initial_diagnosis for r in changes.fill_diagnosis(plants, first, "id", "plant").collect()}
    assert got[1].disease == got[2].disease == "new" and got[1].timestamp == "d" and got[3].disease == "old" and got[4] is None


def test_names_of_uploads(spark):
    df = spark.createDataFrame([("PG-000001", 3), ("PG-000001", 1000), (None, 3), ("PG-000001", 0), ("PG-000001", None)], "c string, n int")
    got = [r.p for r in df.select(changes.stored_path("c", "n", F.lit("0123456789ab")).alias("p")).collect()]
    assert got == ["PG-000001/observation_003.jpg", "PG-000001/observation_1000.jpg", "01234567.jpg", "01234567.jpg", "01234567.jpg"]
    two = [r.d for r in spark.range(2).select(changes.random_digits().alias("d")).collect()]
    assert two[0] != two[1] and all(len(d) == 32 and int(d, 16) >= 0 for d in two)


def test_summary_and_text(spark, rows):
    df = spark.createDataFrame([("d", "A", "jpg", True, "m", 1, 1, 1), ("d", "A", "jpg", False, None, 1, 1, 1)], "g string, l string, s string, ok boolean, m string, z bigint, w int, h int")
    report = lambda x: profile.report(x, "g", "l", "s", "ok", "m", "z", "w", "h")
    assert rows(profile.summary(report(df))) == [(1, 1, 1)] and rows(profile.summary(report(df.limit(0)))) == [(0, 0, 0)]
    per = spark.createDataFrame([("a", 0.5, 1.0, 2 / 3, 7)], "label string, precision double, recall double, f1 double, support bigint")
    assert metrics.text_report(per).first().line.split() == ["a", "0.50", "1.00", "0.67", "7"]


def test_text_is_rounded_by_the_exact_value(spark):
    figures = [0.0, 1.0, 0.075, 0.145, 0.155, 0.125, 0.375, 0.005, 0.015, 0.995, 0.29] + [(2 * k + 1) / 200 for k in range(100)] + [a / b for b in (3, 7, 46, 200, 800) for a in range(b + 1)]
    per = spark.createDataFrame([(str(i), x, x, x, i) for i, x in enumerate(figures)], "label string, precision double, recall double, f1 double, support bigint")
    got = {r.label: r.line for r in metrics.text_report(per).collect()}
    assert got == {str(i): f"{i!s:<12} {x:9.2f} {x:9.2f} {x:9.2f} {i:9d}" for i, x in enumerate(figures)}


def test_model_input_is_resized_cut_and_normalised():
    rng = np.random.default_rng(0)
    for h, w in ((40, 70), (70, 40), (50, 50)):
        rgb = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        got = pixels.model_input(rgb, 32)
        assert got.shape == (3, 32, 32) and got.dtype == np.float32
        short = 36  # 32 * 1.14
        to = (short, short * w // h) if h <= w else (short * h // w, short)
        top, left = (round((n - 32) / 2) for n in to)

        def at(g, y, x):  # the mean of the pixels under the filter, straight from its definition
            def side(n, m, i):
                scale = n / m
                reach = max(scale, 1.0)
                k = [max(0.0, 1 - abs((j + 0.5 - (i + 0.5) * scale) / reach)) for j in range(n)]
                return [v / sum(k) for v in k]

            a, b = side(h, to[0], y + top), side(w, to[1], x + left)
            return sum(a[j] * b[i] * float(g[j, i]) for j in range(h) for i in range(w) if a[j] and b[i])

        for c, y, x in ((0, 0, 0), (1, 15, 31), (2, 31, 7)):
            want = (at(rgb[..., c], y, x) / 255 - pixels.MEANS[c]) / pixels.DEVIATIONS[c]
            assert abs(got[c, y, x] - want) < 0.02
    same = np.full((20, 20, 3), 255, np.uint8)
    assert np.allclose(pixels.model_input(same, 16)[:, 3, 3], [(1 - m) / d for m, d in zip(pixels.MEANS, pixels.DEVIATIONS)], atol=1e-6)
