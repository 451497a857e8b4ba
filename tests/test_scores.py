import pytest
from pyspark.sql import functions as F

from foliant.operators import inference, metrics, scoring


def test_softmax_and_top_k(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([],), (None,), ([1.0, None],)], "l array<double>")
    p = [r.p for r in df.select(scoring.softmax("l").alias("p")).collect()]
    assert p[0] == pytest.approx([0.5, 0.5, 0.0]) and p[1:] == [None, None, None]
    t = df.limit(1).select(scoring.top_k("l", 2).alias("t"), scoring.argmax("l").alias("a")).first()
    assert [(x.idx, x.prob) for x in t.t] == [(0, 1000.0), (1, 1000.0)] and t.a == 0


def test_gate_and_status(spark):
    df = spark.createDataFrame([("Fig___healthy", 0.55), ("Fig___healthy", 0.5499), ("Fig___rot", 0.55), ("Fig___rot", 0.2), ("Fig___rot", None)], "c string, p double")
    got = df.select(scoring.gate("p"), scoring.health_status("c", scoring.gate("p")), scoring.reason("p"), scoring.service_status(scoring.gate("p"), "p")).collect()
    assert [tuple(r) for r in got] == [
        (True, "healthy", None, "active"), (False, "healthy", "confidence 54.99% is below 55%", "insufficient_confidence"), (True, "sick", None, "active"),
        (False, "unknown", "confidence 20.00% is below 55%", "insufficient_confidence"), (False, "unknown", "confidence unknown is below 55%", "unavailable"),
    ]


def test_predictions(spark):
    df = spark.createDataFrame([(1, [0.0, 9.0, 1.0]), (2, None)], "id int, l array<double>")
    a, b = scoring.predictions(df, "id", "l", ["A___healthy", "B___rot", "C"], k=2).orderBy("id").collect()
    assert (a.cls, a.accepted, a.status, a.severity) == ("B___rot", True, "sick", None) and [m["name"] for m in a.matches] == ["B - rot", "C"] and set(a.probabilities) == {"B___rot", "C"}
    assert (b.cls, b.accepted, b.service) == (None, False, "unavailable")


def test_quality_and_upload(spark):
    df = spark.createDataFrame([(64, 64, [0.0] * 8), (64, 64, [1.0] * 8), (64, 64, [0.5] * 8), (320, 64, [0.0, 1.0]), (0, 9, None), (256, 64, [0.2, 0.8])], "w int, h int, v array<double>")
    assert [r.x for r in df.select(scoring.quality_warnings("w", "h", "v").alias("x")).collect()] == [["black", "uniform"], ["white", "uniform"], ["uniform"], ["aspect"], ["aspect"], []]
    up = spark.createDataFrame([("a.gif", 5), ("a.JPG", 10 * 1024**2), ("a.jpg", 10 * 1024**2 + 1), ("a.png", 0), ("", 3), (None, 3)], "n string, s bigint")
    assert [r.x for r in up.select(scoring.upload_problem("n", "s").alias("x")).collect()] == ["type", None, "too_large", "empty", "no_file", "no_file"]
    assert spark.range(1).select(scoring.attention_share(F.array(F.lit(0.4), F.lit(0.5), F.lit(0.6))).alias("x")).first().x == 0.6667


S = "y int, pred int, conf double"


def test_metrics(spark, rows):
    df = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.6), (1, 1, 0.5), (2, 1, 0.4), (None, 1, 0.9), (1, None, 0.9)], S)
    assert rows(metrics.confusion(df, "y", "pred")) == [(0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert rows(metrics.per_class(df, "y", "pred")) == [(0, 1.0, 0.5, pytest.approx(2 / 3), 2), (1, pytest.approx(1 / 3), 1.0, 0.5, 1), (2, 0.0, 0.0, 0.0, 1)]
    assert metrics.macro_f1(df, "y", "pred").first().macro_f1 == pytest.approx((2 / 3 + 0.5) / 3)
    given = spark.createDataFrame([(0,), (7,)], "label int")
    assert rows(metrics.per_class(df, "y", "pred", given), "label", "support") == [(0, 2), (7, 0)]
    c = metrics.coverage(df, "y", "pred", "conf").first()
    assert (c.n, c.accuracy, c.coverage, c.accepted_accuracy, c.rejected_accuracy) == (4, 0.5, 0.5, 0.5, 0.5)
    assert rows(metrics.worst(df, "y", "pred", 2), "label") == [(0,), (2,)]
    assert metrics.coverage(df.limit(0), "y", "pred", "conf").first().accuracy is None


def test_calibration_gap(spark):
    df = spark.createDataFrame([(0, 0, 0.55), (0, 1, 0.55), (0, 0, 0.95), (0, 0, 1.0), (0, 0, 1.5)], S)
    e = metrics.ece(df, "y", "pred", "conf").first()
    assert e.ece == pytest.approx((2 * 0.05 + 3 * (1 - (0.95 + 1 + 1) / 3)) / 5) and e.ece_ref == 0
    assert metrics.ece(df.limit(0), "y", "pred", "conf").first().ece is None
    full = spark.createDataFrame([(0, 0, i / 10 + 0.05) for i in range(10)], S)
    e = metrics.ece(full, "y", "pred", "conf").first()
    assert e.ece == pytest.approx(e.ece_ref)


def test_training_figures(spark, rows):
    b = spark.createDataFrame([(1, 2.0, 3, 4, 1.0), (1, 1.0, 1, 2, 1.0)], "e int, loss double, correct int, n int, s double")
    assert rows(metrics.epochs(b, ["e"], "loss", "correct", "n", "s")) == [(1, pytest.approx(10 / 6), pytest.approx(4 / 6), 3.0)]
    h = spark.createDataFrame([("p", i, s) for i, s in enumerate([0.5, 0.4, 0.45, 0.9])], "ph string, e int, s double")
    assert rows(metrics.patience(h, "ph", "e", "s"), "e", "improved", "stopped") == [(0, True, False), (1, False, False), (2, False, False), (3, True, True)]
    assert metrics.best_of(h, "s").first().best == 0.9 and metrics.best_of(h.limit(0), "s").first().best == 0


def test_payload(spark):
    df = spark.createDataFrame([(1, [0.0, 9.0]), (2, [0.1, 0.0]), (3, [0.0, 0.1]), (4, None)], "id int, l array<double>")
    kb = spark.createDataFrame([("B___rot", "B - rot", "soft", "cut")], "class string, common_name string, description string, treatment string")
    plans = spark.createDataFrame([("B___rot", ["a"], [], ["n"], ["p"])], "class string, actions array<string>, products array<string>, nutrition array<string>, prevention array<string>")
    a, b, c, d = scoring.payload(df, "id", "l", ["A___healthy", "B___rot"], kb, plans, threshold=0.9).orderBy("id").collect()
    assert a.accepted and a.diagnosis.name == "B - rot" and a.care_plan.actions == ["a"] and a.treatment_recommendations[0].guidance == "cut"
    assert not b.accepted and b.disease_health_status == "healthy" and b.treatment_recommendations == [] and b.care_plan is None
    assert c.disease_health_status == "unknown" and len(c.treatment_recommendations) == 1 and c.care_plan is None
    assert d.matches is None and d.treatment_recommendations == [] and d.confidence_threshold.met is False


def test_evaluation(spark):
    e = metrics.evaluation(spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.6), (1, 1, 0.5)], S), "y", "pred", "conf").first()
    assert e.per_class["0"].recall == 0.5 and [w.label for w in e.worst_classes] == [0, 1] and e.n == 3 and e.classes == 2 and e.ece is not None


def test_inference(spark):
    def load():
        return lambda x: x[:, :2] * 2

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "id int, x array<float>")
    assert [r.logits for r in inference.score(df, "x", load, 3).orderBy("id").collect()] == [[2.0, 4.0], None]
