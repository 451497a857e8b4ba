import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm.sampling import draw

TARGETS = "stratum string, category string, target_bp int, min_rows int"


def rows_of(spark, counts):
    data, i = [], 0
    for (s, c), n in counts.items():
        for _ in range(n):
            data.append((i, s, c, "x", i % 3))
            i += 1
    return spark.createDataFrame(data, "row_id bigint, stratum string, category string, rank string, n int").repartition(5)


def test_shares_floors_and_report(spark):
    df = rows_of(spark, {("t", "big"): 700, ("t", "mid"): 200, ("t", "tiny"): 30, ("t", "rare"): 2, ("t", None): 68, (None, "big"): 50, ("v", "big"): 10})
    targets = spark.createDataFrame([("t", "big", 5000, 0), ("t", "mid", 4900, 0), ("t", "tiny", 50, 8), ("t", "rare", 50, 5), ("v", "gone", 10000, 0), ("w", "big", 10000, 1)], TARGETS)
    sample, report = draw(df, targets)
    drawn = Counter((r.stratum, r.category) for r in sample.collect())
    # a fifth of 1,000 rows: 100 big, 98 mid, 1 tiny raised to 8, 1 rare raised to the 2 there are
    assert drawn == {("t", "big"): 100, ("t", "mid"): 98, ("t", "tiny"): 8, ("t", "rare"): 2}
    r = {(x.stratum, x.category): x for x in report.collect()}
    assert {k for k, x in r.items() if x.unmet} == {("t", "rare"), ("v", "gone"), ("w", "big")}
    assert r["t", "rare"].missing == 3 and r["v", "gone"].missing == 2 and r["w", "big"].missing == 1 and r["t", "big"].missing == 0
    assert sample.select("row_id").distinct().count() == sum(drawn.values())


def test_what_a_target_lacks_goes_to_the_others(spark):
    df = rows_of(spark, {("t", "a"): 500, ("t", "b"): 400, ("t", "few"): 20, ("t", None): 80, ("v", "a"): 3, ("v", None): 97})
    targets = spark.createDataFrame([("t", "a", 3000, 0), ("t", "b", 2000, 0), ("t", "few", 4900, 0), ("t", "none", 100, 3), ("v", "a", 10000, 0)], TARGETS)
    sample, report = draw(df, targets)
    r = {(x.stratum, x.category): x for x in report.collect()}
    # of the 200 rows 20 are few; the other 180 are shared 3 : 2
    assert [r["t", c].drawn for c in ("a", "b", "few", "none")] == [108, 72, 20, 0]
    assert [r["t", c].unmet for c in ("a", "b", "few", "none")] == [False, False, True, True]
    assert r["t", "few"].missing == 78 and r["t", "a"].share_drawn == 0.54 and r["t", "a"].share_wanted == 0.3
    assert (r["v", "a"].drawn, r["v", "a"].unmet) == (3, True) and sample.filter("stratum = 'v'").count() == 3  # all there are


@pytest.mark.parametrize("seed", range(3))
def test_every_category_gets_its_expected_number_rounded(spark, seed):
    counts = {("t", f"c{i}"): 20 + 37 * i for i in range(8)}
    df = rows_of(spark, counts)
    bps = [333, 777, 1234, 2000, 1111, 2222, 1323, 1000]
    targets = spark.createDataFrame([("t", f"c{i}", b, 0) for i, b in enumerate(bps)], TARGETS)
    sample, report = draw(df, targets, seed=seed)
    n = sum(counts.values())
    total = 0
    for r in report.collect():
        want = min(r.target_bp * n / 50_000, r.available)
        assert math.floor(want) <= r.drawn <= math.ceil(want)
        total += want
    assert abs(sample.count() - total) < 1


def test_an_exactly_filled_target_is_met(spark):
    df = rows_of(spark, {("t", "a"): 2, ("t", "b"): 8})
    _, report = draw(df, spark.createDataFrame([("t", "a", 10000, 2)], TARGETS))
    assert report.first().unmet is False
    _, report = draw(df, spark.createDataFrame([("t", "a", 10000, 3)], TARGETS))
    assert report.first().unmet is True


def test_rows_are_drawn_evenly(spark):
    df = rows_of(spark, {("t", "a"): 400})
    targets = spark.createDataFrame([("t", "a", 10000, 0)], TARGETS)
    seen = Counter(r.row_id for s in range(6) for r in draw(df, targets, seed=s)[0].collect())
    assert sum(seen.values()) == 6 * 80 and len(seen) > 250


def test_empty_tables_and_repeats(spark):
    df = rows_of(spark, {("t", "a"): 10})
    targets = spark.createDataFrame([("t", "a", 10000, 1)], TARGETS)
    sample, report = draw(df.limit(0), targets)
    assert sample.count() == 0 and report.first().unmet is True and report.first().drawn == 0
    sample, report = draw(df, targets.limit(0))
    assert sample.count() == 0 and report.count() == 0
    twice = df.withColumn("row_id", F.lit(7))
    assert draw(twice, targets)[0].count() == 2
    assert [r.row_id for r in draw(df, targets)[0].orderBy("row_id").collect()] == [r.row_id for r in draw(df.repartition(1), targets)[0].orderBy("row_id").collect()]
