"""Properties that hold on any input, on random tables and on the test tables."""

import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import manifest, metrics, scoring, skew, split
from foliant.operators.ranking import ranked
from foliant.plans import catalog
from foliant.plans.etl import files

FOLDER = os.environ.get("FOLIANT_TEST_TABLES", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
key = st.sampled_from(["a", "b", "", None])


@few
@given(st.lists(st.lists(st.floats(-700, 700), min_size=1, max_size=6), min_size=1, max_size=20))
def test_softmax_is_a_distribution(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "l array<double>").select("l", scoring.softmax("l").alias("p"), scoring.argmax("l").alias("a"), scoring.top_k("l", 2).alias("t"))
    for r in df.collect():
        assert math.isclose(sum(r.p), 1, rel_tol=1e-9) and all(0 <= x <= 1 for x in r.p)
        assert r.a == r.l.index(max(r.l)) == r.t[0].idx


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.floats(-0.5, 1.5)), min_size=1, max_size=40))
def test_metrics_stay_in_range(spark, rows):
    df = spark.createDataFrame(rows, "y int, pred int, conf double")
    e = metrics.evaluation(df, "y", "pred", "conf").first()
    assert 0 <= e.ece <= 1 and 0 <= e.macro_f1 <= 1 and e.n == len(rows)
    assert math.isclose(e.accuracy, sum(y == p for y, p, _ in rows) / len(rows))
    assert metrics.confusion(df, "y", "pred").agg(F.sum("n")).first()[0] == len(rows)
    assert math.isclose(e.coverage, sum(c >= 0.55 for _, _, c in rows) / len(rows))


@few
@given(st.lists(st.tuples(key, st.one_of(st.none(), st.integers(-5, 5))), min_size=0, max_size=40), st.integers(1, 6))
def test_ranks_are_a_permutation(spark, rows, parts):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v int, i int").repartition(parts)
    got = ranked(df, ["k"], ["v", "i"], "v").collect()
    want = {}
    for k, v, i in sorted(((k, v, i) for i, (k, v) in enumerate(rows)), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        before = want.setdefault(k, [])
        before.append((i, len(before) + 1, sum(w or 0 for _, _, _, w in before), v))
    assert {r.i: (r.rank, r.before) for r in got} == {i: (n, b) for x in want.values() for i, n, b, _ in x}


@few
@given(st.lists(st.tuples(key, st.one_of(st.none(), st.integers(0, 9))), min_size=0, max_size=40))
def test_profiles_add_up(spark, rows):
    df = spark.createDataFrame(rows, "k string, v bigint")
    p = skew.key_profile(df, "k", "v").collect()
    assert sum(r.n_rows for r in p) == len(rows) and sum(r.total_size or 0 for r in p) == sum(v or 0 for _, v in rows)
    assert {r.key for r in p if r.is_hot} == {k for k, _ in rows if k is not None and 20 * sum(x == k for x, _ in rows) >= len(rows)}


@tables
def test_split_has_no_leaks(spark):
    f = files(spark, FOLDER).filter("cluster IS NOT NULL")
    s = split.assign(split.cluster_rollup(f, ["dataset", "cluster"], "label"), ["dataset", "cluster"])
    assert s.count() == f.select("dataset", "cluster").distinct().count() and s.filter("split IS NULL").count() == 0
    for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        x = r.n * 0.70
        assert r.t == (round(x))  # Python rounds halves to even as well


@tables
def test_dedup_is_idempotent_and_whole(spark):
    f = files(spark, FOLDER).filter("ok")
    once = manifest.keep_first(f, "md5", ["label", "path", "record_id"])
    assert once.count() == f.select("md5").distinct().count() == manifest.keep_first(once, "md5", ["label", "path", "record_id"]).count()
    assert once.count() + catalog.QUERIES["quarantine"](spark, FOLDER).filter("reason = 'duplicate'").count() == f.count()


@tables
@pytest.mark.parametrize("name", ["stratified_split", "neardup_clusters", "timeline", "p4_largest", "dense_cluster_ids"])
def test_results_do_not_depend_on_partitions(spark, name):
    got = []
    for n in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, catalog.QUERIES[name](spark, FOLDER).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
