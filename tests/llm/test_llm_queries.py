"""The queries of the training-data operators against their SQL."""

import glob
import os
from pathlib import Path

import pytest

from foliant.llm import queries

FOLDER = os.environ.get("FOLIANT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = [columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_the_others_run(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() >= 0


def test_assignments_are_whole(spark):
    from foliant.plans.tables import table

    n = table(spark, FOLDER, "split_csv").count()
    a = queries.p5_assignment(spark, FOLDER)
    assert a.count() == n == a.select("record_id").distinct().count() and a.filter("split IS NULL").count() == 0


def test_shares_count_records_by_their_own_labels(spark, tmp_path):
    rows = [(1, "d", 1, "Fig", "train"), (2, "d", 1, "Fig", "train"), (3, "d", 1, "Hop", "val"), (4, "d", 1, None, "val"), (5, "d", None, "Fig", "test"), (6, "d", None, None, "test")]
    spark.createDataFrame(rows, "record_id bigint, dataset string, cluster int, label string, split string").write.parquet(str(tmp_path / "split_csv.parquet"))
    split = {r.record_id: r.split for r in queries.p5_assignment(spark, str(tmp_path)).collect()}
    want = {}
    for i, _, _, label, _ in rows:
        x = want.setdefault(label and label.lower(), [0, 0, 0, 0])
        x[0] += 1
        x[1 + list(queries.SHARES).index(split[i])] += 1
    got = {r.label: [r.n_rows, r.n_train, r.n_val, r.n_test] for r in queries.p5_shares(spark, str(tmp_path)).collect()}
    assert got == want and got["hop"][0] == 1
