"""Every registered core query against its SQL, and what each query must have."""

import glob
import os
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from foliant.plans import catalog  # noqa: E402

FOLDER = os.environ.get("FOLIANT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    return None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def test_entry_is_complete(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_import_the_training_part():
    root = Path(__file__).resolve().parents[1] / "foliant"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"foliant\.llm|from \.+llm", p.read_text()), p


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["p4_found"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0].count(",") <= 1
    # the rankings store their rows, so the scans that feed them are looked at by themselves
    from foliant.plans.etl import files

    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = text(files(spark, FOLDER).filter("split = 'train'").select("record_id", "label", "path"))
    assert "ReadSchema: struct<record_id:bigint,label:string,path:string,split:string>" in p
    from foliant.plans.tables import table as read

    p = text(read(spark, FOLDER, "images").filter("plant_id IS NULL").select("id"))
    assert "PushedFilters: [IsNull(plant_id)]" in p and "ReadSchema: struct<id:bigint,plant_id:bigint>" in p
    p = text(catalog.QUERIES["dedup_manifest"](spark, FOLDER))  # one row for each checksum and task is shuffled
    assert p.count("WindowGroupLimit") >= 1 and "SortAggregate" not in p


def test_a_cluster_needs_a_shared_folder():
    from foliant.plans import workspace

    class Option:
        def isDefined(self):
            return False

    class Fake:
        def __init__(self, master):
            self.master, self.applicationId, self._jsc, self.sparkContext, self.conf = master, "app", self, self, self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Option()

        def get(self, key, default):
            return default

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            workspace.shared_folder(Fake(master))
