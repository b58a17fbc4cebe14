import os
import sys

import duckdb
import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..")
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402
from inkloom import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(value):
    return round(value, 6) if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations", "events"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = base.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted([[plain(r[n]) for n in names] for r in got.collect()], key=repr) == sorted([[plain(v) for v in r] for r in rows], key=repr)


def test_entry_and_registration(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_training_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "inkloom")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert "inkloom.llm" not in file.read()
