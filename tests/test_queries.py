"""Every engine query against its SQL in DuckDB, at the scale that results are graded at."""

import duckdb
import pytest

from ledgerline.plans import oracles, registry
from tests.conftest import same_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert same_rows(got, db.execute(oracles.oracle_sql()[name]).df())


def test_results_do_not_depend_on_partitions(spark):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(registry.queries()["trades"](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert same_rows(*results)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
