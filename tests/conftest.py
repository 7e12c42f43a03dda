import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def same_rows(a, b):
    """Whether two pandas frames hold the same rows in any order."""
    import pandas as pd

    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda f: sorted((tuple("NULL" if not isinstance(x, (list, dict)) and pd.isna(x) else x for x in r) for r in f[cols].itertuples(index=False)), key=str)
    return key(a) == key(b)
