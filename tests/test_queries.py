"""Every query with SQL gives the rows that DuckDB gives on the small tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from raterlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: v if isinstance(v, str) else None if v is None or pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tasks_of_a_panel_stay_small(spark, monkeypatch):
    """Partitions of units grow in number with the rows, where adaptive execution would join them; ab_compare stays the same."""
    from raterlake.operators import panel
    from raterlake.plans import catalog

    folder = "/root/testdata/sf0.01"
    whole = {r["measure"]: r[1:] for r in catalog.ab_compare(spark, folder).collect()}
    monkeypatch.setattr(panel, "TASK_ROWS", 1000, raising=False)
    sizes = [r["count"] for r in catalog.rated(spark, folder).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 10_000 and max(sizes) < 2_000
    out = catalog.ab_compare(spark, folder)
    assert {r["measure"]: r[1:] for r in out.collect()} == whole
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert "hashpartitioning(l_orderkey#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {-(-rows // 1000)}), REPARTITION_BY_NUM" in plan
