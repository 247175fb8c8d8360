"""The ORDER BY queries over every row, compared in order."""

import pytest
from compare import duck

from emberfold.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["order_nulls_asc_whole", "order_nulls_desc_whole", "order_ordinal_whole"])
def test_every_row_in_order(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    assert got == duck(FOLDER).sql(catalogue.ORACLE_SQL[name]).fetchall()
    assert len(got) == spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    if "nulls" in name:
        assert {r[1] is None for r in got} == {True, False}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "TakeOrdered" not in plan
