"""Funding whose cents are a tie comes out as in SQL: the rates are the exact ten-thousandths."""

import oracle
from tidemark import registry


def test_funding_of_a_tie(spark, tmp_path):
    for name, of in (("orders", "o_custkey"), ("customer", "c_custkey")):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").where(f"{of} = 243").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    df = registry.QUERIES["a20_exposure_funding"](spark, str(tmp_path))
    assert oracle.differences(df, oracle.connect(str(tmp_path)), registry.ORACLES["a20_exposure_funding"]) == ""
