"""Rows of a null group stay in the result."""

from pyspark.sql import functions as F

from quire.operators import detection as D


def test_cap_entities_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3), (None, "a", 4), (None, None, 5)], "doc int, kind string, n int")
    got = D.cap_entities(df, ["doc", "kind"], F.col("n"), 1)
    assert {r.n: r.checked for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True} and got.columns == ["doc", "kind", "n", "checked"]
