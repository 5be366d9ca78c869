"""Ordered work by slices against plain loops, with null groups and rows far off; and its plan."""

import random
import re

from pyspark.sql import functions as F

from quire.operators import scale
from quire.plans import logs

SF = "/root/testdata/sf0.001"


def made_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.randrange(200), i, rng.randrange(9)) for i in range(300)] + [("a", 1, 10**9, 900, 3)]
    return rows, spark.createDataFrame(rows, "g string, h int, at long, id long, x int")


def test_slices_equal_one_pass(spark):
    rows, df = made_up(spark)
    want = {}
    for key in {r[:2] for r in rows}:
        total, most, before, n = 0, None, None, 0
        for _, _, at, i, x in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:4]):
            n, total = n + 1, total + x
            want[i] = (total, most, before, n)
            most, before = x if most is None else max(most, x), x
    for width in (7, 50, 10**12):
        args = (["g", "h"], F.col("at"), ["at", "id"])
        out = scale.running_total(df, *args, F.col("x"), "total", width)
        out = scale.greatest_before(out, *args, F.col("x"), "most", width)
        out = scale.previous(out, *args, "x", "before", width)
        out = scale.numbered(out, *args, "n", width)
        assert {r.id: (r.total, r.most, r.before, r.n) for r in out.collect()} == want
        assert out.columns == [*df.columns, "total", "most", "before", "n"]


def test_few_exchanges_of_the_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query, most in (("sessions", 5), ("token_bucket", 6), ("event_frames", 15)):
            plan = logs.QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange (hash|range)partitioning", plan)) <= most, query
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
