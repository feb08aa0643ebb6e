"""Draws of many units against the rows that `bootstrap` joins, and MD5 of many keys against hashlib."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from rankflow.operators import resample


def test_uniforms_equal_md5():
    for prefix, first, stop in (("cutoff|7|", 0, 10), ("cutoff|1999|", 998, 1000), ("a", 10**6, 10**6 + 50), ("x" * 40 + "|", 123456, 123480)):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(first, stop)]
        assert resample.uniforms(prefix, first, stop).tolist() == want


def test_many_units_draw_alike(spark):
    rows = spark.range(260).select(F.when(F.col("id") < 40, "day").otherwise("race").alias("kind"), F.col("id").alias("name"), (F.col("id") % 9 + 1).alias("rows"), (F.col("id") % 13 / 7 - 1).alias("a"), (F.col("id") % 5 / 3 - 1).alias("b"))
    units = resample.numbered(rows, ["name"], ["kind"])
    get = lambda df: {(r["kind"], r["rep"]): (r["ratio_a"], r["ratio_b"]) for r in df.collect()}
    want, got = (get(f(units, ["a", "b"], "rows", 21, "s", ["kind"])) for f in (resample.bootstrap, resample.bootstrap_many))
    assert want.keys() == got.keys() and len(got) == 42
    assert all(np.allclose(want[k], got[k], rtol=0, atol=1e-12) for k in want)
    assert "Join" not in resample.bootstrap_many(units, ["a", "b"], "rows", 21, "s", ["kind"])._jdf.queryExecution().executedPlan().toString()
