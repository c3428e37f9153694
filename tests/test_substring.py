"""The trigram index: what it stores of a long value, and values of one key."""

import glob

import pytest
from pyspark.sql import functions as F

from newsloom.operators import substring


def test_trigrams_do_not_repeat_the_value(spark, tmp_path):
    long = "".join(f"{i:05d}ab" for i in range(3000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "xé\U0001f600ab"), (4, None), (5, "ab")], "i int, v string")
    path = substring.build(df, "v", str(tmp_path / "index"))
    stored = spark.read.parquet(path)
    assert {*stored.columns} == {"gram", "key", "bucket"}
    assert {r.gram for r in stored.where(stored.key == spark.range(1).select(F.xxhash64(F.lit("xé\U0001f600ab"))).first()[0]).collect()} == {"xé\U0001f600", "é\U0001f600a", "\U0001f600ab"}
    assert stored.count() == len({long[i : i + 3] for i in range(len(long) - 2)}) + 3
    assert {r.i for r in substring.search(df, "v", "%02999ab", path).collect()} == {1, 2}
    assert glob.glob(f"{path}/bucket=*")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_short_values(spark, n):
    got = spark.createDataFrame([("aßc\U0001f600"[:n],)], "v string").select(substring.grams(F.col("v"))).first()[0]
    assert got == [("aßc\U0001f600")[i : i + 3] for i in range(max(0, n - 2))]
