import pytest

from tallyloom.operators.lookup import hot_key_join


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(600)], "txn_id long, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3)], "k string, v int")
    plain = hot_key_join(left, lookup, ["k"], how, salted=False)
    salted = hot_key_join(left, lookup, ["k"], how, salted=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_salts_when_skew_is_not_divided_at_run_time(spark):
    left = spark.createDataFrame([(1, "a")], "txn_id long, k string")
    lookup = spark.createDataFrame([("a", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        assert "_salt" in hot_key_join(left, lookup, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert "_salt" not in hot_key_join(left, lookup, ["k"])._jdf.queryExecution().optimizedPlan().toString()
