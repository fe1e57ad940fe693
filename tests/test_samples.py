from pyspark.sql import functions as F

from weftline.operators.samples import quota_sample, rebalance


def test_quota_and_hosts(spark):
    df = spark.createDataFrame([(i, f"h{i % 9}" if i % 7 else None, i) for i in range(100)], "id BIGINT, host STRING, v INT")
    got = quota_sample(df, "id", "host", [("low", F.col("v") < 30, 3), ("rest", F.col("v") >= 0, 20)]).collect()
    assert len({r.host for r in got}) == len(got) == 9
    assert [r.stratum for r in got].count("low") == 3 and all(r.id < 30 for r in got if r.stratum == "low")
    assert quota_sample(df.limit(0), "id", "host", [("low", F.col("v") < 30, 3)]).isEmpty()


def test_payloads_stay_whole(spark):
    df = spark.createDataFrame([(i, f"p{i // 2}" if i < 20 else f"q{i}", "dev" if i % 3 else "heldout") for i in range(100)], "id BIGINT, payload STRING, split STRING")
    new = rebalance(df, "id", "payload", "split")
    assert new.count() == 100 and new.join(df.select("id", "payload"), "id").groupBy("payload").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert 58 <= new.where("split = 'dev'").count() <= 60
    assert rebalance(df.limit(0), "id", "payload", "split").isEmpty()
