"""Sampling operators for evaluation sets: quotas for strata with one row a host, and splits that keep payloads whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import Scratch


def quota_sample(rows: DataFrame, key: str, host: str, strata: list[tuple[str, Column, int]], seed: str = "42") -> DataFrame:
    """(key, host, stratum): for each stratum in turn up to its quota of rows that meet its condition, in hash order, one for each host not taken before.

    Rows with a null host or condition take no part. A few strata, so the loop is short; what it keeps is as
    small as the quotas.
    """
    keep = Scratch(rows.sparkSession, "quota")
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    taken: DataFrame | None = None
    for name, condition, quota in strata:
        left = rows.where(condition & F.col(host).isNotNull())
        if taken is not None:
            left = left.join(taken.select(host).distinct(), host, "left_anti")
        # The least of each host is found by aggregation, so a hot host is one row before anything is ranked.
        best = left.select(F.col(host), F.struct(order.alias("h"), F.col(key).alias("k")).alias("s")).groupBy(host).agg(F.min("s").alias("s"))
        found = keep.put(best.orderBy("s.h", "s.k").limit(quota).select(F.col("s.k").alias(key), host, F.lit(name).alias("stratum")))
        taken = found if taken is None else taken.unionAll(found)
    return taken


def rebalance(rows: DataFrame, key: str, payload: str, split: str, share: float = 0.6) -> DataFrame:
    """(key, split): dev and heldout anew, each payload whole in one, dev as near below `share` of the rows as its payloads allow.

    A payload found in both splits goes to dev first, then those of dev, then those of heldout, each in hash
    order. For evaluation sets, which are small: the running sum is over payloads, in one partition.
    """
    groups = rows.groupBy(payload).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("splits"), F.min(split).alias("low"))
    rank = F.when(F.col("splits") > 1, 0).when(F.col("low") == "dev", 1).otherwise(2)
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    running = F.sum("n").over(W.orderBy("rank", "h", payload).rowsBetween(W.unboundedPreceding, 0))
    dealt = groups.withColumn("rank", rank).withColumn("h", F.xxhash64(payload)).withColumn("new", F.when((F.col("rank") == 0) | (running <= share * total), "dev").otherwise("heldout"))
    return rows.select(key, payload).join(dealt.select(payload, "new"), payload).select(key, F.col("new").alias(split))
