"""Splits that keep related records together.

Records that share a site or an author, directly or through others, form a group; a group lies in
one split. Groups come from `components.connected_components` over a graph of sites and authors
(not of records, so a site with a third of all rows is one node). Groups are assigned in the order
of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.names import person, site, split_name
from weftline.operators.components import connected_components
from weftline.session import Scratch

SPLITS = ("train", "validation", "test")
ORDERS = 16  # hash orders of which the best is taken
BUCKETS = 1024  # ranges of hash order


def _node(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.xxhash64(F.lit(kind), key))


def record_groups(spark: SparkSession, stress: DataFrame, flags: DataFrame) -> DataFrame:
    """(raw_id, group_id, split) for each distinct raw_id of `stress`.

    Rows repeated whole count once; a null raw_id is left out. Sites come from `flags`, with the host of
    href for a null hostname. A record with neither site nor author is a group of its own. split is null
    where it is none of train, validation and test. If one raw_id has several authors, all of them link.
    """
    keep = Scratch(spark, "groups")
    hosts = flags.where("raw_id IS NOT NULL").select("raw_id", site(F.col("hostname"), F.col("href")).alias("site")).groupBy("raw_id").agg(F.min("site").alias("site"))
    rows = (
        stress.where("raw_id IS NOT NULL")
        .select("raw_id", person(F.col("author")).alias("author"), split_name(F.col("split")).alias("split"))
        .distinct()
        .join(hosts, "raw_id", "left")
        .select("raw_id", "split", _node("site", F.col("site")).alias("a"), _node("author", F.col("author")).alias("b"))
    )
    rows = keep.put(rows)
    found = connected_components(spark, rows.select("a", "b"))
    anchor = F.coalesce("a", "b", F.xxhash64(F.lit("raw"), F.col("raw_id")))
    # A site without authors is no node of the graph: it is its own group.
    tied = rows.withColumn("node", anchor).join(found, "node", "left").select("raw_id", "split", F.coalesce("component", "node").alias("group_id"))
    return keep.put(tied.groupBy("raw_id").agg(F.min("group_id").alias("group_id"), F.min("split").alias("split")))


def broken_groups(groups: DataFrame) -> DataFrame:
    """(raw_id) of the records with a split whose group has more than one split."""
    mixed = groups.where("split IS NOT NULL").groupBy("group_id").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high")
    return groups.where("split IS NOT NULL").join(mixed, "group_id", "left_semi").select("raw_id")


def _nearest_order(sizes: DataFrame, shares: list[float], total: int) -> int:
    """Which of ORDERS hash orders of the groups comes nearest to the shares, judged by ranges of the order; the first of equal ones."""
    spots = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.shiftrightunsigned(_place(k), 54).alias("bucket")) for k in range(ORDERS)]))
    rows = sizes.select(spots.alias("s"), "size").groupBy("s.order", "s.bucket").agg(F.sum("size").alias("size")).collect()  # ORDERS x BUCKETS rows at most
    filled: list[dict[int, int]] = [{} for _ in range(ORDERS)]
    for r in rows:
        filled[r["order"]][r["bucket"]] = r["size"]

    def apart(k: int) -> float:
        got, running = [0] * len(shares), 0
        for bucket in sorted(filled[k]):
            size = filled[k][bucket]
            middle, edge, at = (running + size / 2) / total, 0.0, 0
            while at < len(shares) - 1 and middle >= (edge := edge + shares[at]):
                at += 1
            got[at] += size
            running += size
        return sum(abs(g / total - w) for g, w in zip(got, shares))

    return min(range(ORDERS), key=lambda k: (round(apart(k), 9), k))


def _place(order: int) -> Column:
    return F.xxhash64(F.lit(f"order {order}"), F.col("group_id"))


def assign_splits(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(raw_id, group_id, split): a new assignment near `shares`, each group whole in one split.

    Groups stand in the order of a hash of their id; each goes where the middle of its rows falls in the running
    sum. Of ORDERS such orders the one is taken that comes nearest to the shares, as a group with a third of
    all rows makes some orders poor. Depends only on ids and sizes.
    """
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    total = max(1, int(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]))
    whole = sum(shares.get(name, 0.0) for name in SPLITS) or 1.0
    wanted = [shares.get(name, 0.0) / whole for name in SPLITS]
    order = _place(_nearest_order(sizes, wanted, total))
    placed = sizes.select("group_id", "size", order.alias("place"), F.shiftrightunsigned(order, 54).alias("bucket"))
    filled = {r["bucket"]: r["size"] for r in placed.groupBy("bucket").agg(F.sum("size").alias("size")).collect()}  # BUCKETS rows
    before, running = [], 0
    for bucket in range(BUCKETS):
        before.append(running)
        running += filled.get(bucket, 0)
    start = F.element_at(F.array(*[F.lit(b) for b in before]), F.col("bucket").cast("int") + 1)
    middle = (start + F.sum("size").over(W.partitionBy("bucket").orderBy("place", "group_id")) - F.col("size") / 2) / total
    chosen = F.when(middle < wanted[0], SPLITS[0]).when(middle < wanted[0] + wanted[1], SPLITS[1]).otherwise(SPLITS[2])
    return groups.select("raw_id", "group_id").join(placed.select("group_id", chosen.alias("split")), "group_id").select("raw_id", "group_id", "split")


def split_report(groups: DataFrame, assigned: DataFrame) -> DataFrame:
    """(split, records, old_records, share): the new sizes beside those in use."""
    new = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    old = groups.where("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("old_records"))
    joined = new.join(old, "split", "full").na.fill(0, ["records", "old_records"])
    return joined.withColumn("share", F.round(F.col("records") / F.sum("records").over(W.partitionBy(F.lit(1))), 6))
