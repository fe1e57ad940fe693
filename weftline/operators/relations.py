"""Relations between tables that audits and exports rest on: verified joins, aligned matrices, manifests, sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verified_join(left: DataFrame, right: DataFrame, key: list[str], verify: list[str]) -> DataFrame:
    """(column, pairs, differ): how often two tables that agree on a composite key differ in a column that both must have alike.

    Nulls are equal to nulls. Keys of one side only pair with nothing; a null in a key pairs with none.
    """
    a, b = left.select(*key, *[F.col(c).alias(f"l_{c}") for c in verify]), right.select(*key, *[F.col(c).alias(f"r_{c}") for c in verify])
    gaps = [F.struct(F.lit(c).alias("column"), (~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias("differs")) for c in verify]
    return a.join(b, key).select(F.explode(F.array(*gaps)).alias("x")).groupBy(F.col("x.column").alias("column")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("x.differs").alias("differ"))


def aligned(key: str, *parts: DataFrame) -> DataFrame:
    """Feature tables side by side, aligned by key and never by position; a key that one part lacks has nulls there."""
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the n smallest distinct keys: a subset that is the same on every run."""
    return df.join(F.broadcast(df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)), key, "left_semi")  # n keys


def bounded(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the order of a unique key, which alone is sorted; payloads stay where they are."""
    return df.join(F.broadcast(df.select(*order).orderBy(*order).limit(n)), order, "left_semi")  # n keys


def united(key: str, *batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All batches with the number of each, and (key, n) of the keys that more than one row has."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("batch", F.lit(i)) for i, b in enumerate(batches)])
    return rows, rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collapsed_by_url(df: DataFrame, value: str) -> DataFrame:
    """(url, queries, mean): of (prompt, snapshot_id, url, value, n) the mean over snapshots of a query, then over the queries of an address.

    Rows that repeat a query and snapshot count once, by the last n. Nulls don't count.
    """
    last = df.groupBy("url", "prompt", "snapshot_id").agg(F.max_by(value, "n").alias("v"))
    return last.groupBy("url", "prompt").agg(F.avg("v").alias("v")).groupBy("url").agg(F.count("v").alias("queries"), F.avg("v").alias("mean"))


def coverage_quantiles(df: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, rows, present, least, q25, median, q75, most) of several columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    g = long.groupBy("measure").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("present"), q.alias("q"))
    return g.select("measure", "rows", "present", *[F.col("q")[i].alias(n) for i, n in enumerate(("least", "q25", "median", "q75", "most"))])


def embedding_sizes(units: DataFrame, width: int, batch: int, cost: float) -> DataFrame:
    """(role, units, requests, bytes, tokens, batches, vector_bytes, cost): of (role, text) units, equal texts of a role asked once.

    A token is taken as four bytes; cost is for a million tokens, batches hold `batch` texts.
    """
    once = units.where("text IS NOT NULL").groupBy("role", "text").agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length("text").cast("bigint")
    g = once.groupBy("role").agg(F.sum("n").alias("units"), F.count(F.lit(1)).alias("requests"), F.sum(size).alias("bytes"), F.sum(F.ceil(size / 4)).alias("tokens"))
    return g.select("*", F.ceil(F.col("requests") / batch).alias("batches"), (F.col("requests") * width * 4).alias("vector_bytes"), F.round(F.col("tokens") * cost / 1e6, 6).alias("cost"))


def matched_support(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: groups of a key, those with several rows, those with several labels, and the rows in these."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("labels"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("labels") > 1).alias("mixed"), F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("n"))), F.lit(0)).alias("mixed_rows"))


def training_manifest(units: DataFrame, field: str, unit: str, content: str, split: str, least: int = 33) -> DataFrame:
    """(field, eligible, held_out, repeated, train, enough): units by field, and what of them a fit may see.

    A unit is held out if any row of it isn't in train, repeated if its content also stands in a unit that is held out; `enough` tells `least` others.
    """
    each = units.where(F.col(content).isNotNull()).groupBy(field, unit).agg(F.min(content).alias("c"), F.max((F.col(split) != "train") | F.col(split).isNull()).alias("out"))
    contents = each.groupBy(field, "c").agg(F.count(F.lit(1)).alias("n"), F.count_if("out").alias("outs"))
    free = F.when(F.col("outs") > 0, F.col("n") - F.col("outs"))
    g = contents.groupBy(field).agg(F.sum("n").alias("eligible"), F.sum("outs").alias("held_out"), F.coalesce(F.sum(free), F.lit(0)).alias("repeated"))
    return g.withColumn("train", F.col("eligible") - F.col("held_out") - F.col("repeated")).withColumn("enough", F.col("train") >= least)


def content_identity(members: DataFrame, unit: list[str], order: list[str], text: str) -> DataFrame:
    """(unit, identity): the digest of the digests of a unit's texts in order; units of equal texts have one identity."""
    kept = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, F.sha2(text, 256).alias("h")))))
    return members.groupBy(*unit).agg(F.sha2(F.array_join(F.transform(kept, lambda x: x["h"]), ","), 256).alias("identity"))


def structure_checks(blocks: DataFrame) -> DataFrame:
    """(snapshot_id, method, heading, code, nested_list, table, ordered): what structure a document's blocks have, and whether their order has no gap or repeat."""
    parent = blocks.select("snapshot_id", "method", F.col("block_id").alias("parent_id"), F.col("block_type").alias("parent_type"))
    x = blocks.join(parent, ["snapshot_id", "method", "parent_id"], "left")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    kind = F.col("block_type")
    return x.groupBy("snapshot_id", "method").agg(
        any_(kind == "heading").alias("heading"), any_(kind == "code").alias("code"), any_(kind.isin("list", "list_item") & F.col("parent_type").isin("list", "list_item")).alias("nested_list"), any_(kind == "table").alias("table"),
        ((F.max("block_order") - F.min("block_order") + 1 == F.count(F.lit(1))) & (F.countDistinct("block_order") == F.count(F.lit(1)))).alias("ordered"),
    )
