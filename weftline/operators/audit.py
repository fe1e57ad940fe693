"""Profiles of tables: columns, keys, duplicates, sizes of groups, quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, word_count


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, rows_total, nulls, empties, blanks, distinct_values) of text columns, in one pass of partial aggregates for each column."""
    each = [
        df.agg(
            F.lit(c).alias("name"), F.count(F.lit(1)).alias("rows_total"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c) == "").alias("empties"),
            F.count_if(is_blank(F.col(c))).alias("blanks"), F.countDistinct(c).alias("distinct_values"),
        )
        for c in columns
    ]
    return reduce(DataFrame.unionAll, each)


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: groups of rows equal in all columns, rows involved, rows too many. Long columns are compared by hash."""
    groups = df.groupBy([F.sha2(F.coalesce(F.col(c), F.lit("\0")), 256).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def key_profile(df: DataFrame, key: str, others: list[str], label: str) -> DataFrame:
    """For each value of `key`: rows, distinct values of the other columns, rows labelled top and bottom. Null keys are a group."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in others],
        F.count_if(F.col(label) == "top").alias("top_rows"), F.count_if(F.col(label) == "bottom").alias("bottom_rows"),
    )


def group_size_histogram(df: DataFrame, key: str) -> DataFrame:
    """(group_size, n_groups): how many values of a key have how many rows; null keys left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("group_size")).groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def quantiles(df: DataFrame, value: str, by: str | None = None, points: tuple = QUANTILES) -> DataFrame:
    """(by, point, value): exact quantiles with linear interpolation."""
    keys = [by] if by else []
    found = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for p in points])).alias("v"))
    return found.select(*keys, F.posexplode("v").alias("i", "value")).select(*keys, F.element_at(F.array(*[F.lit(p) for p in points]), F.col("i") + 1).alias("point"), F.round("value", 6).alias("value"))


def url_summary(df: DataFrame) -> DataFrame:
    """One row about addresses: repeated, with several prompts, with both labels, with several hosts."""
    each = df.where("href IS NOT NULL").groupBy("href").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("prompt").alias("p"), F.countDistinct("category").alias("c"), F.countDistinct("hostname").alias("h")
    )
    return each.agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("p") > 1).alias("multi_prompt"),
        F.count_if(F.col("c") > 1).alias("conflicting"), F.count_if(F.col("h") > 1).alias("multi_host"), F.max("n").alias("most_rows"),
    )


def both_labels(df: DataFrame, key: str) -> DataFrame:
    """Values of `key` under which both labels occur."""
    n = F.countDistinct(F.when(F.col("category").isin("top", "bottom"), F.col("category")))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n_labels")).where("n_labels = 2").select(key)


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean to 3 places, median, 10th and 90th percentile as the nearest lower value, maximum."""
    # Counts of values stand for the sorted list, so nothing is collected.
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy("v"))).withColumn("total", F.sum("c").over(W.partitionBy(F.lit(1))))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * p), F.col("v")))
    return upto.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 3).alias("mean"), F.percentile("v", F.lit(0.5), F.col("c")).alias("median"),
        at(0.1).alias("p10"), at(0.9).alias("p90"), F.max("v").alias("most"),
    )


def collapse_pages(df: DataFrame, host: str, url: str, payload: str, label: str) -> DataFrame:
    """One row for each page: payloads, prompts, the label or `conflicting`, and the length of the longest payload (ties to the greater hash)."""
    d = df.withColumn("sha", F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)).withColumn("len", F.length(F.coalesce(F.col(payload), F.lit(""))))
    grouped = d.groupBy(F.lower(F.trim(host)).alias("host"), F.regexp_replace(F.trim(url), "#.*$", "").alias("url")).agg(
        F.countDistinct("sha").alias("payloads"), F.countDistinct("prompt").alias("prompts"), F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(label).alias("labels"), F.min(label).alias("only"), F.max(F.struct("len", "sha")).alias("best"),
    )
    return grouped.select("host", "url", "payloads", "prompts", "n_rows", F.when(F.col("labels") > 1, "conflicting").otherwise(F.col("only")).alias("label"), F.col("best.len").alias("longest"), F.col("best.sha").alias("longest_sha"))


def payload_lengths(df: DataFrame) -> DataFrame:
    """A narrow projection in place of payloads: id, characters, whether blank, words."""
    return df.select("raw_id", F.length("html_content").cast("bigint").alias("chars"), is_blank(F.col("html_content")).alias("blank"), word_count(F.col("html_content")).cast("bigint").alias("n_words"))
