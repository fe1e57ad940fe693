"""Mixing sources to target weights by Poisson replication.

Each source has a rate: how often a document must be used on average for the source to fill its share.
A document's number of copies is the inverse of a Poisson distribution at a hash of its id, cut off at
the source's cap; the distribution's mean is raised so that the cut-off mean is the rate. Copies are
ordered by hash over all sources.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.names import source_name
from weftline.llm.tokens import VOCABULARY, filled, with_tokens
from weftline.session import Scratch


def capped_chances(mean: float, cap: int) -> list[float]:
    """P(X < 1), P(X < 2), ... P(X < cap) of a Poisson variable: as many as a uniform draw exceeds, so many copies."""
    term, total, out = math.exp(-mean), 0.0, []
    for k in range(cap):
        total += term
        out.append(min(1.0, total))
        term *= mean / (k + 1)
    return out


def raised_mean(rate: float, cap: int) -> float:
    """The Poisson mean whose variable, cut off at `cap`, has mean `rate` (below the cap)."""
    low, high = 0.0, 1.0
    expected = lambda m: sum(1 - p for p in capped_chances(m, cap))
    while expected(high) < rate and high < 500:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < rate else (low, middle)
    return (low + high) / 2


def sized_documents(spark: SparkSession, documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source_key, n_tokens) of the texts that aren't blank."""
    return Scratch(spark, "sizes").put(with_tokens(filled(documents).select("doc_id", source_name(F.col("source")).alias("source_key"), "text"), path=path))


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: (source, source_key, target_share, max_repeats, available, wanted, most, rate, chances).

    wanted is the share of a mixture as large as all documents, each text once; most is what the source
    gives with every document used max_repeats times. A target without documents has none available.
    Targets that name one source twice are taken as one: shares add up, the larger cap holds. Null shares and
    caps count as 0. There is a row for each target; sources are few.
    """
    spark = sized.sparkSession
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).collect()[0][0]
    goals = (
        targets.withColumn("source_key", source_name(F.col("source")))
        .groupBy("source_key")
        .agg(F.min("source").alias("source"), F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    )
    have = sized.groupBy("source_key").agg(F.sum("n_tokens").alias("available"))
    rows = []
    for r in goals.join(have, "source_key", "left").na.fill(0, ["available"]).collect():
        wanted, most = r["target_share"] * total, r["available"] * r["max_repeats"]
        rate = min(wanted / r["available"], float(r["max_repeats"])) if r["available"] else 0.0
        if rate >= r["max_repeats"]:
            chances = [0.0] * r["max_repeats"]
        else:
            chances = capped_chances(raised_mean(rate, r["max_repeats"]), r["max_repeats"]) if rate > 0 else [1.0] * r["max_repeats"]
        rows.append((r["source"], r["source_key"], r["target_share"], r["max_repeats"], r["available"], float(wanted), int(most), float(rate), chances))
    return spark.createDataFrame(
        rows, "source STRING, source_key STRING, target_share DOUBLE, max_repeats INT, available BIGINT, wanted DOUBLE, most BIGINT, rate DOUBLE, chances ARRAY<DOUBLE>"
    )


def mixture(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens), in the order of position, which is a hash of the copy.

    A document's copies depend on its id, the seed and its source's rate alone. Documents whose source
    has no target aren't used; the plan is a row for each target and is broadcast.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    used = sized.join(F.broadcast(plan.select("source", "source_key", "chances")), "source_key")
    copies = F.size(F.filter("chances", lambda p: draw >= p))
    each = used.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    position = F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "copy")
    return each.select(position.alias("position"), "doc_id", "source", "copy", "n_tokens").repartitionByRange("position").sortWithinPartitions("position")


def mixture_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, short): what each source got; short marks those that can't fill their share."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    all_ = got.agg(F.sum("tokens")).collect()[0][0] or 0
    return (
        plan.join(got, "source", "left")
        .na.fill(0, ["tokens"])
        .select("source", "target_share", "max_repeats", "tokens", F.round(F.col("tokens") / F.lit(max(1, all_)), 6).alias("share"), (F.col("most") < F.col("wanted")).alias("short"))
    )
