"""Statistics within hosts and groups: paired differences, rank tests, adjusted p-values, ranking and classifier metrics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIE = 1e-12


def host_differences(df: DataFrame, host: str, label: Column, features: list[str]) -> DataFrame:
    """(feature, host, top_mean, bottom_mean, diff, median_diff): top less bottom, for hosts that have both. label is true for top; nulls take no part."""
    long = df.where(label.isNotNull()).select(F.col(host).alias("host"), label.alias("top"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("host", "top", "x.feature", "x.value").where("value IS NOT NULL")
    up, down = F.when(F.col("top"), F.col("value")), F.when(~F.col("top"), F.col("value"))
    g = long.groupBy("feature", "host").agg(F.avg(up).alias("top_mean"), F.avg(down).alias("bottom_mean"), (F.percentile(up, F.lit(0.5)) - F.percentile(down, F.lit(0.5))).alias("median_diff"))
    return g.where("top_mean IS NOT NULL AND bottom_mean IS NOT NULL").withColumn("diff", F.col("top_mean") - F.col("bottom_mean"))


def paired_summary(differences: DataFrame) -> DataFrame:
    """For each feature: paired hosts, mean and median difference, hosts above, below and at zero."""
    d = F.col("diff")
    return differences.groupBy("feature").agg(
        F.count(F.lit(1)).alias("hosts"), F.round(F.avg(d), 6).alias("mean_diff"), F.round(F.percentile(d, F.lit(0.5)), 6).alias("median_diff"),
        F.count_if(d > TIE).alias("positive"), F.count_if(d < -TIE).alias("negative"), F.count_if(F.abs(d) <= TIE).alias("tied"),
    )


def wilcoxon(differences: DataFrame, least: int = 10) -> DataFrame:
    """(feature, n, w_plus, z, p): signed-rank test, normal approximation with tie correction, zeros dropped; null with fewer than `least`."""
    d = differences.where(F.abs("diff") > TIE).withColumn("a", F.abs("diff"))
    counts = d.groupBy("feature", "a").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("diff") > 0).alias("up"))
    before = F.sum("t").over(W.partitionBy("feature").orderBy("a")) - F.col("t")
    g = counts.withColumn("rank", before + (F.col("t") + 1) / 2).groupBy("feature").agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    erf = normal_tail(F.abs(F.col("z")))
    return g.withColumn("z", F.when(n >= least, z)).select("feature", "n", F.round("w_plus", 6).alias("w_plus"), F.round("z", 6).alias("z"), F.round(F.when(F.col("z").isNotNull(), erf), 6).alias("p"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by Abramowitz and Stegun 7.1.26 (error below 2e-7)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def benjamini_hochberg(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adds q: the running minimum of p n / rank from the largest p down. Ties in p are ordered by name; a null p has a null q and isn't counted. One row a feature, so one partition."""
    tested = df.where(F.col(p).isNotNull())
    rank = F.row_number().over(W.orderBy(p, name))
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    raw = tested.withColumn("rank", rank).withColumn("n_tests", n)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("n_tests") / F.col("rank")).over(W.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)))
    return raw.withColumn("q", F.round(q, 9)).select(name, p, "q")


SLICES = 256  # ranges into which an order is cut


def running_sums(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """`df` with before_<name> for each of `sums`: the sum over rows of smaller `order`, over all of them but in no single task.

    Rows are cut into ranges of `order` at approximate quantiles, which only share out the work; the ranges' sums, at
    most SLICES + 1 rows, go before what a window adds within a range. Nulls in `order` come first; rows of one value have one result.
    """
    kept = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), F.lit(10_000))).collect()[0][0] or []
    edges = sorted(set(kept))
    kind = df.schema[order].dataType
    slice_ = F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(e).cast(kind) for e in edges]), lambda e: e < F.col(order))) if edges else F.lit(0))
    x = df.withColumn("slice", slice_)
    totals = {r["slice"]: r for r in x.groupBy("slice").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    w = W.partitionBy("slice").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    of_value = W.partitionBy("slice", order)
    for c in sums:
        before, so_far = [], 0
        for i in range(-1, len(edges) + 1):
            before.append(F.lit(so_far))
            so_far += (totals[i][c] if i in totals else 0) or 0
        x = x.withColumn(f"before_{c}", F.element_at(F.array(*before), F.col("slice") + 2) + F.sum(c).over(w) - F.sum(c).over(of_value))
    return x.drop("slice")


def rank_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., rows, positives, auc): area under the ROC curve by average ranks; null with one class only.

    Scores are counted first, so a score that many rows share is one row of the window.
    """
    by = by or []
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col(label).cast("int")).alias("up"))
    if by:
        c = c.withColumn("before_t", F.sum("t").over(W.partitionBy(*by).orderBy("s")) - F.col("t"))
    else:
        c = running_sums(c, "s", ["t"])
    g = c.withColumn("rank", F.col("before_t") + (F.col("t") + 1) / 2).groupBy(*by).agg(F.sum("t").alias("n_rows"), F.sum("up").alias("positives"), F.sum(F.col("rank") * F.col("up")).alias("r"))
    neg = F.col("n_rows") - F.col("positives")
    return g.select(*by, "n_rows", "positives", F.round(F.when((F.col("positives") > 0) & (neg > 0), (F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * neg)), 6).alias("auc"))


def binary_metrics(df: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """One row: prevalence, log loss, Brier score, accuracy and the confusion counts. Probabilities are clipped at 1e-15 for the loss."""
    y, p = F.col(label).cast("double"), F.col(probability)
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    said = p >= threshold
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(y), 6).alias("prevalence"), F.round(-F.avg(y * F.log(clipped) + (1 - y) * F.log(1 - clipped)), 6).alias("log_loss"),
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg((said == (y == 1)).cast("double")), 6).alias("accuracy"),
        F.count_if(said & (y == 1)).alias("tp"), F.count_if(said & (y == 0)).alias("fp"), F.count_if(~said & (y == 1)).alias("fn"), F.count_if(~said & (y == 0)).alias("tn"),
    )


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: sum over distinct scores, from the highest, of precision times the gain in recall."""
    c = df.groupBy((-F.col(score)).alias("s")).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col(label).cast("int")).alias("up"))
    x = running_sums(c, "s", ["t", "up"]).select("up", ((F.col("before_up") + F.col("up")) / (F.col("before_t") + F.col("t"))).alias("precision"))
    return x.agg(F.round(F.sum(F.col("precision") * F.col("up")) / F.sum("up"), 6).alias("average_precision"))


def calibration(df: DataFrame, label: str, probability: str, bins: int = 8) -> DataFrame:
    """(bin, n_rows, mean_probability, share): bins between quantiles of the probability; equal edges leave bins empty."""
    points = [i / bins for i in range(1, bins)]
    edges = df.agg(F.percentile(probability, F.array(*[F.lit(p) for p in points])).alias("edges"))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(probability) > e)))  # one row of edges
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(probability), 6).alias("mean_probability"), F.round(F.avg(F.col(label).cast("double")), 6).alias("share"))


def ranking_metrics(df: DataFrame, case: str, grade: str, score: str, item: str, k: int = 5) -> DataFrame:
    """(case, ndcg, recall): gains 2^grade - 1, ties in score by item; null where the ideal gain or the relevant count is 0."""
    rank = F.row_number().over(W.partitionBy(case).orderBy(F.desc(score), item))
    ideal = F.row_number().over(W.partitionBy(case).orderBy(F.desc(grade), item))
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    x = df.withColumn("r", rank).withColumn("i", ideal)
    top = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    g = x.groupBy(case).agg(top("r").alias("dcg"), top("i").alias("best"), F.count_if((F.col("r") <= k) & (F.col(grade) > 0)).alias("hit"), F.count_if(F.col(grade) > 0).alias("relevant"))
    return g.select(case, F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")), 6).alias("ndcg"), F.round(F.when(F.col("relevant") > 0, F.col("hit") / F.col("relevant")), 6).alias("recall"))


def pairwise_accuracy(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """(group, pairs, accuracy): how often a positive scores above a negative of its group, ties half. No pair is made: it is the rank statistic."""
    g = rank_auc(df, label, score, [group]).where("auc IS NOT NULL")
    return g.select(group, (F.col("positives") * (F.col("n_rows") - F.col("positives"))).alias("pairs"), F.col("auc").alias("accuracy"))


def drift(old: DataFrame, new: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(feature, mean_abs, relative, changed): mean absolute change, over the old population's standard deviation, and the share that changed."""
    stack = lambda d, v: d.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias(v)) for f in features])).alias("x")).select(key, "x.*")
    j = stack(old, "old").join(stack(new, "new"), [key, "feature"]).where("old IS NOT NULL AND new IS NOT NULL")
    gap = F.abs(F.col("new") - F.col("old"))
    return j.groupBy("feature").agg(F.round(F.avg(gap), 6).alias("mean_abs"), F.round(F.avg(gap) / F.nullif(F.stddev_pop("old"), F.lit(0.0)), 6).alias("relative"), F.round(F.avg((gap > TIE).cast("double")), 6).alias("changed"))


def poisson_weight(group: str, seed: int) -> Column:
    """How often a group is drawn in repeat b, by Poisson(1), from the digest of seed, group and repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col("b").cast("string")))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(1, 9):
        total += term
        steps.append(round(total, 12))
        term /= k
    return sum(((draw >= t).cast("int") for t in steps), F.lit(0))


def auc_delta(df: DataFrame, group: str, label: str, old: str, new: str, repeats: int = 500, seed: int = 142) -> DataFrame:
    """(estimate, low, high): how much the new score's AUC exceeds the old one's, with a 95 % interval from whole groups drawn alike for both.

    Rows of one group and score are counted first; a repeat then has as many rows as there are scores. Repeats in which one class is missing don't count.
    """
    side = lambda name, score: df.select(group, F.col(label).alias("y"), F.lit(name).alias("which"), F.col(score).alias("p"))
    cells = side("old", old).unionAll(side("new", new)).where("p IS NOT NULL AND y IS NOT NULL").groupBy(group, "which", "p").agg(F.sum("y").alias("up"), F.count_if(F.col("y") == 0).alias("down"))
    each = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(group, seed)))
    sums = each.groupBy("b", "which", "p").agg(F.sum(F.col("w") * F.col("up")).cast("double").alias("up"), F.sum(F.col("w") * F.col("down")).cast("double").alias("down"))
    below = F.sum("down").over(W.partitionBy("b", "which").orderBy("p")) - F.col("down") / 2
    auc = sums.withColumn("won", F.col("up") * below).groupBy("b", "which").agg((F.sum("won") / F.nullif(F.sum("up") * F.sum("down"), F.lit(0.0))).alias("auc"))
    gap = auc.groupBy("b").agg((F.max(F.when(F.col("which") == "new", F.col("auc"))) - F.max(F.when(F.col("which") == "old", F.col("auc")))).alias("gap"))
    q = F.percentile(F.when(F.col("b") > 0, F.col("gap")), F.array(F.lit(0.025), F.lit(0.975)))
    return gap.agg(F.max(F.when(F.col("b") == 0, F.col("gap"))).alias("estimate"), q.alias("q")).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def group_bootstrap(df: DataFrame, group: str, value: str, repeats: int = 500, seed: int = 142) -> DataFrame:
    """(estimate, low, high): the mean of `value` with a 95 % interval from resampling whole groups.

    Each group has a Poisson(1) weight in each repeat, drawn by hash, so groups stay where they are and only
    sums for each repeat are moved.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    each = sums.select(group, "s", "n", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("b")).withColumn("w", poisson_weight(group, seed))
    means = each.groupBy("b").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    bounds = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return bounds.crossJoin(sums.agg((F.sum("s") / F.sum("n")).alias("estimate"))).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def exact_bootstrap(sums: np.ndarray, counts: np.ndarray, repeats: int = 500, seed: int = 142) -> tuple[float, float]:
    """The interval from numpy's own draws, for a few groups that are already on the driver."""
    rng = np.random.default_rng(seed)
    picks = rng.integers(0, len(sums), (repeats, len(sums)))
    means = sums[picks].sum(1) / counts[picks].sum(1)
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))
