"""Grouped classifiers on feature tables: leakage-safe splits and folds, fit, validation, explanation.

Fits run in Spark ML on columns that were filled, flagged, centred and scaled by expressions, so a fitted
model is a table of means and coefficients and scoring is an expression too.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.stats import binary_metrics, rank_auc, running_sums
from weftline.session import Scratch


def hash_split(group: Column, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> Column:
    """A group's split from its hash alone, whatever other groups there are."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), group), 11) / F.lit(float(1 << 53))
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def shuffled_hosts(hosts: list[str], seed: int = 42) -> dict[str, str]:
    """80/10/10 of a sorted list of hosts after a seeded shuffle; for lists that fit the driver. Order of input and repeats don't count."""
    names = sorted(set(hosts))
    random.Random(seed).shuffle(names)
    a, b = int(len(names) * 0.8), int(len(names) * 0.9)
    return {n: "train" if i < a else "validation" if i < b else "test" for i, n in enumerate(names)}


def group_folds(df: DataFrame, group: str, label: str, folds: int = 4) -> DataFrame:
    """(group, fold): groups dealt to folds by size of positives, largest first, back and forth; groups stay whole."""
    sizes = df.groupBy(group).agg(F.sum(F.col(label).cast("int")).alias("up"), F.count(F.lit(1)).alias("n"))
    bucket = F.pmod(F.xxhash64(group), F.lit(64))
    # Dealing within each bucket keeps the ranking distributed; each bucket starts at another fold.
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("up"), F.desc("n"), group)) - 1
    turn = rank % (2 * folds)
    fold = F.pmod(F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn) + F.col("bucket"), F.lit(folds))
    return sizes.withColumn("bucket", bucket).withColumn("fold", fold.cast("int")).select(group, "fold")


@dataclass
class Fitted:
    """A fitted pipeline: medians, means and population deviations of the filled features, indicators of missing ones, coefficients."""

    features: list[str]
    medians: dict[str, float]
    flagged: list[str]
    means: dict[str, float]
    scales: dict[str, float]
    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    @property
    def inputs(self) -> list[str]:
        return [*self.features, *(f"missing_{f}" for f in self.flagged)]

    def prepared(self, name: str) -> Column:
        """One standardised input."""
        if name.startswith("missing_") and name[8:] in self.flagged:
            value = F.col(name[8:]).isNull().cast("double")
        else:
            value = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(self.medians[name]))
        return (value - self.means[name]) / self.scales[name]

    def logit(self) -> Column:
        return sum((self.prepared(n) * self.coefficients[n] for n in self.inputs), F.lit(self.intercept))

    def score(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """Adds the probability; rows without any known feature get null: the model abstains."""
        known = sum((F.col(f).isNotNull().cast("int") for f in self.features), F.lit(0))
        return df.withColumn(out, F.when(known > 0, 1 / (1 + F.exp(-self.logit()))))

    def contributions(self, df: DataFrame, key: str) -> DataFrame:
        """(key, feature, contribution): the parts of each row's logit; with the intercept they add up to it."""
        parts = F.array(*[F.struct(F.lit(n).alias("feature"), (self.prepared(n) * self.coefficients[n]).alias("contribution")) for n in self.inputs])
        return df.select(key, F.explode(parts).alias("c")).select(key, "c.*")

    def odds(self) -> list[tuple[str, float, float]]:
        return [(n, self.coefficients[n], math.exp(self.coefficients[n])) for n in self.inputs]


def fit(df: DataFrame, features: list[str], label: str, c: float = 1.0, weight: str | None = None) -> Fitted:
    """Median fill, indicators of missing values, standardising by population deviation, L2 logistic regression with inverse strength C.

    Features constant in `df` keep scale 1; features without any value have median 0. Rows with a null label
    take no part.
    """
    d = df.where(F.col(label).isNotNull())
    clean = {f: F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features}
    first = d.agg(F.count(F.lit(1)).alias("n"), *[F.percentile(v, F.lit(0.5)).alias(f"m_{f}") for f, v in clean.items()], *[F.count(v).alias(f"k_{f}") for f, v in clean.items()]).collect()[0]
    medians = {f: float(first[f"m_{f}"]) if first[f"m_{f}"] is not None else 0.0 for f in features}
    flagged = [f for f in features if 0 < first[f"k_{f}"] < first["n"]]
    model = Fitted(features, medians, flagged, {}, {})
    raw = {n: (F.col(n[8:]).isNull().cast("double") if n.startswith("missing_") and n[8:] in flagged else F.coalesce(clean[n], F.lit(medians[n]))) for n in model.inputs}
    moments = d.agg(*[F.avg(v).alias(f"a_{n}") for n, v in raw.items()], *[F.stddev_pop(v).alias(f"s_{n}") for n, v in raw.items()]).collect()[0]
    model.means = {n: float(moments[f"a_{n}"] or 0.0) for n in raw}
    model.scales = {n: float(moments[f"s_{n}"] or 0.0) or 1.0 for n in raw}
    ready = d.select(F.col(label).cast("double").alias("label"), *([F.col(weight).alias("w")] if weight else []), *[model.prepared(n).alias(n) for n in model.inputs])
    vector = VectorAssembler(inputCols=model.inputs, outputCol="x").transform(ready)
    total = first["n"]
    # Half the squared norm against C times the summed loss, as a penalty on the mean loss.
    lr = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / (c * max(1, total)), elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-8, **({"weightCol": "w"} if weight else {}))
    found = lr.fit(vector)
    model.coefficients = {n: float(v) for n, v in zip(model.inputs, found.coefficients)}
    model.intercept = float(found.intercept)
    return model


def cross_validate(df: DataFrame, features: list[str], label: str, group: str, strengths: list[float], folds: int = 4) -> list[tuple[float, int, float | None, float]]:
    """(C, fold, AUC, log loss) of each fold held out; folds keep groups whole. A few small fits, driven from the driver."""
    dealt = Scratch(df.sparkSession, "folds").put(df.join(group_folds(df, group, label, folds), group))
    out = []
    for c in strengths:
        for k in range(folds):
            held = fit(dealt.where(F.col("fold") != k), features, label, c).score(dealt.where(F.col("fold") == k))
            auc = rank_auc(held, label, "probability").collect()
            loss = binary_metrics(held, label, "probability").collect()[0]["log_loss"]
            out.append((c, k, auc[0]["auc"] if auc else None, loss))
    return out


def concentration(model: Fitted) -> tuple[float, float]:
    """The largest coefficient's share of the sum of absolute ones, and the five largest' share."""
    sizes = sorted((abs(v) for v in model.coefficients.values()), reverse=True)
    total = sum(sizes) or 1.0
    return sizes[0] / total if sizes else 0.0, sum(sizes[:5]) / total


def dealt_hosts(hosts: DataFrame, host: str, seed: int = 42, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """(host, split): distinct hosts in the order of a seeded digest, the first `shares` of them train and validation, the rest test. No list of hosts is made."""
    x = hosts.select(host, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(host))).alias("h"), F.lit(1).alias("one"))
    n = x.count()
    first, second = int(shares[0] * n), int(shares[0] * n) + int(shares[1] * n)
    place = F.col("before_one")
    return running_sums(x.withColumn("at", F.conv(F.substring("h", 1, 13), 16, 10).cast("bigint")), "at", ["one"]).select(host, F.when(place < first, "train").when(place < second, "validation").otherwise("test").alias("split"))


def permutation_importance(model: Fitted, df: DataFrame, key: str, label: str, names: list[str], repeats: int = 30, seed: int = 7) -> DataFrame:
    """(feature, rise, deviation): of the log loss when a feature's values are dealt out anew among the rows, over `repeats` deals.

    A deal pairs the rows in one hash order with the values in another; places in an order are counted
    within 64 ranges of the hash, whose sizes go before them. key must be unique.
    """
    from pyspark.sql import Window as W

    def placed(columns: list, salt: int) -> DataFrame:
        x = df.select(*columns, key, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("deal"))
        x = x.withColumn("h", F.xxhash64(F.lit(seed + salt), "deal", key)).withColumn("part", F.shiftrightunsigned("h", 58))
        sizes = x.groupBy("deal", "part").agg(F.count(F.lit(1)).alias("n"))  # 64 rows a deal
        before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("deal").orderBy("part")) - F.col("n")).drop("n")
        inside = F.row_number().over(W.partitionBy("deal", "part").orderBy("h", key))
        return x.withColumn("inside", inside).join(F.broadcast(before), ["deal", "part"]).withColumn("place", F.col("before") + F.col("inside")).drop("h", "part", "inside", "before")

    base = binary_metrics(model.score(df), label, "probability").select(F.col("log_loss").alias("base"))
    y, p = F.col(label).cast("double"), F.least(F.greatest(F.col("probability"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
    out = None
    for name in names:
        rows = placed([c for c in df.columns if c not in (name, key)], 0)
        values = placed([name], 1).drop(key)
        dealt = model.score(rows.join(values, ["deal", "place"])).where(y.isNotNull()).groupBy("deal").agg(loss.alias("loss"))
        one = dealt.crossJoin(F.broadcast(base)).agg(F.lit(name).alias("feature"), F.avg(F.col("loss") - F.col("base")).alias("rise"), F.stddev_pop("loss").alias("deviation"))  # one row of base
        out = one if out is None else out.unionAll(one)
    return out


def best_strength(scores: list[tuple[float, int, float | None, float]]) -> tuple[float, float]:
    """(C, mean log loss) of the strength that does best over all folds; of equal ones the smaller."""
    losses: dict[float, list[float]] = {}
    for c, _, _, loss in scores:
        losses.setdefault(c, []).append(loss)
    return min(((sum(v) / len(v), c) for c, v in losses.items()))[::-1]


def family_ablation(df: DataFrame, families: dict[str, list[str]], label: str, split: str, c: float = 1.0) -> list[tuple[str, float]]:
    """(family, rise of validation log loss) when a family is left out of the fit."""
    train, held = df.where(F.col(split) == "train"), df.where(F.col(split) == "validation")
    everything = [f for fs in families.values() for f in fs]
    loss = lambda fs: binary_metrics(fit(train, fs, label, c).score(held), label, "probability").collect()[0]["log_loss"]
    base = loss(everything)
    return [(name, loss([f for f in everything if f not in fs]) - base) for name, fs in families.items()]


def response_curve(model: Fitted, df: DataFrame, name: str) -> DataFrame:
    """(point, mean_probability): the mean probability with one feature set to each of its 19 inner quantiles."""
    points = [round(0.05 * i, 2) for i in range(1, 20)]
    values = df.agg(F.percentile(name, F.array(*[F.lit(p) for p in points]))).collect()[0][0] or []
    grid = df.sparkSession.createDataFrame(list(zip(points, map(float, values))), "point DOUBLE, value DOUBLE")
    return model.score(df.drop(name).crossJoin(F.broadcast(grid)).withColumnRenamed("value", name)).groupBy("point").agg(F.round(F.avg("probability"), 6).alias("mean_probability"))  # 19 rows of grid


def promotion_gate(coefficient_share: float, cv_auc: float, base_auc: float, stress_mean: float, stress_p95: float) -> list[str]:
    """Reasons against a candidate model; empty when it may be promoted."""
    out = []
    if coefficient_share > 0.20:
        out.append("one coefficient dominates")
    if cv_auc < base_auc:
        out.append("worse in cross-validation")
    if stress_mean > 0.03 or stress_p95 > 0.08:
        out.append("moves too much under stress")
    return out


def pairs_of_edits(before: DataFrame, after: DataFrame, key: str, probability: str = "probability") -> DataFrame:
    """One row on edits: count, mean, median, 95th percentile and largest change of probability, and the share above 0.1."""
    j = before.select(key, F.col(probability).alias("old")).join(after.select(key, F.col(probability).alias("new")), key).withColumn("gap", F.abs(F.col("new") - F.col("old")))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 6).alias("mean"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("gap", F.lit(0.95)), 6).alias("p95"), F.round(F.max("gap"), 6).alias("most"), F.round(F.avg((F.col("gap") > 0.1).cast("double")), 6).alias("over_tenth"))


def review_manifest(cases: DataFrame, case: str, component: str, seed: str = "review", others: int = 5) -> DataFrame:
    """(case, split, partners): half of the components by hash are development; each case is shown with the `others` cases of the same split that follow it by hash, the first ones after the last."""
    from pyspark.sql import Window as W

    h = lambda *c: F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(x).cast("string") for x in c]), 256)
    halves = F.when(F.substring(h(component), 1, 1).isin(*"01234567"), "development").otherwise("heldout")
    d = cases.select(case, halves.alias("split")).distinct().withColumn("h", h(case)).withColumn("bucket", F.substring("h", 1, 2))
    w = W.partitionBy("split", "bucket").orderBy("h")
    # What follows a bucket's end is among the first rows of the other buckets: 256 of them in a split, `others` rows of each.
    first = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= others)
    heads = first.groupBy("split", "bucket").agg(F.array_sort(F.collect_list(F.struct("h", F.col(case).alias("case")))).alias("own"))
    ring = heads.groupBy("split").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("ring"))
    near = lambda side: F.filter("ring", lambda x: side(F.substring(x["h"], 1, 2)))
    beyond = F.slice(F.concat(near(lambda b: b > F.col("bucket")), near(lambda b: b < F.col("bucket"))), 1, others)
    ends = heads.join(ring, "split").select("split", "bucket", F.concat(beyond, "own")["case"].alias("beyond"))
    follow = d.withColumn("inside", F.array_compact(F.array(*[F.lead(case, i).over(w) for i in range(1, others + 1)])))
    partners = F.slice(F.array_remove(F.array_distinct(F.concat("inside", "beyond")), F.col(case)), 1, others)
    return follow.join(F.broadcast(ends), ["split", "bucket"]).select(case, "split", partners.alias("partners"))  # at most 512 rows of ends
