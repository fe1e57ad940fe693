"""Queries that fit and examine classifiers. Fits are on a bounded set of columns; every row takes part."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import model, stats
from weftline.session import table

FEATURES = ["body_words", "prompt_chars", "path_depth", "sparse", "failed"]


def _rows(s, d):
    from weftline.functions import text

    q = table(s, d, "quality_flags").drop("path_hints").distinct().where("category IN ('top', 'bottom')").withColumn("site", names.site(F.col("hostname"), F.col("href")))
    return q.select(
        "raw_id", "site", (F.col("category") == "top").cast("int").alias("y"), F.col("body_words").cast("double").alias("body_words"), F.length("prompt").cast("double").alias("prompt_chars"),
        text.path_depth(F.col("href")).cast("double").alias("path_depth"), F.col("sparse_body_candidate").cast("double").alias("sparse"), F.col("clear_failure_union").cast("double").alias("failed"),
        model.hash_split(F.col("site")).alias("split"),
    )


def host_splits(s, d):
    """M10, by hash: rows and sites of each split."""
    return _rows(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site").alias("n_sites"))


def shuffled_host_splits(s, d):
    """M10, by exact shares: sites in the order of a seeded digest, 80, 10 and 10 of a hundred."""
    sites = _rows(s, d).select("site").where("site IS NOT NULL").distinct()
    return model.dealt_hosts(sites, "site").groupBy("split").agg(F.count(F.lit(1)).alias("n_sites"))


def lr_fit_coefficients(s, d):
    """M1, M21."""
    m = model.fit(_rows(s, d).where("split = 'train'"), FEATURES, "y", 0.01)
    return s.createDataFrame([(n, round(v, 4), round(o, 4)) for n, v, o in m.odds()], "feature STRING, coefficient DOUBLE, odds DOUBLE")


def lr_test_metrics(s, d):
    """A34, M16."""
    rows = _rows(s, d)
    return stats.binary_metrics(model.fit(rows.where("split = 'train'"), FEATURES, "y", 0.01).score(rows.where("split <> 'train'")), "y", "probability")


def cross_validation(s, d):
    """M2, M3."""
    out = model.cross_validate(_rows(s, d).where("site IS NOT NULL"), FEATURES, "y", "site", [0.001, 0.01, 0.1, 1.0], 4)
    best, _ = model.best_strength(out)
    return s.createDataFrame([(c, k, a, l, c == best) for c, k, a, l in out], "c DOUBLE, fold INT, auc DOUBLE, log_loss DOUBLE, chosen BOOLEAN")


def group_folds(s, d):
    """M5: folds with whole sites."""
    rows = _rows(s, d).where("site IS NOT NULL")
    return rows.join(model.group_folds(rows, "site", "y"), "site").groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site").alias("n_sites"))


def permutation(s, d):
    """M11."""
    rows = _rows(s, d)
    m = model.fit(rows.where("split = 'train'"), FEATURES, "y", 0.01)
    return model.permutation_importance(m, rows.where("split = 'validation'").dropDuplicates(["raw_id"]), "raw_id", "y", FEATURES)


def ablation(s, d):
    """M12."""
    return s.createDataFrame(model.family_ablation(_rows(s, d), {"size": FEATURES[:2], "address": FEATURES[2:3], "quality": FEATURES[3:]}, "y", "split", 0.01), "family STRING, rise DOUBLE")


def response_curve(s, d):
    """Each feature that isn't a flag."""
    rows = _rows(s, d)
    m = model.fit(rows.where("split = 'train'"), FEATURES, "y", 0.01)
    one, two, three = (model.response_curve(m, rows, f).withColumn("feature", F.lit(f)) for f in FEATURES[:3])
    return one.unionAll(two).unionAll(three)


def attribution(s, d):
    """Mean contribution of each input."""
    rows = _rows(s, d)
    c = model.fit(rows.where("split = 'train'"), FEATURES, "y", 0.01).contributions(rows, "raw_id")
    return c.groupBy("feature").agg(F.round(F.avg("contribution"), 4).alias("mean"), F.round(F.stddev_pop("contribution"), 4).alias("deviation"))


def edit_stress(s, d):
    """Probabilities with half the words against those as they are."""
    rows = _rows(s, d)
    m = model.fit(rows.where("split = 'train'"), FEATURES, "y", 0.01)
    return model.pairs_of_edits(m.score(rows), m.score(rows.withColumn("body_words", F.col("body_words") / 2)), "raw_id")


def review_manifest(s, d):
    """M17."""
    rows = _rows(s, d).where("site IS NOT NULL")
    return model.review_manifest(rows, "raw_id", "site").select("raw_id", "split", F.size("partners").alias("n_partners"))


QUERIES = {
    f.__name__: f
    for f in (host_splits, shuffled_host_splits, lr_fit_coefficients, lr_test_metrics, cross_validation, group_folds, permutation, ablation, response_curve, attribution, edit_stress, review_manifest)
}
ORACLE: dict[str, str] = {}
_SITE = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(nullif(trim(hostname), ''), regexp_extract(href, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)), '\s+', ' ', 'g'))), ':\d*$', ''), '\.+$', ''), ':\d*$', ''), '^www\.', ''), '')"
ORACLE["shuffled_host_splits"] = f"WITH h AS (SELECT DISTINCT {_SITE} AS site FROM quality_flags WHERE category IN ('top', 'bottom')), n AS (SELECT count(*) AS n FROM h WHERE site IS NOT NULL), r AS (SELECT row_number() OVER (ORDER BY md5('42:' || site)) - 1 AS r FROM h WHERE site IS NOT NULL) SELECT CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split, count(*) AS n_sites FROM r, n GROUP BY 1"
