"""Queries on vectors, rankings and classifier metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import stats, vectors
from weftline.session import table


def _e(s, d):
    return table(s, d, "embeddings")


def vector_norms(s, d):
    return _e(s, d).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def knn_cosine(s, d):
    """Five nearest of every row whose id is divisible by 20, against all rows."""
    found = vectors.nearest(s, _e(s, d).where("vec_id % 20 = 0"), _e(s, d), 5)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


def _aligned(s, d):
    """Each query vector against the mean-free sections of its label: the query's label is its page, rows are sections."""
    q = _e(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    return q.join(_e(s, d), "label").where("query_id <> vec_id").select("query_id", "vec_id", "label", vectors.cosine(F.col("q"), F.col("embedding")).alias("similarity"))


def section_topk(s, d):
    """A26, W4, A27."""
    return vectors.section_summary(_aligned(s, d).withColumn("similarity", F.round("similarity", 9)), "query_id", "vec_id", "similarity")


def weighted_pool(s, d):
    """One vector a label, weighted by id; the first dimension and the length."""
    p = vectors.weighted_pool(_e(s, d).withColumn("w", (F.col("vec_id") % 7 + 1).cast("double")), "label", "embedding", "w")
    return p.select("label", F.round(F.element_at("embedding", 1), 6).alias("first"), F.size("embedding").cast("bigint").alias("width"))


def dimension_stats(s, d):
    return vectors.column_means(_e(s, d), "embedding").select("i", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def pca_explained(s, d):
    """M6: share of variance of eight components."""
    p = vectors.PrincipalComponents(_e(s, d), "embedding", 8)
    return s.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(p.explained)], "component INT, explained DOUBLE")


def pca_projection(s, d):
    p = vectors.PrincipalComponents(_e(s, d), "embedding", 2)
    out = p.apply(_e(s, d), "embedding")
    return out.select("vec_id", F.round(F.col("projection")[0], 5).alias("x"), F.round(F.col("projection")[1], 5).alias("y"))


def _scored(s, d):
    """Probabilities for the metrics: late flags of lineitem against a score from discount and tax."""
    return table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(0.05 + F.col("l_discount") * 6 + F.col("l_tax") * 3, 4).alias("p"), "l_suppkey", "l_orderkey", "l_linenumber")


def rank_auc(s, d):
    """A34."""
    return stats.rank_auc(_scored(s, d), "y", "p")


def within_group_auc(s, d):
    """A34, A41 within suppliers."""
    return stats.pairwise_accuracy(_scored(s, d), "l_suppkey", "y", "p")


def brier_logloss(s, d):
    return stats.binary_metrics(_scored(s, d), "y", "p")


def average_precision(s, d):
    return stats.average_precision(_scored(s, d), "y", "p")


def calibration_bins(s, d):
    """M13."""
    return stats.calibration(_scored(s, d), "y", "p")


def constant_baseline(s, d):
    """The prevalence as everyone's probability."""
    x = _scored(s, d)
    return stats.binary_metrics(x.drop("p").crossJoin(F.broadcast(x.agg(F.avg("y").alias("p")))), "y", "p")  # one row of prevalence


def ndcg_recall_at_5(s, d):
    """Orders as cases, quantity classes as grades."""
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 17).cast("int").alias("grade"), F.round("l_extendedprice", 2).alias("score"))
    l = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("grade").alias("grade"), F.max("score").alias("score"))
    return stats.ranking_metrics(l, "l_orderkey", "grade", "score", "l_linenumber")


def drift_population_sd(s, d):
    """Features of stored blocks against those of candidates."""
    old = table(s, d, "blocks").where("text IS NOT NULL AND trim(text) <> ''").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    new = table(s, d, "candidate_results").select("snapshot_id", F.size(F.filter("blocks", lambda b: F.trim(b["text"]) != "")).alias("n_blocks"), F.length("text").alias("n_chars")).where("n_blocks >= 0")
    return stats.drift(old, new, "snapshot_id", ["n_blocks", "n_chars"])


def bootstrap_interval(s, d):
    """Body words with whole hosts resampled."""
    f = table(s, d, "quality_flags").select("raw_id", "hostname", "body_words").distinct()
    return stats.group_bootstrap(f.where("hostname IS NOT NULL"), "hostname", "body_words").select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


def auc_delta(s, d):
    """A score of discount and tax against one of discount alone, suppliers resampled."""
    x = table(s, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.lit(0.05) + F.col("l_discount") * 6 + F.col("l_tax") * 3, 4).alias("p"), F.round("l_discount", 4).alias("q"), "l_suppkey"
    )
    return stats.auc_delta(x, "l_suppkey", "y", "q", "p", 100).select(*[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


def pending_embeddings(s, d):
    """Texts to embed, against an empty cache, with the offline provider."""
    u = table(s, d, "blocks").where("text IS NOT NULL").select("text", F.lit("document").alias("role"))
    return vectors.embed_pending(u, None, "offline-8").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"))


def cache_summary(s, d):
    """S18, S25."""
    u = table(s, d, "blocks").where("text IS NOT NULL").select("text", F.lit("document").alias("role"))
    return vectors.cache_status(vectors.embed_pending(u, None, "offline-8")).select("model", "vectors", "failed", F.col("width").cast("bigint").alias("width"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_norms, knn_cosine, section_topk, weighted_pool, dimension_stats, pca_explained, pca_projection, rank_auc, within_group_auc, brier_logloss, average_precision, calibration_bins,
        constant_baseline, ndcg_recall_at_5, drift_population_sd, bootstrap_interval, auc_delta, pending_embeddings, cache_summary,
    )
}

_S = "WITH x AS (SELECT (l_returnflag = 'R')::INT AS y, round(0.05 + l_discount * 6 + l_tax * 3, 4) AS p, l_suppkey FROM lineitem) "
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_BIN = "SELECT count(*) AS n_rows, round(avg(y), 6) AS prevalence, round(-avg(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM "
_RANK = "c AS (SELECT {g} p, count(*) AS t, sum(y) AS up FROM x GROUP BY ALL), r AS (SELECT *, sum(t) OVER (PARTITION BY {pg} ORDER BY p) - t + (t + 1) / 2 AS rank FROM c), a AS (SELECT {g} sum(t)::BIGINT AS n_rows, sum(up)::BIGINT AS positives, sum(rank * up) AS r FROM r GROUP BY ALL) "
_DRAW = "d AS (SELECT *, ('0x' || substr(md5('142:' || {group} || ':' || b), 1, 13))::BIGINT / 4503599627370496.0 AS draw FROM {cells}, range(1, {repeats} + 1) t(b)), w AS (SELECT *, (draw >= 0.367879441171)::INT + (draw >= 0.735758882343)::INT + (draw >= 0.919698602929)::INT + (draw >= 0.981011843124)::INT + (draw >= 0.996340153173)::INT + (draw >= 0.999405815182)::INT + (draw >= 0.999916758851)::INT + (draw >= 0.999989750803)::INT AS w FROM d)"
ORACLE = {
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "knn_cosine": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5",
    "section_topk": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s) SELECT query_id, round(max(s), 6) AS best, round(avg(s) FILTER (r <= 3), 6) AS top3, round(quantile_cont(s, 0.25), 6) AS q25, round(median(s), 6) AS median, round(quantile_cont(s, 0.75), 6) AS q75, count(*) AS n, count(DISTINCT vec_id) AS sections, string_agg(vec_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS best_sections FROM r GROUP BY query_id",
    "weighted_pool": "WITH m AS (SELECT label, (vec_id % 7 + 1)::DOUBLE AS w, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), x AS (SELECT label, unnest(e) * w / l AS x, generate_subscripts(e, 1) AS i FROM m WHERE l > 0), t AS (SELECT label, i, sum(x) AS x FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS l, count(*) AS width FROM t GROUP BY 1) SELECT t.label, round(t.x / n.l, 6) AS first, width FROM t JOIN n USING (label) WHERE i = 1",
    "dimension_stats": "SELECT i - 1 AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i",
    "rank_auc": _S + "," + _RANK.format(g="", pg="1") + "SELECT n_rows, positives, round((r - positives * (positives + 1) / 2) / (positives * (n_rows - positives)), 6) AS auc FROM a",
    "within_group_auc": _S + "," + _RANK.format(g="l_suppkey,", pg="l_suppkey") + "SELECT l_suppkey, positives * (n_rows - positives) AS pairs, round((r - positives * (positives + 1) / 2) / (positives * (n_rows - positives)), 6) AS accuracy FROM a WHERE positives > 0 AND n_rows > positives",
    "brier_logloss": _S + _BIN + "x",
    "average_precision": _S + ", c AS (SELECT p, count(*) AS t, sum(y) AS up FROM x GROUP BY p), w AS (SELECT up, sum(up) OVER (ORDER BY p DESC) / sum(t) OVER (ORDER BY p DESC) AS pr FROM c) SELECT round(sum(pr * up) / sum(up), 6) AS average_precision FROM w",
    "calibration_bins": _S + ", q AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM x) SELECT len(list_filter(e, lambda v: p > v)) AS bin, count(*) AS n_rows, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS share FROM x, q GROUP BY bin",
    "constant_baseline": _S + _BIN + "(SELECT y, avg(y) OVER () AS p FROM x)",
    "ndcg_recall_at_5": "WITH l AS (SELECT l_orderkey, l_linenumber, max(floor(l_quantity / 17)::INT) AS grade, max(round(l_extendedprice, 2)) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY grade DESC, l_linenumber) AS i FROM l), g AS (SELECT l_orderkey, sum(CASE WHEN r <= 5 THEN (2 ** grade - 1) / log2(r + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= 5 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS b, count(*) FILTER (r <= 5 AND grade > 0) AS h, count(*) FILTER (grade > 0) AS n FROM r GROUP BY 1) SELECT l_orderkey, round(CASE WHEN b > 0 THEN d / b END, 6) AS ndcg, round(CASE WHEN n > 0 THEN h / n END, 6) AS recall FROM g",
    "drift_population_sd": "WITH o AS (SELECT snapshot_id, count(*) AS n_blocks, sum(length(text)) AS n_chars FROM blocks WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1), c AS (SELECT snapshot_id, len(list_filter(blocks, lambda b: trim(b.text) <> '')) AS n_blocks, length(text) AS n_chars FROM candidate_results WHERE blocks IS NOT NULL), j AS (SELECT 'n_blocks' AS feature, o.n_blocks::DOUBLE AS o, c.n_blocks::DOUBLE AS n FROM o JOIN c USING (snapshot_id) UNION ALL SELECT 'n_chars', o.n_chars::DOUBLE, c.n_chars::DOUBLE FROM o JOIN c USING (snapshot_id)) SELECT feature, round(avg(abs(n - o)), 6) AS mean_abs, round(avg(abs(n - o)) / nullif(stddev_pop(o), 0), 6) AS relative, round(avg((abs(n - o) > 1e-12)::INT), 6) AS changed FROM j WHERE n IS NOT NULL AND o IS NOT NULL GROUP BY feature",
    "bootstrap_interval": "WITH f AS (SELECT hostname, sum(body_words)::DOUBLE AS s, count(*) AS n FROM (SELECT DISTINCT raw_id, hostname, body_words FROM quality_flags) WHERE hostname IS NOT NULL AND body_words IS NOT NULL GROUP BY 1), "
    + _DRAW.format(group="hostname", repeats=500, cells="f")
    + ", m AS (SELECT b, sum(s * w) / sum(n * w) AS m FROM w GROUP BY b) SELECT (SELECT round(sum(s) / sum(n), 6) FROM f) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m",
    "auc_delta": "WITH x AS (SELECT (l_returnflag = 'R')::INT AS y, round(0.05 + l_discount * 6 + l_tax * 3, 4) AS p, round(l_discount, 4) AS q, l_suppkey FROM lineitem), f AS (SELECT l_suppkey, which, p, sum(y) AS up, count(*) FILTER (y = 0) AS down FROM (SELECT l_suppkey, y, 'new' AS which, p FROM x UNION ALL SELECT l_suppkey, y, 'old', q FROM x) GROUP BY 1, 2, 3), "
    + _DRAW.format(group="l_suppkey", repeats=100, cells="(SELECT DISTINCT l_suppkey FROM f)")
    + ", a AS (SELECT l_suppkey, b, w FROM w UNION ALL SELECT DISTINCT l_suppkey, 0, 1 FROM f), s AS (SELECT b, which, p, sum(w * up)::DOUBLE AS up, sum(w * down)::DOUBLE AS down FROM f JOIN a USING (l_suppkey) GROUP BY 1, 2, 3), r AS (SELECT *, sum(down) OVER (PARTITION BY b, which ORDER BY p) - down / 2 AS below FROM s), u AS (SELECT b, which, sum(up * below) / (sum(up) * sum(down)) AS auc FROM r GROUP BY 1, 2), g AS (SELECT b, max(auc) FILTER (which = 'new') - max(auc) FILTER (which = 'old') AS gap FROM u GROUP BY b) SELECT (SELECT round(gap, 6) FROM g WHERE b = 0) AS estimate, round(quantile_cont(gap, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(gap, 0.975) FILTER (b > 0), 6) AS high FROM g",
    "pending_embeddings": "SELECT 'success' AS status, count(DISTINCT text) AS n, 8 AS width FROM blocks WHERE text IS NOT NULL",
    "cache_summary": "SELECT 'offline-8' AS model, count(DISTINCT text) AS vectors, 0 AS failed, 8 AS width FROM blocks WHERE text IS NOT NULL",
}
