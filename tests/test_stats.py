import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import model, stats, vectors
from weftline.sources.corpus import CORPUS, check_schema, repeated_tail, run_identity, through_process


def test_wilcoxon_with_ties(spark):
    d = [1.0, 2.0, 2.0, -3.0, 4.0, -1.0, 5.0, 6.0, 7.0, 0.0, 8.0, -2.0]
    df = spark.createDataFrame([("f", x) for x in d], "feature STRING, diff DOUBLE")
    r = stats.wilcoxon(df).collect()[0]
    x = np.array([v for v in d if v])
    a = np.abs(x)
    ranks = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    n, w = len(x), ranks[x > 0].sum()
    ties = sum(c**3 - c for c in np.unique(a, return_counts=True)[1])
    z = (w - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (r.n, r.w_plus) == (n, w) and r.z == pytest.approx(z, abs=1e-6)
    assert stats.wilcoxon(df.limit(5)).collect()[0].p is None


def test_fit_is_close_to_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - x[:, 1])))).astype(int)
    rows = [(i, float(a), float(b) if i % 5 else None, int(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE, y INT")
    m = model.fit(df, ["a", "b"], "y", 1.0)
    b = np.array([r[2] if r[2] is not None else np.nan for r in rows])
    design = np.column_stack([x[:, 0], np.where(np.isnan(b), np.nanmedian(b), b), np.isnan(b).astype(float)])
    design = (design - design.mean(0)) / design.std(0)
    full = np.column_stack([design, np.ones(400)])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        grad = full.T @ (p - y) + np.append(w[:3], 0)
        hess = full.T @ (full * (p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0])
        w -= np.linalg.solve(hess, grad)
    assert [m.coefficients[n] for n in m.inputs] == pytest.approx(list(w[:3]), abs=2e-3)
    c = m.contributions(df, "id").groupBy("id").agg(F.sum("contribution").alias("s")).orderBy("id").collect()
    logit = m.score(df).select("id", F.log(F.col("probability") / (1 - F.col("probability"))).alias("l")).orderBy("id").collect()
    assert c[3].s + m.intercept == pytest.approx(logit[3].l, abs=1e-6)


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 23}", i % 2) for i in range(300)], "g STRING, y INT")
    folds = model.group_folds(df, "g", "y")
    assert folds.count() == 23 and folds.select("fold").distinct().count() == 4
    assert model.shuffled_hosts(["b", "a", "a"]) == model.shuffled_hosts(["a", "b"])
    counts = {s: list(model.shuffled_hosts([f"h{i}" for i in range(970)]).values()).count(s) for s in ("train", "validation", "test")}
    assert counts == {"train": 776, "validation": 97, "test": 97}


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(99, None, 1), (98, [0.0] * 5, 1), (97, [1.0], 1)], "vec_id BIGINT, embedding ARRAY<FLOAT>, rank INT")
    got = vectors.nearest(spark, df.where("vec_id % 20 = 0"), df, 3, block=2).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in (0, 20, 40):
        s = unit @ unit[q]
        s[q] = -9
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(np.argsort(-s)[:3])


def test_embedding_provider_faults(spark):
    def broken(text, role):
        if text == "bad":
            raise RuntimeError("no")
        return [1.0]

    units = spark.createDataFrame([("bad", "d"), ("good", "d"), ("good", "d"), (None, "d"), ("x" * 300, "d")], "text STRING, role STRING")
    first = vectors.embed_pending(units, None, "m", broken, ceiling=200)
    assert sorted(r.status for r in first.collect()) == ["failed", "failed", "success"]
    assert vectors.embed_pending(units, first, "m", broken, ceiling=200).isEmpty()


def test_sources(spark):
    with pytest.raises(ValueError):
        check_schema(spark.createDataFrame([], "a INT"), CORPUS)
    assert repeated_tail([1, 2] + list(range(20)) * 3) and not repeated_tail(list(range(100)))
    assert run_identity({"a": 1, "b": 2}) == run_identity({"b": 2, "a": 1}) != run_identity({"a": 1})
    df = spark.createDataFrame([("a",), (None,)], "t STRING")
    assert [r.answer for r in through_process(df, "t", ["/no/such/program"], str).collect()] == [None, None]
    assert {r.answer for r in through_process(df, "t", ["cat"], str.strip).collect()} == {'"a"', None}


def test_promotion_gate():
    assert model.promotion_gate(0.1, 0.7, 0.68, 0.01, 0.05) == []
    assert len(model.promotion_gate(0.5, 0.6, 0.68, 0.05, 0.05)) == 3


def test_running_sums_equal_one_window(spark):
    rng = np.random.default_rng(1)
    rows = [(float(round(v, 2)), int(n)) for v, n in zip(rng.normal(size=2000), rng.integers(0, 9, 2000))] + [(None, 3)]
    df = spark.createDataFrame(rows, "v DOUBLE, n INT")
    for r in stats.running_sums(df, "v", ["n"]).collect():
        want = 0 if r.v is None else 3 + sum(n for v, n in rows if v is not None and v < r.v)
        assert r.before_n == want
    assert stats.running_sums(df.limit(0), "v", ["n"]).isEmpty()


def test_paired_auc_delta(spark):
    rows = [(g, int(g % 2 == 0), 0.5, 0.9 if g % 2 == 0 else 0.1) for g in range(40)]
    df = spark.createDataFrame(rows, "g INT, y INT, old DOUBLE, new DOUBLE")
    r = stats.auc_delta(df, "g", "y", "old", "new", 40).collect()[0]
    assert (r.estimate, r.low, r.high) == (0.5, 0.5, 0.5)
