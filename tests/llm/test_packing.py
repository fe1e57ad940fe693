import random

from pyspark.sql import functions as F

from weftline.llm import mixing, packing
from weftline.llm.tokens import count_tokens

DOCS = "doc_id BIGINT, text STRING, source STRING, n_tokens INT, piece STRING, bin_id STRING"


def greedy(sizes, capacity):
    """Sum of squares, told item by item from its definition."""
    gaps, out = [], []

    def total(g):
        counts = {}
        for x in g:
            if 0 < x < capacity:
                counts[x] = counts.get(x, 0) + 1
        return sum(c * c for c in counts.values())

    for s in sizes:
        best = None
        for i in [j for j, g in enumerate(gaps) if g >= s] + [len(gaps)]:
            trial = gaps[:] + ([capacity] if i == len(gaps) else [])
            trial[i] -= s
            # The smallest gap among equals, a new container last.
            key = (total(trial), i == len(gaps), gaps[i] if i < len(gaps) else 0)
            if best is None or key < best[0]:
                best = (key, i, trial)
        gaps = best[2]
        out.append(best[1])
    return gaps


def test_equal_to_the_definition():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 20) for _ in range(40)]
        p = packing.SumOfSquares(20)
        used = {}
        for s in sizes:
            n = p.place(s)
            used[n] = used.get(n, 0) + s
        assert max(used.values()) <= 20
        assert sorted(20 - u for u in used.values()) == sorted(greedy(sizes, 20))


def test_no_task_gets_all_that_cannot_be_filled(spark):
    items = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "1100 AS tokens")
    packed = packing.pack_items(spark, items, 2048, per_packer=250)
    assert packed.count() == 4000 == packed.select("bin_id").distinct().count()
    assert packed.selectExpr("bin_id >> 36 AS packer").groupBy("packer").count().agg(F.max("count"), F.count("*")).collect()[0][0] < 350
    # One small item opens all of them once; it doesn't bring them to one packer.
    packed = packing.pack_items(spark, items.unionAll(spark.createDataFrame([(9000, 0, 10)], "doc_id BIGINT, piece INT, tokens INT")), 2048, per_packer=250)
    assert packed.count() == 4001 and packed.selectExpr("bin_id >> 36 AS packer").groupBy("packer").count().agg(F.max("count")).collect()[0][0] < 350


def test_packing_keeps_every_item(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, 0, rng.randint(1, 100), "x") for i in range(3000)] + [(5, 0, 40, "x")], "doc_id BIGINT, piece INT, tokens INT, bin_id STRING")
    packed = packing.pack_items(spark, items, 128, per_packer=200)
    assert packed.count() == 3001
    assert packed.groupBy("bin_id").agg(F.sum("tokens").alias("n")).where("n > 128").isEmpty()
    r = packing.packing_report(packed, 128).collect()[0]
    alone = packing.packing_report(packing.pack_items(spark, items, 128, per_packer=10_000), 128).collect()[0]
    assert r["items"] == 3001 and r.used_share > 0.96 * alone.used_share and alone.containers >= alone.least
    assert packing.pack_items(spark, items.limit(0), 128).isEmpty()


def test_items_of_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 300, "a", 1, "p", "b"), (2, None, "a", 1, "p", "b"), (3, " \n", "a", 1, "p", "b"), (4, "hi", None, None, None, None), (1, "word " * 300, "a", 1, "p", "b")], DOCS)
    got = packing.token_items(docs, 128).orderBy("doc_id", "piece").collect()
    n = count_tokens("word " * 300)
    assert [(r.doc_id, r.piece, r.tokens) for r in got if r.doc_id == 4] == [(4, 0, count_tokens("hi"))]
    assert sum(r.tokens for r in got if r.doc_id == 1) == 2 * n and max(r.tokens for r in got) <= 128
    assert packing.token_items(docs.limit(0), 128).isEmpty()


def test_poisson_chances():
    for rate, cap in ((0.3, 1), (0.9, 1), (1.5, 2), (3.9, 20), (0.01, 5)):
        chances = mixing.capped_chances(mixing.raised_mean(rate, cap), cap)
        assert abs(sum(1 - p for p in chances) - rate) < 1e-6 and chances == sorted(chances)


def test_mixture(spark):
    rows = [(i, f"some words of text number {i}", ["Alpha", " alpha ", "beta", "gamma", None][i % 5], 1, "p", "b") for i in range(5000)]
    docs = spark.createDataFrame([*rows, (9001, None, "beta", 1, "p", "b"), (9002, " ", "beta", 1, "p", "b")], DOCS)
    targets = spark.createDataFrame([("Alpha", 0.5, 3), ("beta", 0.3, 1), ("gamma", 0.2, 9), ("none", 0.05, 4), ("nulls", None, None)], "source STRING, target_share DOUBLE, max_repeats INT")
    sized = mixing.sized_documents(spark, docs)
    plan = mixing.mix_plan(sized, targets)
    mixed = mixing.mixture(sized, plan)
    got = {r.source: r for r in mixing.mixture_shares(mixed, plan).collect()}
    assert {s for s, r in got.items() if r.short} == {"beta", "none"}
    total = sized.agg(F.sum("n_tokens")).collect()[0][0]
    assert abs(got["Alpha"].tokens / total - 0.5) < 0.03 and abs(got["gamma"].tokens / total - 0.2) < 0.03
    copies = mixed.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()
    assert all(r.m <= {"Alpha": 3, "beta": 1, "gamma": 9}[r.source] for r in copies)
    assert sorted(mixed.collect()) == sorted(mixing.mixture(sized, plan).collect())
    empty = mixing.mix_plan(sized.limit(0), targets)
    assert mixing.mixture(sized.limit(0), empty).isEmpty()
