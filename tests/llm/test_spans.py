import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import spans
from weftline.llm.spans import SharedSpans, align_chain, chain_seeds, seeds_of


def brute(docs, least):
    by = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - least + 1):
            by[t[p : p + least]].add(i)
    return {(a, b) for g in by.values() for a in g for b in g if a < b}


def random_docs(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(n) for n in (30, 39, 40, 41, 60, 120)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 80))] + [x for _ in range(rng.randint(0, 2)) for x in (rng.choice(shared), text(rng.randint(1, 50)))]
        docs.append((i, "".join(parts)))
    hot = text(45)
    docs += [(100 + i, text(20) + hot + text(10)) for i in range(50)]  # more places than FEW
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "ab" * 100), (205, "ba" * 90), (206, "x" * 500), (207, "y" + "x" * 60), (208, shared[4] + "12" + shared[4])]
    return docs


def test_pairs_equal_brute_force(spark):
    for seed in (1, 2):
        docs = random_docs(seed)
        df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(5, docs[5][1], 0)], "doc_id BIGINT, text STRING, rep INT")
        got = [tuple(r) for r in SharedSpans(spark, df, 40).pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, 40)


def test_coverage_and_spans(spark):
    a, b, c = "q" * 3 + "".join(chr(97 + i % 23) for i in range(0, 700, 7)), "", ""
    b = "zz" + a[10:70] + "yy" + a[20:65]
    c = "nothing shared with any other of them at all"
    s = SharedSpans(spark, spark.createDataFrame([(1, a), (2, b), (3, c), (4, None)], "doc_id BIGINT, text STRING"), 40)
    cover = {r.doc_id: r.shared for r in s.coverage().collect()}
    mark = [False] * len(a)
    for p in range(len(a) - 39):
        if a[p : p + 40] in b:
            mark[p : p + 40] = [True] * 40
    assert cover[1] == sum(mark) and cover[3] == 0
    for r in s.spans.where("kind = 'exact'").collect():
        assert a[r.a_from : r.a_to] == b[r.b_from : r.b_to] and r.equal >= 40


def test_a_stretch_in_many_texts_is_aligned_once_for_each(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, n = text(90), 300
    s = SharedSpans(spark, spark.createDataFrame([(i, text(30) + hot + text(25)) for i in range(n)], "doc_id BIGINT, text STRING"), 40)
    assert s.spans.select("a", "b").distinct().count() < 10 * n and s.pairs().count() == n * (n - 1) // 2
    assert s.coverage().where("shared >= 90").count() == n


def test_nothing(spark):
    s = SharedSpans(spark, spark.createDataFrame([], "doc_id BIGINT, text STRING"), 200)
    assert s.pairs().isEmpty() and s.coverage().isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", min_size=0, max_size=40), st.text(alphabet="abcdef", min_size=40, max_size=60), st.text(alphabet="abc", min_size=0, max_size=40))
def test_a_long_stretch_has_a_common_seed(before, stretch, after):
    x, y = before + stretch, stretch + after
    assert set(seeds_of(x, 40)[0]) & set(seeds_of(y, 40)[0])


def test_chains_take_every_seed_in_order():
    pairs = [(0, 100), (50, 150), (100, 200), (60, 20), (300, 5000)]
    chains = chain_seeds(pairs, 30)
    assert sorted(p for c in chains for p in c) == sorted(pairs)
    assert chains[0] == [(0, 100), (50, 150), (100, 200)]
    assert all(u[0] < v[0] and u[1] < v[1] for c in chains for u, v in zip(c, c[1:]))
    assert chain_seeds([], 30) == []


def test_alignment_extends_seeds():
    found, passage = align_chain("xxhello worldyy", "zhello worldq", [(3, 2)], 4)
    assert found == [(2, 1, 11)] and passage == (2, 13, 1, 12, 11)
    assert align_chain("abcdef", "zzzzzz", [(0, 0)], 4)[0] == []


def test_chain_scores_are_the_best():
    rng = random.Random(4)
    for _ in range(30):
        pairs = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(9)})
        k = 20

        def value(chain):
            v = float(k)
            for (a, b), (c, d) in zip(chain, chain[1:]):
                v += min(k, c - a, d - b) - spans.GAP_COST * (c - a + d - b)
            return v

        best = [float(k)] * len(pairs)
        for i, (c, d) in enumerate(pairs):
            for j, (a, b) in enumerate(pairs[:i]):
                if a < c and b < d and max(c - a, d - b) <= spans.GAP_MOST + k:
                    best[i] = max(best[i], best[j] + min(k, c - a, d - b) - spans.GAP_COST * (c - a + d - b))
        assert value(chain_seeds(pairs, k)[0]) <= max(best) + 1e-9
        assert np.isfinite(value(chain_seeds(pairs, k)[0]))
