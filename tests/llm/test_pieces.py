from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import pieces
from weftline.llm.split_queries import ORACLE  # noqa: F401


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,。", max_size=300), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_the_text(text, limit, overlap):
    spans = pieces.pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(n[0] == max(0, p[1] - overlap) for p, n in zip(spans, spans[1:]))
    assert text == text[spans[0][0] : spans[0][1]] + "".join(text[p[1] : n[1]] for p, n in zip(spans, spans[1:]))


def best_cost(text, limit, overlap):
    """The cheapest way by trying all, as `cut_points` states its costs."""
    room = limit - overlap
    at, penalty = pieces.boundaries(text, room)
    count = 1 + -(-(len(text) - limit) // room)
    even = max(1.0, (len(text) - overlap) / count)

    @lru_cache(None)
    def go(i):
        if i == len(at) - 1:
            return 0.0
        costs = [np.inf]
        for j in range(i + 1, len(at)):
            own = at[j] - at[i]
            if own > (limit if i == 0 else room):
                break
            costs.append(penalty[j] + pieces.BALANCE * ((own - even) / even) ** 2 + 1.0 + go(j))
        return min(costs)

    return go(0), (at, penalty, even)


@pytest.mark.parametrize("text", ["aa bb. cc dd, ee ff. gg", "aaaaaaaaaaaaaaaaaaaaaaaaa bb", "a b\n\nc d e f. g h"])
def test_cuts_are_the_cheapest(text):
    cost, (at, penalty, even) = best_cost(text, 9, 2)
    ends = pieces.cut_points(text, 9, 2)
    where = {int(a): p for a, p in zip(at, penalty)}
    total, start = 0.0, 0
    for e in ends:
        total += where[e] + pieces.BALANCE * ((e - start - even) / even) ** 2 + 1.0
        start = e
    assert total == pytest.approx(cost)


def test_natural_boundaries_are_kept():
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    for a, b in pieces.pieces(text, 400, 20)[:-1]:
        assert text[:b].rstrip().endswith(".")


def test_forced():
    assert pieces.has_forced("x" * 11, 10) and not pieces.has_forced("x" * 10 + " y", 10) and not pieces.has_forced("字" * 8 + "。" + "字" * 8, 10)


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        pieces.cut_points("abc", 5, 5)


def test_tables(spark):
    blocks = spark.createDataFrame([(1, "  " + "a b " * 10 + " ", 9), (2, None, 9), (3, "", 9), (4, "x" * 50, 9), (5, "short", 9), (4, "x" * 50, 9)], "block_uid BIGINT, text STRING, item_id INT")
    results = spark.createDataFrame(
        [(1, [("b", 2, "p", " two "), ("a", 1, "p", "one" * 10), ("c", None, "p", None), ("d", 3, "p", "  ")], "x"), (2, None, "x"), (3, [], "x"), (4, [("a", 1, "p", "y y " * 20)], "x")],
        "result_id BIGINT, blocks ARRAY<STRUCT<block_id STRING, block_order INT, block_type STRING, text STRING>>, text STRING",
    )
    out = pieces.split_all(blocks, results, 20, 30, 4).collect()
    found = sorted({(r.item_kind, r.item_id, r.cut_kind) for r in out})
    assert found == [("block", 1, "natural"), ("block", 4, "forced"), ("result", 1, "natural"), ("result", 4, "natural")]
    assert sum(r.piece == 0 for r in out if r.item_id == 4 and r.item_kind == "block") == 2
    one = [r.text for r in sorted((r for r in out if (r.item_kind, r.item_id) == ("result", 1)), key=lambda r: r.piece)]
    assert one[0].startswith("oneone") and one[-1].endswith("two")
    assert pieces.split_all(blocks.limit(0), results.limit(0), 20, 30, 4).isEmpty()


def test_very_long_text():
    text = "word " * 40_000
    assert all(b - a <= 2000 for a, b in pieces.pieces(text, 2000, 120))
    assert all(b - a <= 2000 for a, b in pieces.pieces("x" * 100_000, 2000, 120))
