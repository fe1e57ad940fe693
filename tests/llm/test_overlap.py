import random

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.split_overlap import BITS, Automaton, Held, SplitOverlap, bitmaps, common_table, common_words, most_apart, passages


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_common_words(a, b):
    assert common_words(a, b) == lcs(a, b)


def test_passages_are_short_uncommon_runs():
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    stock = [word() for _ in range(6)]
    texts = [" ".join([word() for _ in range(20)] + stock + [word() for _ in range(20)]) for _ in range(12)]
    table = common_table(texts)
    owner, _, first, count = passages([*texts, "", "one two"], table, 500)
    for t, a, n in zip(owner.tolist(), first.tolist(), count.tolist()):
        run = [*texts, "", "one two"][t].split(" ")[a : a + n]
        assert n >= 2 and not all(w in stock for w in run)
    assert set(owner.tolist()) == {*range(12), 13}
    # Variants of one text don't make their runs common.
    variants = [texts[0] + f" end{i}" for i in range(8)] + texts[1:4]
    assert np.bincount(passages(variants, common_table(variants), 500)[0])[0] > 30


def test_automaton_merges_intervals():
    table = common_table([])
    text = "a b c d e f g h"
    found = Automaton({7: text}, table).coverage("x a b c y e f z")
    assert found == {7: 5 / 8} and Automaton({}, table).coverage(text) == {} and Automaton({7: text}, table).coverage("q") == {}


STRESS = "raw_id BIGINT, split STRING, mark STRING"
FLAGS = "raw_id BIGINT, hostname STRING, href STRING"


def page(words, style="html"):
    text = " ".join(words)
    return f"<html><body><h1>{words[0]}</h1><p>{text}</p></body></html>" if style == "html" else f"# {words[0]}\n\n{text.upper()}\n"


def test_pairs_equal_brute_force(spark, make_raw):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [[word() for _ in range(70)] for _ in range(12)]
    texts = []
    for i, b in enumerate(base):
        texts.append(b)
        for keep in (1.0, 0.9, 0.75, 0.6, 0.3):
            cut = int(len(b) * keep)
            texts.append(b[:cut] + [word() for _ in range(len(b) - cut)])
    rows = [(i, f"h{i % 7}.test", page(t, "html" if i % 3 else "md")) for i, t in enumerate(texts)]
    rows += [(900, "h.test", None), (901, "h.test", "   "), (902, "h.test", "tiny"), (903, None, page(base[0]))]
    splits = [(i, ["train", "Test ", "validation", None][i % 4], "m") for i in range(len(texts))] + [(900, "test", "m"), (901, "train", "m"), (903, "train", "m"), (0, "train", "m"), (0, "train", "m")]
    raw = make_raw(rows)
    out = SplitOverlap(spark, raw, spark.createDataFrame(splits, STRESS), spark.createDataFrame([(0, "a.test", None), (0, "a.test", None), (1, None, None)], FLAGS), 300, 0.7)
    got = {(r.eval_id, r.train_id) for r in out.pairs().collect()}
    name = {i: (s or "").strip().lower() for i, s, _ in splits}
    words = {i: [texts[i][0].lower(), *[w.lower() for w in texts[i]]] for i in range(len(texts))} | {903: [base[0][0], *base[0]]}
    want = set()
    for a in words:
        for b in words:
            if name.get(a) in ("test", "validation") and name.get(b) == "train" and lcs(words[a], words[b]) >= 0.7 * max(len(words[a]), len(words[b])):
                want.add((a, b))
    assert got == want and want
    assert out.report().agg({"pairs": "sum"}).collect()[0][0] == len(want)


def test_nothing(spark, make_raw):
    out = SplitOverlap(spark, make_raw([]), spark.createDataFrame([], STRESS), spark.createDataFrame([], FLAGS), 300, 0.7)
    assert out.pairs().isEmpty() and out.report().isEmpty()


def edited(rng, text, every, word):
    """The text with every `every`-th word, or a random one in `every` if negative, put in anew."""
    return [word() if (i % every == 0 if every > 0 else rng.random() < -1 / every) else w for i, w in enumerate(text)]


def test_scattered_edits_are_found(spark, make_raw):
    """Single words changed all over leave no long run, or no passage of five words, in common."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    kana = lambda: chr(0x4E00 + rng.randrange(3000))
    texts = []
    for make, sizes in ((word, (60, 300)), (kana, (320,))):
        for n in sizes:
            for every in (4, 5, -5, -4, -3):
                base = [make() for _ in range(n)]
                texts += [base, edited(rng, base, every, make)]
    bodies = [(" " if len(t[0]) > 1 else "").join(t) for t in texts]
    raw = make_raw([(i, f"h{i % 7}.test", f"<html><body><p>{b}</p></body></html>") for i, b in enumerate(bodies)])
    splits = [(i, "test" if i % 2 else "train", "m") for i in range(len(texts))]
    out = SplitOverlap(spark, raw, spark.createDataFrame(splits, STRESS), spark.createDataFrame([], FLAGS), 300, 0.7)
    got = {(r.eval_id, r.train_id) for r in out.pairs().collect()}
    want = {(i, j) for i in range(1, len(texts), 2) for j in range(0, len(texts), 2) if lcs(texts[i], texts[j]) >= 0.7 * max(len(texts[i]), len(texts[j]))}
    assert got == want and len(want) >= 12


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=40), min_size=1, max_size=5), st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=40))
def test_candidates_miss_nothing(held, words):
    got = {m for m, _, _, _ in Held([(i, " ".join(h)) for i, h in enumerate(held)], 0.7).matches(-1, " ".join(words))}
    assert got == {i for i, h in enumerate(held) if lcs(h, words) >= 0.7 * max(len(h), len(words))}


def test_routing_finds_scattered_edits():
    """Recall of the routing against brute force: single words changed all over, in texts among many of their kind."""
    rng = random.Random(9)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    corpus = [[rng.choice(stock) for _ in range(rng.randrange(60, 400))] for _ in range(900)]
    table = common_table([" ".join(t) for t in corpus[:400]])
    seen = hit = 0
    for every in (6, 7, 8, 9, 10, 11, 12):
        base = corpus[every * 40 : every * 40 + 40]
        other = [edited(rng, t, every, lambda: rng.choice(stock)) for t in base]
        found = [passages([" ".join(t) for t in texts], table) for texts in (base, other)]
        for i, (a, b) in enumerate(zip(base, other)):
            if lcs(a, b) >= 0.7 * len(a):
                seen += 1
                both = set(found[0][1][found[0][0] == i].tolist()) & set(found[1][1][found[1][0] == i].tolist())
                hit += len(both) >= 2
    assert seen > 250 and hit >= 0.98 * seen


def test_bitmaps_bound_the_difference():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcdefghijklmn") for _ in range(rng.randrange(1, 60))] for _ in range(2))
        x, y = (np.frombuffer(m, np.uint64) for m in bitmaps([" ".join(a), " ".join(b)]))
        assert len(x) == BITS // 64 and int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * lcs(a, b)
        if lcs(a, b) >= 0.7 * max(len(a), len(b)):
            assert len(a) + len(b) - 2 * lcs(a, b) <= int(most_apart(np.int64(len(a)), len(b), 0.7))


def test_exact_mode_needs_no_common_passage(spark, make_raw):
    """Every fourth word differs: no passage of five words is in both texts, 75 % of the words are."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(200)]
    other = edited(rng, base, 4, word)
    raw = make_raw([(i, f"h{i}.test", f"<html><body><p>{' '.join(t)}</p></body></html>") for i, t in enumerate((base, other))])
    for exact in (True, False):
        out = SplitOverlap(spark, raw, spark.createDataFrame([(0, "train", "m"), (1, "test", "m")], STRESS), spark.createDataFrame([], FLAGS), 300, 0.7, exact=exact)
        assert [(r.eval_id, r.train_id, r.same) for r in out.pairs().collect()] == [(1, 0, 0.75)]
        assert [(r.split, r.records, r.pairs) for r in out.report().collect()] == [("test", 1, 1)]


def test_records_of_one_payload_are_one_text(spark, make_raw):
    words = [f"w{i * 7919 % 1000}x" for i in range(120)]
    raw = make_raw([(i, f"h{i}.test", f"<html><body><p>{' '.join(words)}</p></body></html>") for i in range(4)])
    stress = spark.createDataFrame([(0, "train", "s"), (1, "test", "s"), (2, "test", None), (3, "validation", "gone")], "raw_id BIGINT, split STRING, snapshot_id STRING")
    snapshots = spark.createDataFrame([("s", "p"), ("s", "p"), (None, "q"), ("t", None)], "snapshot_id STRING, payload_hash STRING")
    out = SplitOverlap(spark, raw, stress, spark.createDataFrame([], FLAGS), 300, 0.7, snapshots)
    assert {(r.eval_id, r.train_id) for r in out.pairs().collect()} == {(1, 0), (2, 0), (3, 0)}


def test_no_pair_is_lost_to_common_runs(spark, make_raw):
    """Every fourth character of texts over few characters differs: what they have in common is short and stands in many texts."""
    rng = random.Random(12)
    stock = [chr(0x4E00 + i) for i in range(12)]
    base = [[rng.choice(stock) for _ in range(320)] for _ in range(60)]
    texts = [t for b in base for t in (b, edited(rng, b, 4, lambda: rng.choice(stock)))]
    raw = make_raw([(i, f"h{i % 7}.test", f"<html><body><p>{''.join(t)}</p></body></html>") for i, t in enumerate(texts)])
    splits = [(i, "test" if i % 2 else "train", "m") for i in range(len(texts))]
    out = SplitOverlap(spark, raw, spark.createDataFrame(splits, STRESS), spark.createDataFrame([], FLAGS), 300, 0.7)
    got = {(r.eval_id, r.train_id) for r in out.pairs().collect()}
    want = {(i, j) for i in range(1, len(texts), 2) for j in range(0, len(texts), 2) if common_words(texts[i], texts[j]) >= 0.7 * 320}
    assert got == want and len(want) >= 60
