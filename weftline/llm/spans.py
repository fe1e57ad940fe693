"""Long exact spans shared between documents, by collinear chaining of k-mer seeds.

Exact copies are collapsed first. Each different text gives seeds: the k-mers that are least by hash in
some window, with window and k so chosen that every stretch of the wanted length has one. Seeds found in
two texts or more pair those texts; a seed found many times leads to the stretches of the wanted length around it, and
the texts that have one in common are paired with the first of them, so a stretch in n texts makes n pairs. For each pair the seeds are chained in order
with gap costs through a Fenwick tree, until every seed is in a chain; chains are aligned, which gives
exact spans and fuzzy passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.hashing import mixed, sliding, window_hashes
from weftline.session import Scratch

SEED = 128  # characters of a seed, at most; a third below the wanted length for short ones
FEW = 32  # places of a seed up to which they are paired at once
GAP_COST = 0.05  # of a character in a gap between chained seeds
GAP_MOST = 400  # characters in a gap beyond which a chain ends


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def character_hashes(text: str, k: int) -> np.ndarray:
    """Hash of each k-mer of a text."""
    return window_hashes(codes(text), k)


def seeds_of(text: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (signed) and positions of a text's seeds: k-mers least in some window of least - k + 1 of them."""
    k = seed_length(least)
    w = least - k + 1
    hashes = character_hashes(text, k)
    if len(hashes) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = sliding(hashes, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, w, np.maximum) == hashes)
    return hashes[at].view(np.int64), at


def seed_length(least: int) -> int:
    return max(1, min(SEED, 2 * least // 3))


class Fenwick:
    """Prefix maxima of (score, index) over ranks."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank] = value
            rank += rank & -rank

    def most(self, rank: int) -> tuple[float, int]:
        """The greatest value of ranks below `rank`."""
        out = (-1e18, -1)
        while rank > 0:
            out = max(out, self.best[rank])
            rank -= rank & -rank
        return out


def chain_seeds(pairs: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Chains of seed matches (position in a, position in b), best first, until each match is in one.

    A chain ascends in both texts. Its score is the characters its seeds newly cover in a less GAP_COST for
    each character of the gaps in both; a gap above GAP_MOST isn't bridged.
    """
    rest = sorted(set(pairs))
    out = []
    while rest:
        ranks = {b: i for i, b in enumerate(sorted({b for _, b in rest}))}
        tree = Fenwick(len(ranks))
        score, before = [0.0] * len(rest), [-1] * len(rest)
        held: list[int] = []
        for i, (a, b) in enumerate(rest):
            while held and rest[held[0]][0] < a:  # matches at one position of a don't follow each other
                j = held.pop(0)
                tree.put(ranks[rest[j][1]], (score[j] + GAP_COST * (rest[j][0] + rest[j][1]), j))
            value, j = tree.most(ranks[b])
            score[i] = float(k)
            if j >= 0:
                da, db = a - rest[j][0], b - rest[j][1]
                linked = value - GAP_COST * (a + b) + min(k, da, db)
                if max(da, db) <= GAP_MOST + k and linked > score[i]:
                    score[i], before[i] = linked, j
            held.append(i)
        i = max(range(len(rest)), key=score.__getitem__)
        chain = []
        while i >= 0:
            chain.append(rest[i])
            i = before[i]
        out.append(chain[::-1])
        used = set(chain)
        rest = [m for m in rest if m not in used]
    return out


def align_chain(a: str, b: str, chain: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int, int]], tuple[int, int, int, int, int]]:
    """Maximal exact spans (start in a, start in b, length) through a chain's seeds, and the passage (a from, a to, b from, b to, equal characters).

    A seed whose characters differ, a collision of hashes, gives no span.
    """
    spans: list[tuple[int, int, int]] = []
    for pa_, pb in chain:
        if spans and pa_ - pb == spans[-1][0] - spans[-1][1] and pa_ < spans[-1][0] + spans[-1][2]:
            continue
        if a[pa_ : pa_ + k] != b[pb : pb + k]:
            continue
        left = _common(a[max(0, pa_ - min(pa_, pb)) : pa_][::-1], b[max(0, pb - min(pa_, pb)) : pb][::-1])
        right = _common(a[pa_ + k :], b[pb + k :])
        spans.append((pa_ - left, pb - left, left + k + right))
    if not spans:
        return [], (0, 0, 0, 0, 0)
    equal = end = 0
    for start, _, size in spans:
        equal += max(0, start + size - max(end, start))
        end = max(end, start + size)
    return spans, (min(s[0] for s in spans), max(s[0] + s[2] for s in spans), min(s[1] for s in spans), max(s[1] + s[2] for s in spans), equal)


def _common(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


_SEED_ARROW = pa.schema([("rep", pa.int64()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_SPAN_DDL = "a BIGINT, b BIGINT, kind STRING, a_from INT, a_to INT, b_from INT, b_to INT, equal INT"
_SPAN_NAMES = ["a", "b", "kind", "a_from", "a_to", "b_from", "b_to", "equal"]


def _seed_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            seeds, places = [], []
            for t in texts:
                h, at = seeds_of(t.as_py(), least)
                seeds.append(h)
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], schema=_SEED_ARROW)

    return run


def _stretch_batches(least: int):
    """(rep, text, places of hot seeds) to (rep, stretch hash, a second hash, its start): every stretch of `least` characters around a hot seed, once."""
    k = seed_length(least)
    names = ["rep", "seed", "check", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text, hot in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes = character_hashes(text, least).view(np.int64)
                inside = np.zeros(len(hashes) + 1, np.int64)
                for p in hot:
                    inside[max(0, p + k - least)] += 1
                    inside[min(p + 1, len(hashes))] -= 1
                at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                found, first = np.unique(hashes[at], return_index=True)
                second = window_hashes(mixed(codes(text)), least).view(np.int64)[at[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rep), pa.int64()), pa.array(found, pa.int64()), pa.array(second, pa.int64()), pa.array(at[first], pa.int32())], names=names)

    return run


def _align_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                a, b, hits, ta, tb = (batch.column(c)[i].as_py() for c in range(5))
                for chain in chain_seeds([(h["x"], h["y"]) for h in hits], k):
                    spans, (a0, a1, b0, b1, equal) = align_chain(ta, tb, chain, k)
                    out += [(a, b, "exact", x, x + n, y, y + n, n) for x, y, n in spans]
                    if spans:
                        out.append((a, b, "passage", a0, a1, b0, b1, equal))
            types = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 5]
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_SPAN_NAMES)

    return run


class SharedSpans:
    """Shared stretches of at least `least` characters in `documents` (doc_id, text).

    members: (rep, doc_id, size), the documents of each different text of at least that length; null and
    shorter texts have none. spans: (a, b, kind, a_from, a_to, b_from, b_to, equal) for pairs of different
    texts, a < b by their least doc_id, kind exact or passage; exact spans shorter than `least` are left out. A
    stretch that stands in many texts is given for each of them and the first. classes: (class, rep), the texts
    that have such a stretch in common.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, least: int) -> None:
        keep = Scratch(spark, "spans")
        k = seed_length(least)
        texts = documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select("doc_id", "text")
        marked = keep.put(texts.select("doc_id", F.md5("text").alias("mark"), F.length("text").alias("size")))
        reps = marked.groupBy("mark").agg(F.min("doc_id").alias("rep"))
        self.members = keep.put(marked.join(reps, "mark").select("rep", "doc_id", "size").distinct())
        unique = keep.put(texts.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).selectExpr("doc_id AS rep", "text"))
        found = unique.mapInArrow(_seed_batches(least), "rep BIGINT, seeds ARRAY<BIGINT>, places ARRAY<INT>")
        each = keep.put(found.select("rep", F.explode(F.arrays_zip("seeds", "places")).alias("s")).selectExpr("rep", "s.seeds AS seed", "s.places AS place"))
        count = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("seed", "n")
        shared = keep.put(each.join(count, "seed"))
        few = shared.where(F.col("n") <= FEW).select("seed", "rep", "place")
        hot = shared.where(F.col("n") > FEW).groupBy("rep").agg(F.collect_set("place").alias("places")).join(unique, "rep").select("rep", "text", "places")
        # Texts with one hot stretch are a class; each is aligned with the class's representative, not with all others.
        stretches = keep.put(hot.mapInArrow(_stretch_batches(least), "rep BIGINT, seed BIGINT, check BIGINT, place INT"))
        member = lambda seed: F.xxhash64(F.lit(seed), "rep")
        classes = stretches.groupBy("seed", "check").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "place")).alias("first"), F.bit_xor(member("one")).alias("one"), F.bit_xor(member("two")).alias("two")
        )
        classes = keep.put(classes.where("n > 1"))
        starred = stretches.join(classes.select("seed", "check", "first"), ["seed", "check"]).where("rep <> first.rep")
        # Of the stretches that follow each other in both texts one is enough; two spans apart never share a cell.
        cells = starred.groupBy(F.col("first.rep").alias("a"), F.col("rep").alias("b"), F.expr("first.place - place"), F.expr(f"first.place div {least}")).agg(F.min(F.struct(F.col("first.place").alias("x"), F.col("place").alias("y"))).alias("hit"))
        left, right = few.selectExpr("seed", "rep AS a", "place AS x"), few.selectExpr("seed", "rep AS b", "place AS y")
        met = left.join(right, "seed").where("a < b").select("a", "b", F.struct("x", "y").alias("hit")).unionAll(cells.select("a", "b", "hit"))
        hits = met.groupBy("a", "b").agg(F.collect_set("hit").alias("hits"))
        pairs = hits.join(unique.selectExpr("rep AS a", "text AS ta"), "a").join(unique.selectExpr("rep AS b", "text AS tb"), "b")
        aligned = pairs.select("a", "b", "hits", "ta", "tb").mapInArrow(_align_batches(k), _SPAN_DDL).distinct()
        self.spans = keep.put(aligned.where((F.col("kind") == "passage") | (F.col("equal") >= least)))
        # Classes of the same members are one: a long stretch has many of them.
        sets = classes.groupBy("one", "two", "n").agg(F.min(F.struct("seed", "check")).alias("at")).select("at.seed", "at.check", F.monotonically_increasing_id().alias("class"))
        self.classes = keep.put(stretches.join(sets, ["seed", "check"]).select("class", "rep"))

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), smaller first: all documents that share a stretch, copies among them. Classes are expanded only here."""
        side = lambda name: self.classes.select("class", F.col("rep").alias(name))
        linked = self.spans.where("kind = 'exact'").select("a", "b").unionAll(side("a").join(side("b"), "class").where("a < b").select("a", "b")).distinct()
        one, two = self.members.selectExpr("rep AS a", "doc_id AS p"), self.members.selectExpr("rep AS b", "doc_id AS q")
        across = linked.join(one, "a").join(two, "b").select("p", "q")
        within = one.join(two, F.col("a") == F.col("b")).where("p < q").select("p", "q")
        return across.unionAll(within).select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"))

    def coverage(self) -> DataFrame:
        """(doc_id, size, shared, share): how many characters of each document stand in another; all of a text that has copies."""
        exact = self.spans.where("kind = 'exact'")
        sides = exact.selectExpr("a AS rep", "a_from AS lo", "a_to AS hi").unionAll(exact.selectExpr("b AS rep", "b_from AS lo", "b_to AS hi")).distinct()
        reached = F.coalesce(F.max("hi").over(W.partitionBy("rep").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        union = sides.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", reached))).groupBy("rep").agg(F.sum("new").cast("int").alias("covered"))
        copies = self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
        out = self.members.join(copies, "rep").join(union, "rep", "left")
        shared = F.when(F.col("copies") > 1, F.col("size")).otherwise(F.coalesce("covered", F.lit(0)))
        return out.select("doc_id", "size", shared.cast("int").alias("shared")).withColumn("share", F.round(F.col("shared") / F.col("size"), 6))
