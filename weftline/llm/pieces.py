"""Splitting oversized items at natural boundaries.

An item is a text longer than a limit. Its boundaries (paragraphs, line ends, sentence ends, clause
marks, blanks) each have a penalty; dynamic programming over their positions picks the cuts that
minimise penalties and the imbalance of sizes, so that every piece, with the overlap it takes from the
piece before, stays within the limit. Only oversized items leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of boundary, with the penalty of a cut behind each.
BOUNDARIES = (
    (re.compile(r"\n\s*\n\s*"), 0.0),
    (re.compile(r"\s*\n\s*"), 0.5),
    (re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』”’）]*\s*"), 1.0),
    (re.compile(r"[,;:，、；：]\s+|[、，；：]|\s[–—-]\s"), 3.0),
    (re.compile(r"\s+"), 5.0),
)
FORCED = 50.0  # penalty of a cut that no boundary allows
BALANCE = 4.0  # weight of a piece's squared deviation from even sizes
_STRETCH = re.compile(r"[^\s。！？]+")
_EDGES = r"(?U)^\s+|\s+$"


def has_forced(text: str, limit: int) -> bool:
    """Whether some stretch longer than the limit has no white space and no sentence end inside."""
    return any(m.end() - m.start() > limit for m in _STRETCH.finditer(text))


def boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, and their penalties. Where natural ones are further apart than `room`, forced ones stand between."""
    best: dict[int, float] = {}
    for pattern, penalty in BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                best.setdefault(m.end(), penalty)
    at = sorted(best)
    step = max(1, room // 8)
    for left, right in zip([0, *at], [*at, len(text)]):
        if right - left > room:
            for p in range(left + step, right, step):
                best.setdefault(p, FORCED)
    at = sorted(best)
    return np.array([0, *at, len(text)], np.int64), np.array([0.0, *(best[p] for p in at), 0.0])


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where the pieces of a text end: the cheapest way to cut it. A text within the limit is one piece.

    The first piece may have `limit` characters, every other `limit - overlap` of its own. Among equally
    cheap ways the one with the earlier cut is taken.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    size = len(text)
    if size <= limit:
        return [size]
    room = limit - overlap
    at, penalty = boundaries(text, room)
    count = 1 + -(-(size - limit) // room)
    even = max(1.0, (size - overlap) / count)
    cost = np.full(len(at), np.inf)
    back = np.zeros(len(at), np.int64)
    cost[0] = 0.0
    low = 0
    for i in range(1, len(at)):
        while at[i] - at[low] > limit:
            low += 1
        own = at[i] - at[low:i]
        allowed = np.where(np.arange(low, i) == 0, limit, room)
        total = cost[low:i] + penalty[i] + BALANCE * ((own - even) / even) ** 2 + 1.0
        total[own > allowed] = np.inf
        best = int(np.argmin(total)) if i > low else 0
        if i > low and np.isfinite(total[best]):
            cost[i], back[i] = total[best], low + best
    ends, i = [], len(at) - 1
    while i > 0:
        ends.append(int(at[i]))
        i = int(back[i])
    return ends[::-1]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; each but the first starts `overlap` characters before the end of the one before."""
    ends = cut_points(text, limit, overlap)
    return [(max(0, start - overlap) if i else 0, end) for i, (start, end) in enumerate(zip([0, *ends], ends))]


_ARROW = pa.schema([("item_kind", pa.string()), ("item_id", pa.int64()), ("cut_kind", pa.string()), ("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
_DDL = "item_kind STRING, item_id BIGINT, cut_kind STRING, piece INT, start INT, end INT, text STRING"


def split_oversized(items: DataFrame, overlap: int) -> DataFrame:
    """(item_kind, item_id, cut_kind, piece, start, end, text) of `items` (item_kind, item_id, text, room INT).

    All items are longer than their room. cut_kind is `forced` if some stretch longer than the room has
    neither white space nor a sentence end inside, else `natural`. start and end count code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(lo, 256).to_pylist():
                    text, limit = row["text"], row["room"]
                    kind = "forced" if has_forced(text, limit) else "natural"
                    for i, (a, b) in enumerate(pieces(text, limit, min(overlap, limit - 1))):
                        out.append({"item_kind": row["item_kind"], "item_id": row["item_id"], "cut_kind": kind, "piece": i, "start": a, "end": b, "text": text[a:b]})
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return items.select("item_kind", "item_id", "text", "room").mapInArrow(run, _DDL)


def oversized_blocks(blocks: DataFrame, limit: int) -> DataFrame:
    """Blocks whose trimmed text is over the limit. Null texts are none; a block stored twice counts twice."""
    text = F.regexp_replace("text", _EDGES, "")
    return blocks.where(F.length("text") > limit).select(F.lit("block").alias("item_kind"), F.col("block_uid").alias("item_id"), text.alias("text"), F.lit(limit).alias("room")).where(F.length("text") > limit)


def oversized_results(results: DataFrame, limit: int) -> DataFrame:
    """Results whose block texts together are over the limit: trimmed, blank ones left out, in block order, joined by two line feeds.

    Ties in block_order fall to block_id; a null order comes last, null arrays and texts count as empty.
    """
    upper = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0)) + 2)
    ordered = F.array_sort(F.transform("blocks", lambda b: F.struct(F.coalesce(b["block_order"], F.lit(2**31 - 1)).alias("o"), b["block_id"].alias("i"), F.coalesce(F.regexp_replace(b["text"], _EDGES, ""), F.lit("")).alias("t"))))
    text = F.array_join(F.filter(F.transform(ordered, lambda b: b["t"]), lambda t: t != ""), "\n\n")
    return (
        results.where(upper > limit)
        .select(F.lit("result").alias("item_kind"), F.col("result_id").alias("item_id"), text.alias("text"), F.lit(limit).alias("room"))
        .where(F.length("text") > limit)
    )


def split_all(blocks: DataFrame, results: DataFrame, block_limit: int, result_limit: int, overlap: int) -> DataFrame:
    """The pieces of all oversized blocks and results."""
    return split_oversized(oversized_blocks(blocks, block_limit).unionAll(oversized_results(results, result_limit)), overlap)
