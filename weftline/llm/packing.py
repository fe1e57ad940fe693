"""Filling containers of fixed capacity with texts by sum-of-squares packing.

Each item goes where the sum of the squared counts of open containers for each residual gap becomes
smallest. Items are spread over packers by hash; each packs its stream with what is open in memory and
nothing else. The items of containers that are left loosely filled are packed again, in rounds of as many
packers as they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.tokens import VOCABULARY, filled, with_tokens
from weftline.session import Scratch

PER_PACKER = 50_000  # items a packer should get
FEWER = 0.8  # of a round's items, at most, may go on to the next
LOOSE = 0.02  # share of the capacity that may stay unused in a container that isn't packed again


class SumOfSquares:
    """Open containers by residual gap. Sizes are at least 1 and at most the capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The number of the container an item goes into. Ties go to the smallest gap, and to a new container last."""
        n, c = self.count, self.capacity
        best, gain = c, 2 * int(n[c - size]) + 1 if size < c else 0
        gaps = n[size:c]  # the gaps that may take it
        if gaps.any():
            after = n[: c - size].copy()
            after[0] = 0  # a full container counts for nothing
            change = 2 * (after - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            at = int(np.argmin(change))
            if change[at] <= gain:
                best = at + size
        if best == c:
            number = self.made
            self.made += 1
        else:
            number = self.open[best].pop()
            n[best] -= 1
        left = best - size
        if left:
            self.open[left].append(number)
            n[left] += 1
        return number

    def gaps(self) -> dict[int, int]:
        """Residual gap of each container that isn't full."""
        return {number: gap for gap, numbers in enumerate(self.open) for number in numbers}


def _packer(capacity: int, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = SumOfSquares(capacity)
        base = (round_ << 58) | (TaskContext.get().partitionId() << 36)
        for batch in batches:
            numbers = [base | pack.place(size) for size in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(2), pa.array(numbers, pa.int64())], names=["doc_id", "piece", "tokens", "bin_id"])

    return run


def token_items(documents: DataFrame, capacity: int, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tokens): what must be packed. Blank texts are no items; a text over the capacity becomes full pieces and a rest."""
    sizes = with_tokens(filled(documents).select("doc_id", "text"), path=path).where("n_tokens > 0")
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    each = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return each.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("tokens"))


def pack_items(spark: SparkSession, items: DataFrame, capacity: int, per_packer: int = PER_PACKER) -> DataFrame:
    """(doc_id, piece, tokens, bin_id) of `items` (doc_id, piece, tokens); no bin exceeds the capacity and no item is divided.

    Each round packs again what stands in containers that one of these items could still go into, in a new
    mixture, by as many packers as `per_packer` items each need; rounds end when one packer had them all, or when the
    loose items don't become fewer. An empty table gives an empty one. Repeated rows are items of their own.
    """
    keep = Scratch(spark, "packing")
    todo = keep.put(items.select("doc_id", "piece", "tokens"))
    left, round_, done = todo.count(), 0, []
    while True:
        packers = max(1, -(-left // per_packer))
        way = F.xxhash64(F.lit(round_), "doc_id", "piece")
        placed = todo.withColumn("way", F.pmod(way, F.lit(packers)).cast("int")).repartitionById(packers, "way").sortWithinPartitions(way).select("doc_id", "piece", "tokens")
        packed = keep.put(placed.mapInArrow(_packer(capacity, round_), "doc_id BIGINT, piece INT, tokens INT, bin_id BIGINT"))
        if packers == 1:
            break
        bins = packed.groupBy("bin_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"))
        loose = keep.put(bins.where(F.col("used") < (1 - LOOSE) * capacity))
        smallest = packed.join(loose, "bin_id", "left_semi").agg(F.min("tokens")).collect()[0][0]
        open_ = loose.where(capacity - F.col("used") >= F.lit(smallest if smallest is not None else capacity + 1))
        more = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
        if more == 0 or more > FEWER * left:
            break
        done.append(packed.join(open_, "bin_id", "left_anti").select(packed.columns))
        todo, left, round_ = packed.join(open_, "bin_id", "left_semi").select("doc_id", "piece", "tokens"), more, round_ + 1
    for part in done:
        packed = packed.unionAll(part)
    return packed


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers that any packing needs, and the share used."""
    bins = packed.groupBy("bin_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("used_share"),
    )
