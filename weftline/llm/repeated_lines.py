"""Lines repeated across one site's pages, by compressed bitmaps.

Each site's distinct payloads are numbered. For each line of a site, the numbers of its pages are kept
as a compressed bitmap: containers of 32,768 numbers, each a sorted list of 16-bit places or, where that
is shorter, 4,096 bytes of bits. Bitmaps of variants of a line are united; exact cardinalities decide;
pages lose a line where its bitmap has their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from weftline.llm.pages import line_texts, page_lines
from weftline.session import Scratch

SPAN = 32_768  # numbers in a container
SPARSE = 2_048  # up to so many places a container is a list
NUMBERERS = 64  # tasks that number a site's payloads side by side


def pack(places: np.ndarray) -> bytes:
    """A container of distinct places below SPAN: places as two bytes each, or bits."""
    places = np.unique(np.asarray(places, np.int64))
    if len(places) <= SPARSE - 1:
        return places.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The places in a container; 4,096 bytes are always bits, as a list that long is never made."""
    if len(data) == SPAN // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, "<u2").astype(np.int64)


def unite(containers: list[bytes]) -> bytes:
    """The union of containers of the same range."""
    if len(containers) == 1:
        return containers[0]
    bits = np.zeros(SPAN, np.uint8)
    for data in containers:
        bits[unpack(data)] = 1
    return pack(np.flatnonzero(bits))


def cardinality(data: bytes) -> int:
    if len(data) == SPAN // 8:
        return int(np.unpackbits(np.frombuffer(data, np.uint8)).sum())
    return len(data) // 2


def contains(data: bytes, place: int) -> bool:
    if len(data) == SPAN // 8:
        return bool(data[place >> 3] >> (place & 7) & 1)
    places = np.frombuffer(data, "<u2")
    at = int(np.searchsorted(places, place))
    return at < len(places) and int(places[at]) == place


@F.pandas_udf(T.BinaryType())
def _pack(places: pd.Series) -> pd.Series:
    return places.map(pack)


@F.pandas_udf(T.BinaryType())
def _unite(containers: pd.Series) -> pd.Series:
    return containers.map(lambda parts: unite(list(parts)))


@F.pandas_udf(T.IntegerType())
def _cardinality(data: pd.Series) -> pd.Series:
    return data.map(cardinality)


def numbered_pages(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """(page_id, site, payload, number, lines) of the HTML pages; rows with one payload of a site share a number."""
    keep = Scratch(spark, "numbered")
    pages = keep.put(page_lines(raw).where("html AND site IS NOT NULL").select("page_id", "site", "payload", F.array_distinct(line_texts()).alias("lines")))
    lane = F.pmod(F.col("payload"), F.lit(NUMBERERS))
    order = F.row_number().over(W.partitionBy("site", "lane").orderBy("payload"))
    numbers = pages.select("site", "payload").distinct().withColumn("lane", lane).select("site", "payload", ((order - 1) * NUMBERERS + F.col("lane")).alias("number"))
    return keep.put(pages.join(numbers, ["site", "payload"]))


class RepeatedLines:
    """Lines whose variants stand on at least `least` and `share` of their site's distinct payloads, by exact cardinality.

    pages is what `numbered_pages` gives; a variant is that of `variant(line)`, the line itself by default. containers:
    (site, variant, key, bucket, bits, size) of every line, key its hash, written once. found: (site, variant, key, pages, total).
    Lines without a page, and sites without a line, are in neither.
    """

    def __init__(self, spark: SparkSession, pages: DataFrame, least: int, share: float, variant: Callable[[Column], Column] | None = None, span: int = SPAN) -> None:
        keep = Scratch(spark, "bitmaps")
        self.pages, self.span = pages, span
        each = pages.dropDuplicates(["site", "payload"]).select("site", "number", F.explode("lines").alias("line"))
        form = variant(F.col("line")) if variant else F.col("line")
        postings = each.select(
            "site", F.xxhash64(form).alias("variant"), F.xxhash64("line").alias("key"),
            F.floor(F.col("number") / span).cast("int").alias("bucket"), F.pmod("number", F.lit(span)).cast("int").alias("place"),
        )
        lists = postings.groupBy("site", "variant", "key", "bucket").agg(F.collect_list("place").alias("places"))
        self.containers = keep.put(lists.select("site", "variant", "key", "bucket", _pack("places").alias("bits"), F.size("places").alias("size")))
        # A sum of cardinalities is never below that of the union: only variants with enough pages are united.
        enough = self.containers.groupBy("site", "variant").agg(F.sum("size").alias("sum")).where(F.col("sum") >= least).select("site", "variant")
        maps = self.containers.join(enough, ["site", "variant"], "left_semi")
        united = maps.groupBy("site", "variant", "bucket").agg(F.collect_list("bits").alias("parts")).select("site", "variant", _cardinality(_unite("parts")).alias("count"))
        counts = united.groupBy("site", "variant").agg(F.sum("count").alias("pages"))
        totals = pages.groupBy("site").agg(F.countDistinct("payload").alias("total"))
        over = counts.join(totals, "site").where((F.col("pages") >= least) & (F.col("pages") >= share * F.col("total")))
        self.found = keep.put(self.containers.select("site", "variant", "key").join(over, ["site", "variant"]).distinct())

    def texts(self) -> DataFrame:
        """(site, line, pages, total) of the lines found."""
        by_site = self.found.groupBy("site").agg(F.collect_set("key").alias("keys"))  # bounded: such a line has a share of the site's lines
        hit = F.filter("lines", lambda x: F.array_contains(F.col("keys"), F.xxhash64(x)))
        return self.pages.join(by_site, "site").select("site", F.explode(hit).alias("line")).distinct().withColumn("key", F.xxhash64("line")).join(self.found, ["site", "key"]).select("site", "line", "pages", "total")

    def stripped(self) -> DataFrame:
        """(raw_id, site, text, removed): each page's distinct lines without those whose bitmap has the page's number.

        A container and the pages of its range meet in one task, bitmaps first; no page carries bitmaps, and a site
        of many pages has many ranges.
        """
        maps = self.containers.join(self.found.select("site", "key"), ["site", "key"], "left_semi")
        none = lambda kind: F.lit(None).cast(kind)
        maps = maps.select("site", "bucket", F.lit(False).alias("page"), "key", "bits", none("bigint").alias("page_id"), none("bigint").alias("number"), none("array<string>").alias("lines"), none("array<bigint>").alias("keys"))
        rows = self.pages.select(
            "site", F.floor(F.col("number") / self.span).cast("int").alias("bucket"), F.lit(True).alias("page"), none("bigint").alias("key"), none("binary").alias("bits"),
            "page_id", "number", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("keys"),
        )
        met = maps.unionAll(rows).repartition("site", "bucket").sortWithinPartitions("site", "bucket", "page")
        return met.mapInArrow(_strip(self.span), "raw_id BIGINT, site STRING, text STRING, removed INT")


def _strip(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, maps = None, {}
        for batch in batches:
            out = []
            for site, bucket, page, key, bits, page_id, number, lines, keys in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (site, bucket) != at:
                    at, maps = (site, bucket), {}
                if not page:
                    maps[key] = bits
                    continue
                place = number % span
                kept = [t for t, k in zip(lines, keys) if k not in maps or not contains(maps[k], place)]
                out.append((page_id, site, "\n".join(kept), len(lines) - len(kept)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.int32()))],
                names=["raw_id", "site", "text", "removed"],
            )

    return run
