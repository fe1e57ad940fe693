"""The main body of a page, without what its site puts around it.

Parser events give the lines of a page (`functions.markup`). Each line has a text-to-tag ratio: its characters
outside links for each tag, less what the corpus shows to be repeated (`llm.pages`). The ratios are smoothed with a
Gaussian along the page; a line's own ratio and the smoothed one together are clustered in two by a
threshold, and the lines above it, the content regions, are the body.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.pages import CELLS, ITEMS, Page, line_weights, page_lines, page_of, weight, with_marks
from weftline.session import Scratch

SIGMA = 1.5  # lines, of the Gaussian
OWN = 0.6  # part of a line's own ratio beside the smoothed one
REST = 0.3  # zeros put beside the values, for each line: a page without boilerplate is clustered against them
LOW = 0.3  # part of the threshold's ratio from which lines belong to a region: lists and captions beside paragraphs do
_HALF = 4
_KERNEL = [math.exp(-(i**2) / (2 * SIGMA**2)) for i in range(-_HALF, _HALF + 1)]
_KERNEL = np.array([k / sum(_KERNEL) for k in _KERNEL])
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]」』]*$")


def split_point(values: list[float]) -> float:
    """The threshold between two clusters of ratios: the least squares in one dimension, on logarithms, as ratios are skewed."""
    logs = sorted([math.log1p(v) for v in values] + [0.0] * max(1, int(REST * len(values))))
    n, total = len(logs), sum(logs)
    best, edge, left = -1.0, logs[0], 0.0
    for i in range(1, n):
        left += logs[i - 1]
        between = left * left / i + (total - left) ** 2 / (n - i)  # greatest where the squares within are least
        if between > best:
            best, edge = between, (logs[i - 1] + logs[i]) / 2
    return math.expm1(edge)


def text_to_tag(page: Page, weights: list[float]) -> list[float]:
    """Characters for each tag of each line. Cells and items that follow each other are one text and share its characters.

    Characters in links don't count, but for sentences: titles of other pages have no full stop.
    """
    own = []
    for text, linked, share in zip(page.texts, page.linked, weights):
        size = weight(text)
        if linked and not (2 * linked >= len(text) and _SENTENCE_END.search(text)):
            size = max(0, size - linked)
        own.append(size * share)
    out = [0.0] * len(own)
    start = 0
    while start < len(own):
        end = start + 1
        block = page.blocks[start]
        if block in ITEMS:
            kinds = CELLS if block in CELLS else (block,)
            while end < len(own) and page.blocks[end] in kinds:
                end += 1
        if end == start + 1:  # a line by itself
            if own[start]:
                out[start] = own[start] / (1 + page.tags[start])
            start = end
            continue
        whole, tags = sum(own[start:end]), sum(page.tags[start:end]) / (end - start)
        for i in range(start, end):
            if own[i]:
                out[i] = whole / (1 + min(tags, page.tags[i]))
        start = end
    return out


def region_values(page: Page, weights: list[float]) -> list[float]:
    """What is clustered: the weight of a line times its own and the smoothed ratio."""
    ratio = text_to_tag(page, weights)
    if not any(ratio):
        return [0.0] * len(ratio)
    smooth = np.convolve([ratio[0]] * _HALF + ratio + [ratio[-1]] * _HALF, _KERNEL, mode="valid").tolist()
    return [w * s ** (1 - OWN) * r**OWN if r else 0.0 for w, s, r in zip(weights, smooth, ratio)]


def body_flags(page: Page, weights: list[float] | None = None) -> list[bool]:
    """For each line of a page, whether it is body. A page without a line that counts in full has no body."""
    weights = line_weights(page) if weights is None else weights
    values = region_values(page, weights)
    if not any(v for v, w in zip(values, weights) if w == 1.0):
        return [False] * len(values)
    edge = max(LOW * split_point(values), 1e-9)
    return [v >= edge for v in values]


def _judged(columns: dict[str, pa.DataType], rows):
    """Batches of `with_marks` to the rows that `rows(raw_id, page, flags)` makes of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[tuple] = []
                for raw_id, *record in zip(*(part.column(i).to_pylist() for i in range(6))):
                    page = page_of(*record)
                    out += rows(raw_id, page, body_flags(page))
                values = list(zip(*out)) if out else [[]] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns))

    return run


def _marked(spark: SparkSession, raw: DataFrame) -> DataFrame:
    return with_marks(Scratch(spark, "bodies").put(page_lines(raw).where("html")))


def page_bodies(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """(raw_id, place, line, body) of each line of each HTML payload.

    Blank payloads, payloads without tags, and rows without raw_id have no rows. A page that is delivered twice
    is judged twice, alike. Pages with neither hostname nor href are judged together as one site.
    """
    columns = {"raw_id": pa.int64(), "place": pa.int32(), "line": pa.string(), "body": pa.bool_()}
    rows = lambda raw_id, page, flags: [(raw_id, i, t, b) for i, (t, b) in enumerate(zip(page.texts, flags))]
    return _marked(spark, raw).mapInArrow(_judged(columns, rows), "raw_id BIGINT, place INT, line STRING, body BOOLEAN")


def outside_body(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """(raw_id, line): each distinct line of a page that isn't body; a text that is also a body line of the page is left out."""

    def rows(raw_id: int, page: Page, flags: list[bool]) -> list[tuple]:
        body = {t for t, b in zip(page.texts, flags) if b}
        return [(raw_id, t) for t in dict.fromkeys(t for t, b in zip(page.texts, flags) if not b) if t not in body]

    return _marked(spark, raw).mapInArrow(_judged({"raw_id": pa.int64(), "line": pa.string()}, rows), "raw_id BIGINT, line STRING")


def body_texts(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """(raw_id, body): the body of each HTML page, its lines joined by line feeds, empty where no line is body."""
    rows = lambda raw_id, page, flags: [(raw_id, "\n".join(t for t, b in zip(page.texts, flags) if b))]
    return _marked(spark, raw).mapInArrow(_judged({"raw_id": pa.int64(), "body": pa.string()}, rows), "raw_id BIGINT, body STRING")
