"""Pages as tables of lines, and what the corpus says about each line.

`page_lines` reads each payload once. `repetition` counts under how many different headlines of its site, and
of all sites, a line form stands: what stands on pages whatever they are about comes out as repeated, without a
list of phrases. A line's *form* is its text with digits and the site's own name masked; its *lead* is the last
word before the first colon or separator, which links to other pages, breadcrumbs and visitors' remarks share
though the rest of them differs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.markup import Line, payload_lines
from weftline.functions.names import site
from weftline.session import hash_joins, small_batches, spread

PAGE_SCHEMA = (
    "page_id BIGINT, site STRING, payload BIGINT, html BOOLEAN, title STRING, notice STRING, head BIGINT, bare BOOLEAN,"
    " lines STRING, plain STRING, meta ARRAY<BIGINT>, keys ARRAY<BIGINT>, leads ARRAY<BIGINT>, headed ARRAY<BIGINT>"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("site", pa.string()), ("payload", pa.int64()), ("html", pa.bool_()), ("title", pa.string()), ("notice", pa.string()), ("head", pa.int64()), ("bare", pa.bool_()),
        ("lines", pa.string()), ("plain", pa.string()), ("meta", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("leads", pa.list_(pa.int64())), ("headed", pa.list_(pa.int64())),
    ]
)

_DIGITS = re.compile(r"\d+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LEAD_END = re.compile(r"[:：]|\s[›»>|·•/]\s")
LEAD_MOST = 64  # characters in which a lead ends
PROSE_LINE = 60  # weighted characters of a line that counts as prose
PROSE_PAGE = 200  # of such lines on a page that isn't bare
HEADLINES, CELLS, ITEMS = ("h1", "h2"), ("td", "th"), ("td", "th", "li")
# Blocks that a line's record tells apart; all others are one kind.
BLOCKS = ("", "h1", "h2", "td", "th", "li")
_BLOCK = {name: i for i, name in enumerate(BLOCKS)}


def weight(text: str) -> int:
    """Length of a text; a character of a script without blanks counts for two and a half."""
    return len(text) + (0 if text.isascii() else int(1.5 * len(_WIDE.findall(text))))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def key_of(text: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(text))


def form_key(text: str) -> int:
    """The key of a form; its last four bits are free for a verdict."""
    return key_of(text) & ~15


class Masker:
    """Forms of lines: digits and the words of the site's name are masked."""

    def __init__(self) -> None:
        self._names: dict[str, tuple[list[str], re.Pattern | None]] = {}

    def form(self, text: str, host: str | None, block: str = "p") -> str:
        """The form of a line; table cells share units and labels, so only their exact text counts."""
        if block in CELLS:
            return text
        text = _DIGITS.sub("#", text)
        known = self._names.get(host or "")
        if known is None:
            words = sorted((w for label in (host or "").split(".")[:-1] for w in label.split("-") if len(w) > 3), key=len, reverse=True)
            if len(self._names) > 10_000:
                self._names.clear()
            known = self._names[host or ""] = (words, re.compile("|".join(map(re.escape, words)), re.I) if words else None)
        words, name = known
        if name:
            low = text.lower()
            if any(w in low for w in words):
                return name.sub("@", text)
        return text


def lead_of(text: str) -> str | None:
    """The last word before the first colon or spaced separator of a line, with that mark; None where it has none near its start."""
    m = _LEAD_END.search(text, 0, LEAD_MOST)
    if m is None:
        return None
    words = text[: m.start()].split()
    return _DIGITS.sub("#", words[-1].casefold()) + m.group().strip() if words else None


def packed(line: Line) -> int:
    """What a line's markup says, in one number: block, sample code, tags and linked characters."""
    return _BLOCK.get(line.block, 0) | line.code << 3 | min(line.tags, 0xFFFFFF) << 4 | line.linked << 28


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masker = Masker()
    known: dict[tuple, tuple[int, int]] = {}  # keys of lines met before, up to a bound

    def keys_of(line: Line, host: str | None) -> tuple[int, int]:
        at = (line.text, host, line.block in CELLS)
        found = known.get(at)
        if found is None:
            lead = lead_of(line.text)
            found = form_key(masker.form(line.text, host, line.block)), 0 if lead is None else form_key(lead)
            if len(line.text) < 100:
                if len(known) > 100_000:
                    known.clear()
                known[at] = found
        return found

    for batch in batches:
        ids, hosts, payloads = (batch.column(k) for k in range(3))
        for lo in range(0, batch.num_rows, 256):
            rows: list[list] = [[] for _ in _ARROW]
            for page, host, payload in zip(ids[lo : lo + 256].to_pylist(), hosts[lo : lo + 256].to_pylist(), payloads[lo : lo + 256].to_pylist()):
                title, lines, notice, html = payload_lines(payload)
                headline = next((x.text for x in lines if x.block == "h1"), "") or title or (lines[0].text if lines else "")
                prose = sum(w for x in lines if not x.code and 2 * x.linked < len(x.text) and (w := weight(x.text)) >= PROSE_LINE)
                keys = [keys_of(x, host) for x in lines]
                leads = [0 if x.code else k for x, (_, k) in zip(lines, keys)]
                for column, value in zip(
                    rows,
                    (
                        page, host, key_of(payload), html, title, notice, key_of(headline), prose < PROSE_PAGE, "\n".join(x.text for x in lines),
                        "\n".join(x.plain or "" for x in lines) if any(x.plain is not None for x in lines) else None, [packed(x) for x in lines],
                        [k for k, _ in keys], leads, [k for k, x in zip(leads, lines) if k and x.block in HEADLINES],
                    ),
                ):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)


def page_lines(raw: DataFrame) -> DataFrame:
    """One row a raw row with a payload that isn't blank: its site, title and lines in order.

    page_id is raw_id. head is the hash of the headline (first h1, else the title, else the first line); bare tells
    a page without prose. lines holds the lines with line feeds between, meta, keys and leads a number for each.
    A page that shows nothing has no lines. Null and blank payloads, and rows without raw_id, have no row.
    """
    small_batches(raw.sparkSession)
    hash_joins(raw.sparkSession)
    pages = raw.where(F.col("raw_id").isNotNull() & F.col("html_content").rlike(r"(?U)\S")).select("raw_id", site(F.col("hostname"), F.col("href")).alias("site"), "html_content")
    return spread(pages).mapInArrow(read_pages, PAGE_SCHEMA)


def line_texts() -> Column:
    """The lines of a page as an array; a page that shows nothing has an empty one."""
    return F.when(F.size("meta") > 0, F.split("lines", "\n")).otherwise(F.array().cast("array<string>"))


SITE_SHARE = 0.03  # of a site's headlines under which a repeated form stands, or
CORPUS_SHARE = 0.001  # of all headlines (3 at least)
BARE, OFTEN, HALF = 2, 4, 8  # bits of a verdict: mostly on pages without prose; a share of the site's headlines of .15 and more, of .3 and more


def repetition(pages: DataFrame) -> DataFrame:
    """(page_id, marks ARRAY<BIGINT>): the keys of a page's repeated forms, each with a verdict in its last four bits, and of its repeated leads.

    Versions of one page share their headline, so they don't make each other's text look repeated, nor do copies
    on other sites. A form is repeated that stands under two headlines or more which are SITE_SHARE of its
    site's, or under CORPUS_SHARE of all. A lead is repeated that stands under CORPUS_SHARE of all headlines,
    seldom leads headings and isn't mostly found on pages without prose. All counts are exact. Forms meet their
    verdicts line by line, so a site with a third of all pages is no unit of work; pages without a mark have no row.
    """
    html = pages.where("html")
    seen = html.select("site", "head", "bare", F.explode(F.array_distinct("keys")).alias("key"))
    by_head = seen.groupBy("site", "key", "head").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("bare").cast("int")).alias("bare"))
    by_site = by_head.groupBy("site", "key").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    overall = (
        by_head.groupBy("key", "head")
        .agg(F.sum("rows").alias("rows"), F.sum("bare").alias("bare"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("all"), (F.sum("bare") / F.sum("rows")).alias("bare"))
        .where("all > 1")
    )
    heads = html.select("site", "head").distinct()
    by_host = heads.groupBy("site").agg(F.count(F.lit(1)).alias("heads"))
    least = max(3.0, CORPUS_SHARE * heads.select("head").distinct().count())
    share = F.col("pages") / F.col("heads")
    wide = F.col("all") >= F.lit(least)
    verdict = F.when(F.col("bare") >= 0.6, BARE).otherwise(0) + F.when((F.col("pages") >= 3) & (share >= 0.15), OFTEN).otherwise(0) + F.when(share >= 0.3, HALF).otherwise(0)
    decisive = by_site.join(overall, "key").where(wide | (F.col("pages") > 1)).withColumnRenamed("site", "of")
    decisive = decisive.join(by_host, F.col("of").eqNullSafe(F.col("site"))).where(wide | (share >= SITE_SHARE))
    decisive = decisive.select("of", F.col("key").alias("form"), F.col("key").bitwiseOR(verdict.cast("bigint")).alias("mark"))
    lines = pages.select("page_id", "site", F.explode(F.array_distinct("keys")).alias("key"))
    of_forms = lines.join(decisive, (F.col("key") == F.col("form")) & F.col("site").eqNullSafe(F.col("of"))).select("page_id", "mark")
    led = html.select("head", "bare", F.explode("leads").alias("lead")).where("lead <> 0").groupBy("lead", "head").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("bare").cast("int")).alias("bare"))
    led = led.groupBy("lead").agg(F.count(F.lit(1)).alias("all"), F.sum("rows").alias("rows"), F.sum("bare").alias("bare")).where(F.col("all") >= F.lit(least))
    heading = html.select(F.explode("headed").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("top"))
    # Fewer than leads of a page / CORPUS_SHARE can be left, whatever the number of pages.
    navigating = led.join(heading, F.col("lead") == F.col("h"), "left").where("bare < 0.6 * rows AND coalesce(top, 0) < 0.2 * rows").select("lead")
    of_leads = pages.select("page_id", F.explode(F.array_distinct("leads")).alias("lead")).where("lead <> 0").join(navigating, "lead", "left_semi").selectExpr("page_id", "lead AS mark")
    return of_forms.unionAll(of_leads).groupBy("page_id").agg(F.collect_list("mark").alias("marks"))


def with_marks(pages: DataFrame, *columns: str) -> DataFrame:
    """`columns` of the pages and their marks; the two meet by page, of which none is large."""
    return pages.select("page_id", *columns, "lines", "meta", "keys", "leads").join(repetition(pages), "page_id", "left")


class Page(NamedTuple):
    """A page's lines with what is known about each."""

    texts: list[str]
    blocks: list[str]
    linked: list[int]
    tags: list[int]
    code: list[bool]
    keys: list[int]
    leads: list[int]
    marks: dict[int, int]


def page_of(lines: str, meta: list[int], keys: list[int], leads: list[int], marks: list[int] | None) -> Page:
    """A page from the columns of `with_marks`."""
    return Page(
        lines.split("\n") if meta else [], [BLOCKS[m & 7] for m in meta], [m >> 28 for m in meta], [m >> 4 & 0xFFFFFF for m in meta], [bool(m & 8) for m in meta],
        keys, leads, {m & ~15: m & 15 for m in marks or ()},
    )


LEAD_WEIGHT = 0.1  # of a line whose lead is repeated


def line_weights(page: Page) -> list[float]:
    """How much of each line's text-to-tag ratio counts: nothing of repeated forms, LEAD_WEIGHT of it under a repeated lead.

    Sample code counts in full. So do headlines that share their wording with few of their site, and forms found
    mostly on pages without prose (messages and filler, such pages' content) that aren't links and stand under
    fewer than .3 of the site's headlines.
    """
    out = []
    for text, block, linked, code, key, lead in zip(page.texts, page.blocks, page.linked, page.code, page.keys, page.leads):
        verdict = None if code else page.marks.get(key)
        if verdict is None:
            repeated = False
        elif block in HEADLINES:
            repeated = verdict & (OFTEN | BARE) == OFTEN
        elif verdict & BARE and 10 * linked < 8 * len(text):
            repeated = bool(verdict & HALF)
        else:
            repeated = True
        out.append(0.0 if repeated else LEAD_WEIGHT if lead and not code and lead in page.marks else 1.0)
    return out
