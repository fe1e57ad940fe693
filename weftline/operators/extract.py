"""Extraction: each distinct payload is read once, into one row with its blocks; everything after that is relational."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import dom
from weftline.functions.markup import is_html
from weftline.functions.text import split_bytes, stable_hash
from weftline.session import small_batches, spread

BYTES_MOST = 20_000_000  # payloads above are refused with a status, not failed

_LINK = pa.struct([("text", pa.string()), ("target", pa.string()), ("resolved_target", pa.string())])
_CELL = pa.struct([("row", pa.int32()), ("column", pa.int32()), ("text", pa.string()), ("is_header", pa.bool_()), ("row_group", pa.string()), ("rowspan", pa.int32()), ("colspan", pa.int32())])
_BLOCK = pa.struct(
    [
        ("block_id", pa.string()), ("block_order", pa.int32()), ("parent_id", pa.string()), ("block_type", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("links", pa.list_(_LINK)), ("cells", pa.list_(_CELL)),
        ("dom_path", pa.string()), ("mapping_status", pa.string()), ("ordered", pa.bool_()), ("start", pa.int32()), ("language", pa.string()), ("markdown", pa.string()),
    ]
)
_INVENTORY = pa.struct(
    [("title", pa.string()), ("lang", pa.string()), ("description", pa.string()), ("canonical", pa.string()), ("json_ld", pa.list_(pa.string()))]
    + [(n, pa.int32()) for n in ("json_ld_errors", "scripts", "tags", "headings", "h1", "paragraphs", "items", "tables", "images", "links", "code", "forms", "visible_words", "main_words", "focus_words")]
    + [("pdf_embed", pa.bool_())]
)
_DOCUMENT = pa.schema([("snapshot_id", pa.string()), ("href", pa.string()), ("format", pa.string()), ("method", pa.string()), ("status", pa.string()), ("inventory", _INVENTORY), ("blocks", pa.list_(_BLOCK)), ("markdown", pa.string())])


def read_document(snapshot_id: str, href: str | None, payload: str | None) -> dict:
    """One payload's document. A payload that can't be read has a status and no blocks; null and blank ones are empty."""
    out: dict = {"snapshot_id": snapshot_id, "href": href, "format": "unknown", "method": "conservative_dom", "status": "empty", "inventory": None, "blocks": [], "markdown": ""}
    if not payload or payload.isspace():
        return out
    if len(payload) > BYTES_MOST or len(payload) > BYTES_MOST // 4 and len(payload.encode("utf-8", "surrogatepass")) > BYTES_MOST:
        return out | {"status": "unsupported_format"}
    try:
        if is_html(payload):
            blocks = dom.html_blocks(payload, href or "")
            out |= {"format": "html", "inventory": dom.inventory(payload, href or "")}
        else:
            blocks = dom.text_blocks(payload)
            out |= {"format": "markdown" if any(b["block_type"] != "paragraph" or b["links"] for b in blocks) else "text", "method": "markdown_text"}
    except (ValueError, RecursionError):
        return out | {"status": "error"}
    return out | {"status": "ok" if any(b["text"] for b in blocks) else "empty", "blocks": blocks, "markdown": dom.blocks_markdown(blocks)}


def extract_documents(raw: DataFrame) -> DataFrame:
    """A document for each distinct payload and address of `raw`; rows that repeat one are read once."""
    from pyspark.sql.pandas.types import from_arrow_schema

    small_batches(raw.sparkSession)
    ident = F.sha2(F.to_json(F.array(F.sha2("html_content", 256), F.col("href"))), 256)
    each = spread(raw.where("html_content IS NOT NULL")).select(ident.alias("snapshot_id"), "href", "html_content", "raw_id")
    first = each.groupBy("snapshot_id").agg(F.min("raw_id").alias("raw_id"))  # payloads stay out of the exchange until their row is known
    once = each.join(first, ["snapshot_id", "raw_id"], "left_semi").select("snapshot_id", "href", "html_content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([read_document(*(c.as_py() for c in row)) for row in zip(*(batch.column(i)[lo : lo + 64] for i in range(3)))], schema=_DOCUMENT)

    return once.mapInArrow(run, from_arrow_schema(_DOCUMENT))


def block_rows(documents: DataFrame) -> DataFrame:
    return documents.select("snapshot_id", "method", F.explode("blocks").alias("b")).select("snapshot_id", "method", "b.*")


def cell_rows(documents: DataFrame) -> DataFrame:
    return block_rows(documents).where("block_type = 'table'").select("snapshot_id", "block_id", F.explode("cells").alias("c")).select("snapshot_id", "block_id", "c.*")


def link_rows(documents: DataFrame) -> DataFrame:
    return block_rows(documents).select("snapshot_id", "block_id", F.explode("links").alias("l")).select("snapshot_id", "block_id", "l.*")


_UNIT = pa.schema([("unit_id", pa.string()), ("snapshot_id", pa.string()), ("view", pa.string()), ("subview", pa.string()), ("text", pa.string()), ("status", pa.string()), ("reason", pa.string()), ("block_ids", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("weight", pa.int32())])


def document_units(doc: dict, page_bytes: int = 7000, section_bytes: int = 4096) -> list[dict]:
    """A document's embedding units: title, outline, path, page and sections. A text above its ceiling is cut into chunks beside one derived unit.

    A section starts with its headings. block_ids are the blocks whose text a unit overlaps.
    """
    from weftline.functions.text import read_path

    out: list[dict] = []

    def add(view: str, subview: str, text: str | None, spans: list, reason: str | None = None, status: str | None = None, at: tuple[int, int] | None = None) -> None:
        lo, hi = at or (0, len(text or ""))
        ids = [i for a, b, i in spans if a < hi and b > lo]
        out.append({
            "unit_id": stable_hash([doc["snapshot_id"], view, subview, text, lo, hi]), "snapshot_id": doc["snapshot_id"], "view": view, "subview": subview, "text": text, "status": status or ("ready" if text else "unavailable"),
            "reason": reason if not text else None, "block_ids": ids, "start": lo, "end": hi, "weight": len((text or "").encode("utf-8", "surrogatepass")),
        })

    def text_units(view: str, subview: str, parts: list[tuple[str, str]], ceiling: int, prefix: str = "") -> None:
        text, spans = prefix, []
        for block_id, piece in parts:
            if piece:
                text += ("\n\n" if text else "") + piece
                spans.append((len(text) - len(piece), len(text), block_id))
        if not spans:
            add(view, subview, None, [], "no_text")
            return
        chunks = split_bytes(text, ceiling, [a for a, _, _ in spans])
        if len(chunks) == 1:
            add(view, subview, text, spans)
            return
        add(view, subview, text, spans, status="derived")
        for n, (a, b) in enumerate(chunks):
            add(view, f"{subview}:chunk{n}", text[a:b], spans, at=(a, b))

    blocks = doc["blocks"]
    title = (doc["inventory"] or {}).get("title") if doc["inventory"] else None
    add("title", "title", title or None, [], "no_title")
    heads = [(b["block_id"], "#" * (b["heading_level"] or 1) + " " + b["text"]) for b in blocks if b["block_type"] == "heading"]
    text_units("outline", "outline", heads, section_bytes)
    path, _, reason, _ = read_path(doc["href"])
    add("path", "path", path or None, [], reason)
    text_units("page", "page", [(b["block_id"], b["text"]) for b in blocks], page_bytes)
    stack: list[dict] = []
    section: list[dict] = []
    number = 0

    def close() -> None:
        nonlocal number
        if any(b["text"] for b in section):
            text_units("section", f"section{number}", [(b["block_id"], b["text"]) for b in section], section_bytes, " > ".join(h["text"] for h in stack))
            number += 1

    for b in blocks:
        if b["block_type"] == "heading":
            close()
            section = []
            while stack and (stack[-1]["heading_level"] or 1) >= (b["heading_level"] or 1):
                stack.pop()
            stack.append(b)
        else:
            section.append(b)
    close()
    return out


def embedding_units(documents: DataFrame) -> DataFrame:
    """All units of all documents."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                units = [u for doc in batch.slice(lo, 64).to_pylist() for u in document_units(doc)]
                yield pa.RecordBatch.from_pylist(units, schema=_UNIT)

    return documents.select("snapshot_id", "href", "inventory", "blocks").mapInArrow(run, from_arrow_schema(_UNIT))


def query_units(raw: DataFrame, ceiling: int = 4096) -> DataFrame:
    """(unit_id, text, status, reason) of each distinct prompt; blank and oversized ones are unavailable."""
    p = raw.where("prompt IS NOT NULL").select(F.trim("prompt").alias("text")).distinct()
    reason = F.when(F.col("text") == "", "blank").when(F.octet_length("text") > ceiling, "oversized")
    return p.select(F.sha2(F.concat(F.lit("query"), "text"), 256).alias("unit_id"), "text", F.when(reason.isNull(), "ready").otherwise("unavailable").alias("status"), reason.alias("reason"))


def associations(raw: DataFrame) -> DataFrame:
    """(raw_id, snapshot_id, query_unit_id, hostname, href, citation_category): which record asks what of which document."""
    ident = F.sha2(F.to_json(F.array(F.sha2("html_content", 256), F.col("href"))), 256)
    return raw.select("raw_id", F.when(F.col("html_content").isNotNull(), ident).alias("snapshot_id"), F.when(F.col("prompt").isNotNull(), F.sha2(F.concat(F.lit("query"), F.trim("prompt")), 256)).alias("query_unit_id"), "hostname", "href", F.lower(F.trim("citation_category")).alias("citation_category"))
