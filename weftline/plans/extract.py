"""Queries on extracted documents, their parts and their units."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import blocks as tree
from weftline.operators import extract as ops
from weftline.session import table


def _docs(s, d):
    return ops.extract_documents(table(s, d, "raw"))


def payload_format(s, d):
    """X20 against the stored format."""
    r = table(s, d, "raw").select(F.col("raw_id").alias("first_raw_id"), text.payload_format(F.col("html_content")).alias("found"))
    return table(s, d, "snapshots").join(r, "first_raw_id").groupBy("payload_format", "found").agg(F.count(F.lit(1)).alias("n"))


def document_status(s, d):
    """A20, A21, H20."""
    return _docs(s, d).groupBy("format", "method", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("blocks")).alias("n_blocks"))


def source_inventory(s, d):
    """H1, H15."""
    return _docs(s, d).where("format = 'html'").select("snapshot_id", "inventory.title", "inventory.lang", "inventory.visible_words", "inventory.main_words", "inventory.focus_words", "inventory.scripts", "inventory.headings", "inventory.links")


def html_titles(s, d):
    """H15 where SQL can follow: titles without markup inside."""
    return _docs(s, d).where("inventory.title IS NOT NULL").groupBy(F.col("inventory.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def extracted_blocks(s, d):
    """H8, H12."""
    return ops.block_rows(_docs(s, d)).groupBy("block_type", "mapping_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def extracted_cells(s, d):
    """H11."""
    return ops.cell_rows(_docs(s, d)).groupBy("is_header").agg(F.count(F.lit(1)).alias("n"), F.max("column").alias("widest"))


def extracted_links(s, d):
    """H10, X23."""
    return ops.link_rows(_docs(s, d)).groupBy(F.regexp_extract("resolved_target", "^([a-z]+)://", 1).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


def extracted_markdown(s, d):
    """H14."""
    return _docs(s, d).select("snapshot_id", F.length("markdown").alias("chars"), F.sha2("markdown", 256).alias("sha"))


def extracted_chunks(s, d):
    """H19, H21 over our own extraction."""
    b = ops.block_rows(_docs(s, d)).withColumn("block_uid", F.monotonically_increasing_id()).select("snapshot_id", "method", "block_uid", "block_id", "block_order", "parent_id", "block_type", "text", "heading_level")
    return tree.structure_chunks(b).groupBy("oversized").agg(F.count(F.lit(1)).alias("n"), F.max("characters").alias("longest"))


def unit_census(s, d):
    """E1 to E6."""
    return ops.embedding_units(_docs(s, d)).groupBy("view", "status").agg(F.count(F.lit(1)).alias("n"))


def query_units(s, d):
    return ops.query_units(table(s, d, "raw")).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def associations(s, d):
    """Records without a document or a query."""
    return ops.associations(table(s, d, "raw")).groupBy("citation_category").agg(F.count(F.lit(1)).alias("n"), F.count("snapshot_id").alias("with_snapshot"), F.count("query_unit_id").alias("with_query"))


def semantic_paths(s, d):
    """X10."""
    return table(s, d, "raw").select("raw_id", text.semantic_path("href").alias("p")).select("raw_id", "p.path", "p.status", "p.reason", F.array_join("p.flags", ",").alias("flags"))


QUERIES = {
    f.__name__: f
    for f in (
        payload_format, document_status, source_inventory, html_titles, extracted_blocks, extracted_cells, extracted_links, extracted_markdown, extracted_chunks, unit_census, query_units, associations, semantic_paths,
    )
}
ORACLE = {
    "semantic_paths": r"""
WITH r AS (SELECT raw_id, href, href IS NULL OR regexp_matches(href, '[\x00-\x20\x7f]') AS bad, coalesce(regexp_matches(href, '(?i)^https?://([^/?#@]*@)?[^/?#:@]+(:\d*)?([/?#]|$)'), false) AS web,
  string_split(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS raws FROM raw),
x AS (SELECT *, list_transform(raws, lambda s: trim(regexp_replace(regexp_replace(url_decode(s), '[-_]', ' ', 'g'), '\s+', ' ', 'g'))) AS words FROM r),
y AS (SELECT *, array_to_string(list_filter(words, lambda w: w <> ''), ' / ') AS path,
  flatten(list_transform(list_zip(raws, words), lambda z: list_filter([CASE WHEN contains(lower(z[1]), '%2f') THEN 'encoded_slash_in_segment' END, CASE WHEN regexp_full_match(z[2], '\d+') THEN 'numeric_segment' END,
    CASE WHEN length(z[2]) >= 24 AND NOT contains(z[2], ' ') THEN 'possibly_opaque_segment' END], lambda f: f IS NOT NULL))) AS flags FROM x)
SELECT raw_id, CASE WHEN bad OR NOT web THEN '' ELSE path END AS path, CASE WHEN bad OR NOT web OR path = '' THEN 'unavailable' ELSE 'ready' END AS status,
  CASE WHEN bad THEN 'invalid_url' WHEN NOT web THEN 'unsupported_url' WHEN path = '' THEN 'root_only_path' END AS reason, CASE WHEN bad OR NOT web THEN '' ELSE array_to_string(flags, ',') END AS flags FROM y""",
    "query_units": "WITH p AS (SELECT DISTINCT trim(prompt) AS t FROM raw WHERE prompt IS NOT NULL) SELECT CASE WHEN t = '' OR strlen(t) > 4096 THEN 'unavailable' ELSE 'ready' END AS status, CASE WHEN t = '' THEN 'blank' WHEN strlen(t) > 4096 THEN 'oversized' END AS reason, count(*) AS n FROM p GROUP BY 1, 2",
    "associations": "SELECT lower(trim(citation_category)) AS citation_category, count(*) AS n, count(html_content) AS with_snapshot, count(prompt) AS with_query FROM raw GROUP BY 1",
    "html_titles": r"WITH r AS (SELECT DISTINCT html_content AS h, href FROM raw WHERE html_content IS NOT NULL) SELECT nullif(regexp_extract(h, '<html lang=\"(\w+)\"', 1), '') AS lang, count(*) AS n FROM r WHERE regexp_matches(h, '(?i)<title>') GROUP BY 1".replace('\\"', '"'),
}
