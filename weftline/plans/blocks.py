"""Queries on blocks, chunks and extraction candidates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import blocks as ops
from weftline.session import table

METHODS = ["conservative_dom", "readability", "trafilatura", "baseline", "markdown_text"]


def _b(s, d):
    return ops.distinct_blocks(table(s, d, "blocks"))


def blocks_census(s, d):
    """A20."""
    return table(s, d, "blocks").groupBy("method", "block_type", "mapping_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def section_segments(s, d):
    """W13."""
    return ops.section_sizes(_b(s, d)).groupBy("snapshot_id", "method").agg(F.count(F.lit(1)).alias("sections"), F.max("chars").alias("longest"))


def supported_headings(s, d):
    """W14, H23."""
    return ops.supported_headings(_b(s, d)).groupBy("snapshot_id", "method").agg(F.count(F.lit(1)).alias("n"))


def block_depths(s, d):
    """J21."""
    return ops.depths(_b(s, d)).groupBy("depth", "quoted").agg(F.count(F.lit(1)).alias("n"))


def tree_faults(s, d):
    """V2."""
    return ops.tree_faults(table(s, d, "blocks"))


def document_texts(s, d):
    """A document's block texts joined."""
    t = ops.gathered(table(s, d, "blocks")).select("snapshot_id", "method", F.array_join(F.filter(F.transform("blocks", lambda b: b["text"]), lambda x: x != ""), "\n\n").alias("text"))
    return t.select("snapshot_id", "method", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("sha"))


def chunks(s, d):
    """H19, W12, W15."""
    return ops.structure_chunks(table(s, d, "blocks")).select("snapshot_id", "method", "chunk", "chunk_id", "characters", "oversized")


def chunk_partition(s, d):
    """V3."""
    return ops.chunk_faults(table(s, d, "blocks"), ops.structure_chunks(table(s, d, "blocks")))


def _anchors(s, d):
    """H1 headings of the blocks are required, copyright lines unwanted."""
    b = table(s, d, "blocks").where("text IS NOT NULL AND trim(text) <> ''")
    kind = F.when((F.col("block_type") == "heading") & (F.col("heading_level") == 1), "required").when(F.col("text").contains("©"), "unwanted")
    return b.select("snapshot_id", kind.alias("kind"), F.col("text").alias("anchor")).where("kind IS NOT NULL").distinct().join(table(s, d, "candidate_results").select("snapshot_id").distinct(), "snapshot_id", "left_semi")


def anchor_retention(s, d):
    """A22, J18."""
    return ops.anchor_metrics(table(s, d, "candidate_results"), _anchors(s, d), METHODS)


def anchors_without_block(s, d):
    """V7: anchors that no candidate text contains."""
    a = _anchors(s, d)
    r = table(s, d, "candidate_results").where("text IS NOT NULL").select("snapshot_id", "text")
    found = a.join(r, "snapshot_id").where(F.contains("text", "anchor")).select("snapshot_id", "kind", "anchor").distinct()
    return a.join(found, ["snapshot_id", "kind", "anchor"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def latency(s, d):
    """A22, A23."""
    return ops.latency(table(s, d, "candidate_results"))


def baseline_pairs(s, d):
    """Text lengths of each method less those of the stored blocks of the same snapshot."""
    r = table(s, d, "candidate_results").where("status = 'ok' AND text IS NOT NULL").groupBy("snapshot_id", "method").agg(F.max(F.length("text")).alias("n"))
    base = _b(s, d).groupBy("snapshot_id").agg(F.sum(F.length("text")).alias("base"))
    return r.join(base, "snapshot_id").groupBy("method").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("n") - F.col("base")), 6).alias("mean_delta"))


def candidate_agreement(s, d):
    """U4: candidates against the stored blocks of their snapshot."""
    stored = _b(s, d).where("text IS NOT NULL").groupBy("snapshot_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select("snapshot_id", F.lit("stored").alias("method"), "text")
    return ops.agreement(table(s, d, "candidate_results").select("snapshot_id", "method", "text").unionByName(stored))


def _sources(s, d):
    """Snapshots with their payload, a rough visible text, and flags."""
    flags = table(s, d, "quality_flags").groupBy("raw_id").agg(F.max("clear_failure_union").alias("failed"))
    x = table(s, d, "snapshots").select("snapshot_id", F.col("payload_format").alias("format"), F.col("first_raw_id").alias("raw_id")).join(table(s, d, "raw").select("raw_id", F.col("html_content").alias("payload")), "raw_id", "left").join(flags, "raw_id", "left")
    visible = F.regexp_replace("payload", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    flagged = F.when(F.col("failed"), F.array(F.lit("possible_error_response"))).otherwise(F.array().cast("array<string>"))
    return x.select("snapshot_id", "format", "payload", visible.alias("body_text"), flagged.alias("quality_flags"))


def selection(s, d):
    """H17."""
    return ops.select_candidates(_sources(s, d), table(s, d, "candidate_results"))


def precision_selection(s, d):
    """H18."""
    return ops.select_by_agreement(_sources(s, d), table(s, d, "candidate_results"))


def selection_census(s, d):
    """A43."""
    return selection(s, d).groupBy("status", "method").agg(F.count(F.lit(1)).alias("n"))


def support_matrix(s, d):
    """Which methods met which payload formats, with and without success."""
    r = table(s, d, "candidate_results").join(table(s, d, "snapshots").select("snapshot_id", "payload_format"), "snapshot_id")
    return r.groupBy("method", "payload_format").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))


def repeated_paragraph(s, d):
    """The long paragraph that most snapshots repeat (a top-1 report)."""
    b = table(s, d, "blocks").where("block_type = 'paragraph' AND length(text) >= 60").groupBy("text").agg(F.countDistinct("snapshot_id").alias("n"))
    return b.orderBy(F.desc("n"), "text").limit(1)


def previous_block_gap(s, d):
    """W-type check: gaps in the block order."""
    b = _b(s, d).withColumn("gap", F.col("block_order") - F.lag("block_order").over(W.partitionBy("snapshot_id", "method").orderBy("block_order", "block_id")))
    return b.where("gap > 1").groupBy("method").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (
        blocks_census, section_segments, supported_headings, block_depths, tree_faults, document_texts, chunks, chunk_partition, anchor_retention, anchors_without_block, latency, baseline_pairs,
        candidate_agreement, selection, precision_selection, selection_census, support_matrix, repeated_paragraph, previous_block_gap,
    )
}

_B = "WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, method, block_id ORDER BY block_uid) AS rn FROM blocks) WHERE rn = 1), s AS (SELECT *, sum((block_type = 'heading')::INT) OVER (PARTITION BY snapshot_id, method ORDER BY block_order, block_id ROWS UNBOUNDED PRECEDING) AS section FROM b) "
_A = "WITH a AS (SELECT DISTINCT snapshot_id, CASE WHEN block_type = 'heading' AND heading_level = 1 THEN 'required' WHEN contains(text, '©') THEN 'unwanted' END AS kind, text AS anchor FROM blocks WHERE text IS NOT NULL AND trim(text) <> '' AND snapshot_id IN (SELECT snapshot_id FROM candidate_results)), k AS (SELECT * FROM a WHERE kind IS NOT NULL) "
_SRC = r"""WITH q AS (SELECT raw_id, bool_or(clear_failure_union) AS failed FROM quality_flags GROUP BY 1), src AS (SELECT snapshot_id, payload_format AS format, html_content AS payload, coalesce(failed, false) AS failed,
  lower(trim(html_content, ' ')) = 'not-implemented' OR NOT regexp_matches(regexp_replace(html_content, '(?is)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '[^\s\p{Z}]') AS none
  FROM snapshots LEFT JOIN raw ON raw_id = first_raw_id LEFT JOIN q USING (raw_id)), good AS (SELECT snapshot_id, method, max_by(text, length(text)) AS text FROM candidate_results WHERE status = 'ok' AND regexp_matches(text, '[^\s\p{Z}]') GROUP BY 1, 2), """
_SEL = _SRC + r"""p AS (SELECT *, CASE WHEN format = 'html' THEN 'conservative_dom' WHEN format IN ('markdown', 'text') THEN 'markdown_text' END AS preferred FROM src),
sel AS (SELECT p.snapshot_id, CASE WHEN preferred IS NULL THEN 'unsupported_format' WHEN none THEN 'source_insufficient' WHEN good.method IS NULL OR failed THEN 'needs_review' ELSE 'selected' END AS status,
  CASE WHEN NOT none THEN good.method END AS method FROM p LEFT JOIN good ON good.snapshot_id = p.snapshot_id AND good.method = preferred) """
_PREC = _SRC + r"""w AS (SELECT snapshot_id, method, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM good WHERE method IN ('readability', 'trafilatura')),
n AS (SELECT snapshot_id, word, count(*) FILTER (method = 'readability') AS a, count(*) FILTER (method = 'trafilatura') AS b FROM w GROUP BY 1, 2), ag AS (SELECT snapshot_id, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS agreement FROM n GROUP BY 1),
b AS (SELECT snapshot_id, bool_or(method = 'markdown_text') AS native, count(*) FILTER (method IN ('readability', 'trafilatura')) = 2 AS pair FROM good GROUP BY 1),
x AS (SELECT src.*, coalesce(native, false) AS native, format = 'html' AND coalesce(pair, false) AND NOT failed AS open, coalesce(agreement, 0.0) AS share FROM src LEFT JOIN b USING (snapshot_id) LEFT JOIN ag USING (snapshot_id)),
m AS (SELECT *, CASE WHEN none THEN NULL WHEN format IN ('markdown', 'text') AND native THEN 'markdown_text' WHEN open AND share >= 0.65 THEN CASE WHEN regexp_matches(payload, '(?i)<pre\b|<(th|td)\b[^>]*(rowspan|colspan)\s*=') THEN 'readability' ELSE 'trafilatura' END END AS method FROM x)
SELECT snapshot_id, CASE WHEN none THEN 'source_insufficient' WHEN method IS NOT NULL THEN 'selected' WHEN format IN ('html', 'markdown', 'text') THEN 'needs_review' ELSE 'unsupported_format' END AS status, method, CASE WHEN NOT none AND open THEN share END AS agreement FROM m"""
ORACLE = {
    "blocks_census": "SELECT method, block_type, mapping_status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM blocks GROUP BY 1, 2, 3",
    "section_segments": _B + ", g AS (SELECT snapshot_id, method, section, coalesce(sum(CASE WHEN block_type <> 'heading' THEN length(trim(text)) ELSE 0 END), 0)::BIGINT AS chars FROM s GROUP BY 1, 2, 3) SELECT snapshot_id, method, count(*) AS sections, max(chars) AS longest FROM g WHERE section > 0 OR chars > 0 GROUP BY 1, 2",
    "supported_headings": _B + r", w AS (SELECT *, sum(CASE WHEN block_type <> 'heading' THEN len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')) ELSE 0 END) OVER (PARTITION BY snapshot_id, method, section) AS support FROM s), h AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, method, lower(trim(text)) ORDER BY block_order, block_id) AS k FROM w WHERE block_type = 'heading' AND support >= 5) SELECT snapshot_id, method, count(*) AS n FROM h WHERE k = 1 GROUP BY 1, 2",
    "block_depths": "WITH RECURSIVE b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, method, block_id ORDER BY block_uid) AS rn FROM blocks) WHERE rn = 1), r(snapshot_id, method, block_id, up, depth, quoted) AS (SELECT snapshot_id, method, block_id, parent_id, 0, block_type = 'quote' FROM b UNION ALL SELECT r.snapshot_id, r.method, r.block_id, p.parent_id, r.depth + 1, r.quoted OR p.block_type = 'quote' FROM r JOIN b p ON r.snapshot_id = p.snapshot_id AND r.method = p.method AND r.up = p.block_id), m AS (SELECT snapshot_id, method, block_id, max(depth) AS depth, bool_or(quoted) AS quoted FROM r GROUP BY 1, 2, 3) SELECT depth, quoted, count(*) AS n FROM m GROUP BY 1, 2",
    "tree_faults": _B + ", j AS (SELECT b.block_order, p.block_order AS pos FROM b LEFT JOIN b p ON b.snapshot_id = p.snapshot_id AND b.method = p.method AND b.parent_id = p.block_id WHERE b.parent_id IS NOT NULL) SELECT 'repeated_id' AS fault, (SELECT count(*) FROM (SELECT 1 FROM blocks GROUP BY snapshot_id, method, block_id HAVING count(*) > 1)) AS n UNION ALL SELECT 'missing_parent', count(*) FILTER (pos IS NULL) FROM j UNION ALL SELECT 'late_parent', count(*) FILTER (pos >= block_order) FROM j",
    "document_texts": _B + ", t AS (SELECT snapshot_id, method, coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY block_order, block_id) FILTER (trim(text) <> ''), '') AS text FROM b GROUP BY 1, 2) SELECT snapshot_id, method, length(text) AS chars, sha256(text) AS sha FROM t",
    "chunk_partition": "SELECT count(*) AS documents, 0 AS faults FROM (SELECT DISTINCT snapshot_id, method FROM blocks)",
    "anchor_retention": _A + r", best AS (SELECT snapshot_id, method, arg_max(text, length(text)) AS text FROM candidate_results WHERE status = 'ok' GROUP BY 1, 2), x AS (SELECT k.*, m.method, best.text IS NOT NULL AS there, coalesce(contains(lower(regexp_replace(trim(best.text), '\s+', ' ', 'g')), lower(regexp_replace(trim(anchor), '\s+', ' ', 'g'))), false) AS hit FROM k CROSS JOIN (SELECT unnest(['conservative_dom', 'readability', 'trafilatura', 'baseline', 'markdown_text']) AS method) m LEFT JOIN best ON best.snapshot_id = k.snapshot_id AND best.method = m.method), e AS (SELECT snapshot_id, method, kind, count(*) AS n, count(*) FILTER (hit) AS hits, bool_or(there) AS there FROM x GROUP BY 1, 2, 3) SELECT method, count(DISTINCT snapshot_id) AS snapshots, count(DISTINCT snapshot_id) FILTER (NOT there) AS failures, (sum(hits) FILTER (kind = 'required'))::BIGINT AS retained, (sum(n) FILTER (kind = 'required'))::BIGINT AS required, (sum(hits) FILTER (kind = 'unwanted'))::BIGINT AS leaked, (sum(n) FILTER (kind = 'unwanted'))::BIGINT AS unwanted, round(avg(hits / n) FILTER (kind = 'required'), 6) AS macro_retention, round(avg(hits / n) FILTER (kind = 'unwanted'), 6) AS macro_leakage FROM e GROUP BY method",
    "anchors_without_block": _A + "SELECT kind, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM candidate_results c WHERE c.snapshot_id = k.snapshot_id AND contains(c.text, k.anchor)) GROUP BY kind",
    "latency": "SELECT method, status, count(*) AS n, round(median(runtime_ms), 6) AS median_ms, round(quantile_cont(runtime_ms, 0.95), 6) AS p95_ms FROM candidate_results GROUP BY 1, 2",
    "baseline_pairs": _B + ", t AS (SELECT snapshot_id, sum(length(text)) AS base FROM b GROUP BY 1), r AS (SELECT snapshot_id, method, max(length(text)) AS n FROM candidate_results WHERE status = 'ok' AND text IS NOT NULL GROUP BY 1, 2) SELECT method, count(*) AS pairs, round(avg(n - base), 6) AS mean_delta FROM r JOIN t USING (snapshot_id) GROUP BY 1",
    "candidate_agreement": _B + r", best AS (SELECT snapshot_id, method, arg_max(text, length(text)) AS text FROM candidate_results WHERE text IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT snapshot_id, 'stored', string_agg(text, ' ') FROM b WHERE text IS NOT NULL GROUP BY 1), c AS (SELECT snapshot_id, method, w, count(*) AS n FROM (SELECT snapshot_id, method, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM best) GROUP BY 1, 2, 3), z AS (SELECT snapshot_id, method, sum(n) AS n FROM c GROUP BY 1, 2), i AS (SELECT a.snapshot_id, a.method AS ma, b.method AS mb, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.snapshot_id = b.snapshot_id AND a.w = b.w AND a.method < b.method GROUP BY 1, 2, 3) SELECT a.snapshot_id, a.method AS method_a, b.method AS method_b, round(coalesce(common, 0) / (a.n + b.n - coalesce(common, 0)), 6) AS agreement FROM z a JOIN z b ON a.snapshot_id = b.snapshot_id AND a.method < b.method LEFT JOIN i ON i.snapshot_id = a.snapshot_id AND ma = a.method AND mb = b.method",
    "selection": _SEL + "SELECT * FROM sel",
    "precision_selection": _PREC,
    "selection_census": _SEL + "SELECT status, method, count(*) AS n FROM sel GROUP BY 1, 2",
    "support_matrix": "SELECT method, payload_format, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM candidate_results JOIN snapshots USING (snapshot_id) GROUP BY 1, 2",
    "repeated_paragraph": "SELECT text, count(DISTINCT snapshot_id) AS n FROM blocks WHERE block_type = 'paragraph' AND length(text) >= 60 GROUP BY text ORDER BY n DESC, text LIMIT 1",
    "previous_block_gap": _B + ", g AS (SELECT method, block_order - lag(block_order) OVER (PARTITION BY snapshot_id, method ORDER BY block_order, block_id) AS gap FROM b) SELECT method, count(*) AS gaps, max(gap) AS largest FROM g WHERE gap > 1 GROUP BY method",
}
