"""Queries of related splits, pieces and overlaps, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import pieces, related_splits
from weftline.llm.split_overlap import SplitOverlap
from weftline.session import setting, table


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return related_splits.record_groups(spark, table(spark, folder, "raw_stress"), table(spark, folder, "quality_flags"))


def _shares(spark: SparkSession, folder: str) -> dict[str, float]:
    return {name: setting(spark, folder, f"share_{name}") for name in related_splits.SPLITS}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose group has more than one split."""
    return related_splits.broken_groups(_groups(spark, folder))


def p3_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The new split of each record."""
    return related_splits.assign_splits(_groups(spark, folder), _shares(spark, folder))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the new splits and of those in use."""
    groups = _groups(spark, folder)
    return related_splits.split_report(groups, related_splits.assign_splits(groups, _shares(spark, folder)))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized blocks and results."""
    limits = [int(setting(spark, folder, n)) for n in ("block_limit", "result_limit", "piece_overlap")]
    return pieces.split_all(table(spark, folder, "blocks"), table(spark, folder, "candidate_results"), *limits)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items over their limit."""
    return p5_pieces(spark, folder).where("piece = 0").select("item_kind", "item_id", "cut_kind")


def _overlap(spark: SparkSession, folder: str) -> SplitOverlap:
    least, same = int(setting(spark, folder, "overlap_min_body")), setting(spark, folder, "overlap_min_same")
    return SplitOverlap(spark, table(spark, folder, "raw"), table(spark, folder, "raw_stress"), table(spark, folder, "quality_flags"), least, same, table(spark, folder, "snapshots"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an evaluation record and a training record with nearly the same body."""
    pairs = _overlap(spark, folder).linked()
    return pairs.select(F.least("eval_id", "train_id").alias("raw_id_a"), F.greatest("eval_id", "train_id").alias("raw_id_b")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping records and pairs for each split and site."""
    return _overlap(spark, folder).report()


QUERIES = {f.__name__: f for f in (p3_found, p3_assignment, p3_shares, p5_found, p5_pieces, p6_found, p6_report)}

_ITEMS = r"""
WITH lim AS (SELECT max(amount) FILTER (param = 'block_limit') AS b, max(amount) FILTER (param = 'result_limit') AS r FROM run_config),
blk AS (SELECT 'block' AS item_kind, block_uid AS item_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, b AS room FROM blocks, lim),
res AS (
  SELECT 'result' AS item_kind, result_id AS item_id,
    array_to_string(list_filter(list_transform(list_sort(list_transform(blocks, lambda x: {'o': x.block_order, 'i': x.block_id, 't': x.text})),
      lambda x: regexp_replace(x.t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda t: t <> ''), chr(10) || chr(10)) AS text, r AS room
  FROM candidate_results, lim),
items AS (SELECT * FROM blk WHERE length(text) > room UNION ALL SELECT * FROM res WHERE length(text) > room)
"""
_LINKS = r"""
WITH RECURSIVE h AS (SELECT raw_id, min(site) AS site FROM (SELECT raw_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(nullif(trim(hostname), ''),
    regexp_extract(href, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)), '\s+', ' ', 'g'))), ':\d*$', ''), '\.+$', ''), ':\d*$', ''), '^www\.', ''), '') AS site FROM quality_flags WHERE raw_id IS NOT NULL) GROUP BY 1),
n AS (SELECT DISTINCT raw_id, CASE WHEN lower(trim(split)) IN ('train', 'validation', 'test') THEN lower(trim(split)) END AS split,
    regexp_replace(regexp_replace(lower(trim(regexp_replace(author, '\s+', ' ', 'g'))), '^by[:\s]\s*', ''), '^([^,]+?)\s*,\s*([^,]+)$', '\2 \1') AS name FROM raw_stress WHERE raw_id IS NOT NULL),
r AS (SELECT raw_id, split, 's:' || site AS a, CASE WHEN name <> '' AND regexp_replace(name, '^(the|our)\s+', '') NOT IN
    ('editorial team', 'editorial staff', 'editorial', 'editors', 'editor', 'staff', 'staff writer', 'admin', 'administrator', 'newsroom', 'guest writer', 'guest author', 'guest') THEN 'p:' || name END AS b FROM n LEFT JOIN h USING (raw_id)),
e AS (SELECT DISTINCT a, b FROM r WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT DISTINCT b, a FROM r WHERE a IS NOT NULL AND b IS NOT NULL),
walk(node, least) AS (SELECT a, a FROM e UNION SELECT e.b, walk.least FROM walk JOIN e ON e.a = walk.node WHERE walk.least < e.b),
c AS (SELECT node, min(least) AS least FROM walk GROUP BY 1),
g AS (SELECT raw_id, split, coalesce(least, a, b, 'r:' || raw_id) AS grp FROM r LEFT JOIN c ON c.node = coalesce(a, b)),
one AS (SELECT raw_id, min(grp) AS grp, min(split) AS split FROM g GROUP BY 1)
"""
ORACLE = {
    "p3_found": _LINKS + "SELECT raw_id FROM one WHERE split IS NOT NULL AND grp IN (SELECT grp FROM one WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)",
    "p5_found": _ITEMS
    + r"""SELECT item_kind, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\p{Z}。！？]'), lambda x: length(x))) > room THEN 'forced' ELSE 'natural' END AS cut_kind FROM items""",
}
