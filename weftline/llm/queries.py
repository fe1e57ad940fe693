"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import main_body, mixing, packing, repeated_lines, split_queries
from weftline.llm.failures import FailurePages
from weftline.llm.spans import SharedSpans
from weftline.session import setting, table


def _failures(spark: SparkSession, folder: str) -> FailurePages:
    return FailurePages(spark, table(spark, folder, "raw"), table(spark, folder, "quality_flags"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows that show residue, filler, messages or requests for scripts in place of content."""
    return _failures(spark, folder).scored().where("failed").select("raw_id")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows that are kept: with a payload, and not found."""
    return _failures(spark, folder).scored().where("NOT failed").select("raw_id", F.round("score", 4).alias("score"))


def p1_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How the classifier does on sites that its fit has not seen, against weak labels."""
    rows = [(k, float(v)) for k, v in _failures(spark, folder).validation.items()]
    return spark.createDataFrame(rows, "measure STRING, value DOUBLE")


def _repeated(spark: SparkSession, folder: str, variant: Callable[[Column], Column] | None = None) -> repeated_lines.RepeatedLines:
    pages = repeated_lines.numbered_pages(spark, table(spark, folder, "raw"))
    return repeated_lines.RepeatedLines(spark, pages, int(setting(spark, folder, "line_min_pages")), setting(spark, folder, "line_min_share"), variant)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines repeated across a site's pages."""
    return _repeated(spark, folder).texts().select("site", "line")


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each HTML page without its site's repeated lines."""
    return _repeated(spark, folder).stripped()


def p2_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose variants in case and digits are repeated together."""
    return _repeated(spark, folder, lambda line: F.regexp_replace(F.lower(line), r"\d+", "#")).texts()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of HTML pages that aren't body."""
    return main_body.outside_body(spark, table(spark, folder, "raw"))


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The body of each HTML page."""
    return main_body.body_texts(spark, table(spark, folder, "raw"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    capacity = int(setting(spark, folder, "pack_capacity"))
    return packing.pack_items(spark, packing.token_items(table(spark, folder, "documents"), capacity), capacity), capacity


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are divided over containers."""
    return _packed(spark, folder)[0].where("piece = 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The containers' contents."""
    return _packed(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.packing_report(*_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(spark, table(spark, folder, "documents"))
    plan = mixing.mix_plan(sized, table(spark, folder, "mix_targets"))
    return mixing.mixture(sized, plan), plan


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't fill their share."""
    return mixing.mixture_shares(*_mixed(spark, folder)).where("short").select("source")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen copies in their order."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares."""
    return mixing.mixture_shares(*_mixed(spark, folder))


def _shared(spark: SparkSession, folder: str) -> SharedSpans:
    return SharedSpans(spark, table(spark, folder, "documents"), int(setting(spark, folder, "shared_span_min")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a long stretch in common."""
    return _shared(spark, folder).pairs()


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Exact stretches and fuzzy passages of pairs of different texts."""
    return _shared(spark, folder).spans


def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document stands in another."""
    return _shared(spark, folder).coverage()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clean, p1_validation, p2_found, p2_pages, p2_variants, p4_found, p4_bodies,
        p7_found, p7_containers, p7_report, p8_found, p8_mixture, p8_shares, p9_found, p9_spans, p9_coverage,
    )
}
QUERIES |= split_queries.QUERIES
#: The other operators read payloads or tokens, or chain seeds, none of which SQL can say; their tests use brute force.
ORACLE: dict[str, str] = dict(split_queries.ORACLE) | {
    # Characters give the same answer as tokens.
    "p8_found": r"""WITH s AS (SELECT nullif(lower(trim(regexp_replace(source, '\s+', ' ', 'g'))), '') AS k, length(text) AS n FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')),
t AS (SELECT k, sum(n) AS n FROM s GROUP BY 1), a AS (SELECT sum(n) AS n FROM s)
SELECT source FROM mix_targets LEFT JOIN t ON k = lower(trim(source)), a WHERE coalesce(t.n, 0) * max_repeats < target_share * a.n""",
    "p9_found": """WITH w AS (SELECT DISTINCT doc_id, md5_number(substr(text, p::BIGINT, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS p FROM documents WHERE length(text) >= 200)),
s AS (SELECT h, list(doc_id) AS ids FROM w GROUP BY 1 HAVING count(*) > 1), d AS (SELECT DISTINCT list_sort(ids) AS ids FROM s), a AS (SELECT ids, unnest(ids) AS x FROM d), b AS (SELECT x, unnest(ids) AS y FROM a)
SELECT DISTINCT x AS doc_id_a, y AS doc_id_b FROM b WHERE x < y""",
}
