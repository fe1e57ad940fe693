"""Queries that profile the raw table and its quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import audit
from weftline.session import table

TEXTS = ["source_file", "prompt", "citation_category", "href", "hostname", "html_content"]


def _flags(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "quality_flags").drop("path_hints").distinct()


def column_profile(s, d):
    return audit.column_profile(table(s, d, "raw"), TEXTS)


def exact_duplicates(s, d):
    return audit.exact_duplicates(table(s, d, "raw"), ["prompt", "citation_category", "href", "hostname", "html_content"])


def host_rollup(s, d):
    return audit.key_profile(_flags(s, d), "hostname", ["prompt", "href"], "category")


def url_rollup(s, d):
    return audit.key_profile(_flags(s, d), "href", ["prompt", "hostname"], "category")


def prompt_rollup(s, d):
    return audit.key_profile(_flags(s, d), "prompt", ["href", "hostname"], "category")


def prompt_label_counts(s, d):
    return _flags(s, d).groupBy("prompt", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("urls"))


def group_size_histogram(s, d):
    return audit.group_size_histogram(table(s, d, "raw"), "href")


def payload_length_quantiles(s, d):
    return audit.quantiles(table(s, d, "raw").withColumn("chars", F.length("html_content")).where("citation_category IS NOT NULL AND chars IS NOT NULL"), "chars", "citation_category")


def url_summary(s, d):
    return audit.url_summary(_flags(s, d))


def hosts_with_both_labels(s, d):
    return audit.both_labels(_flags(s, d), "hostname")


def body_words_distribution(s, d):
    return audit.distribution(_flags(s, d), "body_words")


def page_collapse(s, d):
    return audit.collapse_pages(table(s, d, "raw").where("href IS NOT NULL AND hostname IS NOT NULL"), "hostname", "href", "html_content", "citation_category")


def payload_lengths(s, d):
    return audit.payload_lengths(table(s, d, "raw"))


def nonblank_prompts(s, d):
    """Rows whose prompt has something in it."""
    return table(s, d, "raw").where(F.col("prompt").isNotNull() & ~F.col("prompt").rlike(r"^[ \t\n\f\r]*$")).select("raw_id", "prompt")


def sites(s, d):
    """The canonical site of each raw row."""
    return table(s, d, "raw").select("raw_id", names.site(F.col("hostname"), F.col("href")).alias("site"))


def triple_count(s, d):
    """Distinct (prompt, host, address) triples; triples with a null count too."""
    return table(s, d, "raw").select("prompt", "hostname", "href").distinct().agg(F.count(F.lit(1)).alias("triples"))


def max_rows_checks(s, d):
    """The largest group of each label for a prompt, and prompts with more than five rows."""
    g = _flags(s, d).where("prompt IS NOT NULL").groupBy("prompt").agg(F.count_if(F.col("category") == "top").alias("t"), F.count_if(F.col("category") == "bottom").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.max(F.greatest("t", "b")).alias("most"), F.count_if(F.col("n") > 5).alias("over_five"))


def top_urls(s, d):
    """O2: the twenty addresses with most rows; a top-k report."""
    g = table(s, d, "raw").where("href IS NOT NULL").groupBy("href").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "href").limit(20)


QUERIES = {
    f.__name__: f
    for f in (
        column_profile, exact_duplicates, host_rollup, url_rollup, prompt_rollup, prompt_label_counts, group_size_histogram, payload_length_quantiles, url_summary,
        hosts_with_both_labels, body_words_distribution, page_collapse, payload_lengths, nonblank_prompts, sites, triple_count, max_rows_checks, top_urls,
    )
}

_F = "WITH f AS (SELECT DISTINCT raw_id, hostname, href, category, prompt, clear_failure_union, sparse_body_candidate, sparse_script_shell_candidate, html_markup, markdown_like_without_html, body_words FROM quality_flags) "


def _rollup(key: str, a: str, b: str) -> str:
    return _F + f"SELECT {key}, count(*) AS n_rows, count(DISTINCT {a}) AS distinct_{a}, count(DISTINCT {b}) AS distinct_{b}, count(*) FILTER (category = 'top') AS top_rows, count(*) FILTER (category = 'bottom') AS bottom_rows FROM f GROUP BY {key}"


_BLANK = r"'^[ \t\n\f\r]*$'"
ORACLE = {
    "column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS rows_total, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} = '') AS empties, count(*) FILTER (regexp_matches({c}, {_BLANK})) AS blanks, count(DISTINCT {c}) AS distinct_values FROM raw"
        for c in TEXTS
    ),
    "exact_duplicates": "SELECT count(*) AS dup_groups, coalesce(sum(n), 0)::BIGINT AS rows_involved, coalesce(sum(n - 1), 0)::BIGINT AS excess FROM (SELECT count(*) AS n FROM raw GROUP BY prompt, citation_category, href, hostname, html_content HAVING count(*) > 1)",
    "host_rollup": _rollup("hostname", "prompt", "href"),
    "url_rollup": _rollup("href", "prompt", "hostname"),
    "prompt_rollup": _rollup("prompt", "href", "hostname"),
    "prompt_label_counts": _F + "SELECT prompt, category, count(*) AS n, count(DISTINCT href) AS urls FROM f GROUP BY prompt, category",
    "group_size_histogram": "SELECT group_size, count(*) AS n_groups FROM (SELECT count(*) AS group_size FROM raw WHERE href IS NOT NULL GROUP BY href) GROUP BY group_size",
    "payload_length_quantiles": "WITH p AS (SELECT unnest([0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]::DOUBLE[]) AS point, unnest(v) AS value, citation_category FROM (SELECT citation_category, quantile_cont(length(html_content)::DOUBLE, [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]) AS v FROM raw WHERE citation_category IS NOT NULL AND html_content IS NOT NULL GROUP BY 1)) SELECT citation_category, point, round(value, 6) AS value FROM p",
    "url_summary": _F + "SELECT count(*) AS urls, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (p > 1) AS multi_prompt, count(*) FILTER (c > 1) AS conflicting, count(*) FILTER (h > 1) AS multi_host, max(n) AS most_rows FROM (SELECT count(*) AS n, count(DISTINCT prompt) AS p, count(DISTINCT category) AS c, count(DISTINCT hostname) AS h FROM f WHERE href IS NOT NULL GROUP BY href)",
    "hosts_with_both_labels": _F + "SELECT hostname FROM f WHERE hostname IS NOT NULL AND category IN ('top', 'bottom') GROUP BY hostname HAVING count(DISTINCT category) = 2",
    "body_words_distribution": _F + ", o AS (SELECT list_sort(list(body_words)) AS v FROM f WHERE body_words IS NOT NULL) SELECT len(v) AS n, round(list_avg(v), 3) AS mean, list_median(v) AS median, v[floor((len(v) - 1) * 0.1)::BIGINT + 1] AS p10, v[floor((len(v) - 1) * 0.9)::BIGINT + 1] AS p90, list_max(v) AS most FROM o",
    "page_collapse": r"""WITH r AS (SELECT lower(trim(hostname)) AS host, regexp_replace(trim(href), '#.*$', '') AS url, prompt, citation_category AS c, sha256(coalesce(html_content, '')) AS sha, length(coalesce(html_content, '')) AS n FROM raw WHERE href IS NOT NULL AND hostname IS NOT NULL)
SELECT host, url, count(DISTINCT sha) AS payloads, count(DISTINCT prompt) AS prompts, count(*) AS n_rows, CASE WHEN count(DISTINCT c) > 1 THEN 'conflicting' ELSE min(c) END AS label, max(n) AS longest, max(sha) FILTER (n = m) AS longest_sha
FROM (SELECT *, max(n) OVER (PARTITION BY host, url) AS m FROM r) GROUP BY host, url""",
    "payload_lengths": rf"SELECT raw_id, length(html_content) AS chars, regexp_matches(html_content, {_BLANK}) AS blank, len(regexp_extract_all(coalesce(html_content, ''), '[\p{{L}}\p{{N}}_]+')) AS n_words FROM raw",
    "nonblank_prompts": f"SELECT raw_id, prompt FROM raw WHERE prompt IS NOT NULL AND NOT regexp_matches(prompt, {_BLANK})",
    "sites": r"""WITH h AS (SELECT raw_id, lower(trim(coalesce(nullif(trim(hostname), ''), regexp_extract(href, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)))) AS h FROM raw)
SELECT raw_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, ':\d*$', ''), '\.+$', ''), ':\d*$', ''), '^www\.', ''), '') AS site FROM h""",
    "triple_count": "SELECT count(*) AS triples FROM (SELECT DISTINCT prompt, hostname, href FROM raw)",
    "max_rows_checks": _F + "SELECT max(greatest(t, b)) AS most, count(*) FILTER (n > 5) AS over_five FROM (SELECT count(*) FILTER (category = 'top') AS t, count(*) FILTER (category = 'bottom') AS b, count(*) AS n FROM f WHERE prompt IS NOT NULL GROUP BY prompt)",
    "top_urls": "SELECT href, count(*) AS n FROM raw WHERE href IS NOT NULL GROUP BY href ORDER BY n DESC, href LIMIT 20",
}
