"""Queries on scrape quality, prompts within hosts, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import names, text
from weftline.operators import quality, samples, stats
from weftline.plans.audit import _F, _flags
from weftline.session import table


def _cat(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def _site() -> Column:
    return names.site(F.col("hostname"), F.col("href"))


def flag_counts(s, d):
    """Flags by category."""
    f = _flags(s, d)
    names_ = ["clear_failure_union", "sparse_body_candidate", "sparse_script_shell_candidate", "html_markup", "markdown_like_without_html"]
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(n)).alias(n) for n in names_])


def hint_histogram(s, d):
    h = table(s, d, "quality_flags").select("raw_id", F.explode("path_hints").alias("hint")).distinct()
    return h.groupBy("hint").agg(F.count(F.lit(1)).alias("n"))


def computed_path_hints(s, d):
    """P5 over addresses."""
    return table(s, d, "raw").where("href IS NOT NULL").select("raw_id", F.array_join(text.path_hints(F.col("href")), ",").alias("hints"))


def path_features(s, d):
    """Fragment-free address, path, depth."""
    h = F.col("href")
    return table(s, d, "raw").where("href IS NOT NULL").select("raw_id", text.without_fragment(h).alias("url"), text.url_path(h).alias("path"), text.path_depth(h).cast("bigint").alias("depth"))


def prompt_styles(s, d):
    """P6, X12."""
    p = F.col("prompt")
    return table(s, d, "raw").where("prompt IS NOT NULL").select(
        "raw_id", text.prompt_is_question(p).alias("question"), text.prompt_is_comparison(p).alias("comparison"), text.prompt_is_how_to(p).alias("how_to"),
        p.rlike(r"\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}").alias("cjk"), (F.length(p) > 200).alias("long"), F.size(text.words(p)).cast("bigint").alias("n_words"),
    )


def clean_rows(s, d):
    """P7."""
    return _flags(s, d).where("html_markup AND NOT coalesce(clear_failure_union, false) AND NOT sparse_body_candidate AND body_words >= 100").select("raw_id")


def matched_pairs(s, d):
    """Top and bottom addresses of one host under the same prompt, by an equi join with a residual condition."""
    f = _flags(s, d).where("prompt IS NOT NULL AND hostname IS NOT NULL").select("hostname", F.lower(F.trim("prompt")).alias("p"), "category", "href")
    top, low = f.where("category = 'top'").select("hostname", "p", F.col("href").alias("top_href")), f.where("category = 'bottom'").select("hostname", "p", F.col("href").alias("bottom_href"))
    return top.join(low, ["hostname", "p"]).where("top_href <> bottom_href").groupBy("hostname").agg(F.count(F.lit(1)).alias("pairs"))


def pair_counts(s, d):
    """How many top and bottom rows could pair for each prompt, without making the pairs."""
    t, b = F.count_if(F.col("category") == "top"), F.count_if(F.col("category") == "bottom")
    return _flags(s, d).where("prompt IS NOT NULL").groupBy("prompt").agg((t * b).alias("pairs")).where("pairs > 0")


def host_prompt_overlap(s, d):
    """Prompts that a host's top and bottom rows share."""
    f = _flags(s, d).where("hostname IS NOT NULL AND prompt IS NOT NULL").select("hostname", "prompt", "category").groupBy("hostname", "prompt").agg(F.bool_or(F.col("category") == "top").alias("t"), F.bool_or(F.col("category") == "bottom").alias("b"))
    g = f.groupBy("hostname").agg(F.count_if(F.col("t") & F.col("b")).alias("shared"), F.count_if(F.col("t") | F.col("b")).alias("either"))
    return g.select("hostname", "shared", "either", F.round(F.when(F.col("either") > 0, F.col("shared") / F.col("either")), 6).alias("jaccard"))


def quality_anti_join(s, d):
    """Addresses none of whose rows is flagged."""
    f = _flags(s, d).where("href IS NOT NULL").select(F.regexp_replace("href", "#.*$", "").alias("url"), F.coalesce("clear_failure_union", F.lit(False)).alias("bad"))
    bad = f.groupBy("url").agg(F.bool_or("bad").alias("bad")).where("bad").select("url")
    return f.select("url").distinct().join(bad, "url", "left_anti")


def editorial_semi_join(s, d):
    """Raw rows whose flags name an editorial path."""
    e = table(s, d, "quality_flags").where(F.exists("path_hints", lambda h: h.isin("blog", "news"))).select("raw_id")
    return table(s, d, "raw").select("raw_id", "hostname").join(e, "raw_id", "left_semi")


def omitted_pages(s, d):
    """Snapshots without a raw row, and raw payloads without a snapshot."""
    raw = table(s, d, "raw").where("html_content IS NOT NULL").select(F.sha2("html_content", 256).alias("payload_hash"))
    snap = table(s, d, "snapshots").select("payload_hash")
    a = snap.join(raw, "payload_hash", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("snapshot").alias("side"), "n")
    return a.unionAll(raw.join(snap, "payload_hash", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw").alias("side"), "n"))


def url_quality(s, d):
    """Flags of an address or-ed together and its hints united."""
    q = table(s, d, "quality_flags").where("href IS NOT NULL")
    g = q.groupBy("href").agg(F.bool_or(F.coalesce("clear_failure_union", F.lit(False))).alias("failed"), F.bool_or("sparse_body_candidate").alias("sparse"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("path_hints")))), ",").alias("hints"))
    return g


def first_occurrence(s, d):
    """Later rows that repeat a record in (file, row) order."""
    r = table(s, d, "raw").select("raw_id", "source_file", "source_row", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\0")) for c in ("prompt", "citation_category", "href", "hostname", "html_content")]), 256).alias("record"))
    n = F.row_number().over(W.partitionBy("record").orderBy("source_file", "source_row"))
    return r.withColumn("n", n).where("n > 1").select("raw_id")


def last_record(s, d):
    """Of the rows of one record id the last one wins."""
    r = table(s, d, "raw_stress").select("record_id", "raw_id", "snapshot_id").distinct()
    return r.groupBy("record_id").agg(F.max("raw_id").alias("raw_id"), F.count(F.lit(1)).alias("n"))


def first_snapshot(s, d):
    """Where each payload and address was first seen."""
    r = table(s, d, "raw").where("html_content IS NOT NULL").select(F.sha2("html_content", 256).alias("h"), "href", "source_file", "source_row")
    return r.groupBy("h", "href").agg(F.min_by(F.struct("source_file", "source_row"), F.struct("source_file", "source_row")).alias("f")).select("h", "href", "f.source_file", "f.source_row")


def hash_sample(s, d):
    """Four rows of each label, by the hash of file and row; a sampling operator."""
    r = table(s, d, "raw").where("citation_category IN ('top', 'bottom')").select("raw_id", "citation_category", F.sha2(F.concat(F.lit("42:"), "source_file", F.lit(":"), F.col("source_row").cast("string")), 256).alias("h"))
    return r.withColumn("n", F.row_number().over(W.partitionBy("citation_category").orderBy("h"))).where("n <= 4").select("raw_id", "citation_category")


def first_of_flags(s, d):
    """For each hint the first eight distinct (host, category); a sampling operator."""
    x = table(s, d, "quality_flags").where("hostname IS NOT NULL AND category IS NOT NULL").select("raw_id", "hostname", "category", F.explode("path_hints").alias("hint")).groupBy("hint", "hostname", "category").agg(F.min("raw_id").alias("raw_id"))
    return x.withColumn("n", F.row_number().over(W.partitionBy("hint").orderBy("raw_id", "hostname", "category"))).where("n <= 8").select("hint", "hostname", "category", "raw_id")


def even_sample(s, d):
    """Eleven evenly spaced rows of the documents by id; a sampling operator. Ties of halves go to the even index."""
    t = table(s, d, "documents").select("doc_id")
    n = t.count()
    spots = t.sparkSession.createDataFrame([(int(round(i * (n - 1) / 10)),) for i in range(11)], "i BIGINT").distinct()
    return stats.running_sums(t.withColumn("one", F.lit(1)), "doc_id", ["one"]).select("doc_id", F.col("before_one").cast("bigint").alias("i")).join(F.broadcast(spots), "i").select("i", "doc_id")


def host_paired_difference(s, d):
    """Words of top less bottom pages, within hosts."""
    f = _flags(s, d).where("category IN ('top', 'bottom') AND hostname IS NOT NULL").withColumn("prompt_chars", F.length("prompt"))
    return stats.paired_summary(stats.host_differences(f, "hostname", F.col("category") == "top", ["body_words", "prompt_chars"]))


def wilcoxon_words(s, d):
    """A13."""
    f = _flags(s, d).where("category IN ('top', 'bottom') AND hostname IS NOT NULL").withColumn("prompt_chars", F.length("prompt"))
    return stats.wilcoxon(stats.host_differences(f, "hostname", F.col("category") == "top", ["body_words", "prompt_chars"]))


def matched_query_difference(s, d):
    """Differences within host and prompt, averaged within the host, then the median."""
    f = _flags(s, d).where("hostname IS NOT NULL AND prompt IS NOT NULL AND body_words IS NOT NULL").withColumn("p", F.lower(F.trim("prompt")))
    g = f.groupBy("hostname", "p").agg((F.avg(F.when(F.col("category") == "top", F.col("body_words"))) - F.avg(F.when(F.col("category") == "bottom", F.col("body_words")))).alias("gap")).where("gap IS NOT NULL")
    h = g.groupBy("hostname").agg(F.avg("gap").alias("gap"), F.count(F.lit(1)).alias("n"))
    return h.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("groups"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median_gap"))


def bh_adjusted(s, d):
    """W5 on the test against zero of each block type's mean length."""
    b = table(s, d, "blocks").where("text IS NOT NULL").groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("m"))
    return stats.benjamini_hochberg(b.select("block_type", F.round(F.exp(-F.col("m") / 100), 9).alias("p")), "p", "block_type")


def split_leakage(s, d):
    """Keys found in two splits."""
    st = table(s, d, "raw_stress").select("raw_id", "record_id", "snapshot_id", names.person(F.col("author")).alias("author"), names.split_name(F.col("split")).alias("split")).where("split IS NOT NULL").distinct()
    keys = st.select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("record_id", "snapshot_id", "author")])).alias("k")).select("split", "k.*").where("value IS NOT NULL").distinct()
    other = keys.select("kind", "value", F.col("split").alias("with_split"))
    return keys.join(other, ["kind", "value"]).where("split < with_split").groupBy("kind", "split", "with_split").agg(F.count(F.lit(1)).alias("n"))


def shared_payload_hosts(s, d):
    """Payloads that stand on several sites."""
    return table(s, d, "snapshots").withColumn("site", _site()).groupBy("payload_hash").agg(F.countDistinct("site").alias("n_sites")).where("n_sites > 1")


def exclusion_reasons(s, d):
    """Reasons to leave a row out, as an array."""
    r = _flags(s, d).withColumn("n_labels", F.size(F.collect_set("category").over(W.partitionBy("href"))))
    why = F.array_compact(F.array(F.when(F.col("prompt").isNull(), "no_prompt"), F.when(F.coalesce("clear_failure_union", F.lit(False)), "failure"), F.when(F.col("href").isNotNull() & (F.col("n_labels") > 1), "conflicting_label"), F.when(F.coalesce("body_words", F.lit(0)) < 100, "short")))
    return r.select("raw_id", F.array_join(why, ",").alias("reasons"))


def split_summary(s, d):
    """A47."""
    st = table(s, d, "raw_stress").select("raw_id", names.split_name(F.col("split")).alias("split")).distinct()
    return st.join(_flags(s, d), "raw_id").withColumn("site", _site()).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site").alias("n_sites"), F.count_if(F.col("category") == "top").alias("positives"))


def key_uniqueness(s, d):
    """V1: keys that are not unique, table by table."""
    spec = [("raw", "raw_id"), ("snapshots", "snapshot_id"), ("blocks", "block_uid"), ("documents", "doc_id"), ("raw_stress", "raw_id"), ("quality_flags", "raw_id")]
    out = None
    for t, k in spec:
        n = table(s, d, t).groupBy(k).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(t).alias("table_name"), "repeated")
        out = n if out is None else out.unionAll(n)
    return out


def cross_tab(s, d):
    """Path representation by category."""
    case = F.when(F.col("href").rlike(r"\.html?(?:$|[?#])"), "html").when(F.col("href").rlike(r"\?"), "query").otherwise("plain")
    return _flags(s, d).where("href IS NOT NULL").groupBy("category", case.alias("form")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_identity(s, d):
    """Identities recomputed from payload hash and address, against those stored."""
    j = table(s, d, "snapshots").where("href IS NOT NULL")
    made = F.sha2(F.to_json(F.array("payload_hash", "href")), 256)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(made == F.col("snapshot_id")).alias("same"))


def payload_checksums(s, d):
    """Stored hashes against payloads, joined by the first raw row."""
    j = table(s, d, "snapshots").join(table(s, d, "raw").select(F.col("raw_id").alias("first_raw_id"), F.sha2("html_content", 256).alias("h")), "first_raw_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") == F.col("payload_hash")).alias("same"), F.count_if(F.col("h").isNull()).alias("without"))


def connected_hosts(s, d):
    """Sites joined by equal payloads, with the component each is in."""
    from weftline.operators.components import connected_components

    x = table(s, d, "snapshots").withColumn("site", _site()).where("site IS NOT NULL").select("site", "payload_hash").distinct()
    edges = x.select(F.xxhash64("site").alias("a"), F.xxhash64(F.lit("p"), "payload_hash").alias("b"))
    c = connected_components(s, edges)
    tied = x.select("site").distinct().join(c, F.xxhash64("site") == F.col("node"))
    least = tied.groupBy("component").agg(F.min("site").alias("least"))
    return tied.join(least, "component").select("site", "least")


def quality_probe(s, d):
    """Flags computed from payloads."""
    return quality.probe_flags(quality.probe(table(s, d, "raw")))


def quality_agreement(s, d):
    """P4 against the stored flags."""
    made = quality_probe(s, d).select("raw_id", F.col("clear_failure_union").alias("found"))
    return made.join(_flags(s, d).select("raw_id", F.col("clear_failure_union").alias("stored")), "raw_id").groupBy("found", "stored").agg(F.count(F.lit(1)).alias("n"))


def prompt_style_counts(s, d):
    """P6, A16."""
    f = quality.prompt_style_flags(table(s, d, "raw"))
    return f.agg(*[F.count_if(F.col(c)).alias(c) for c in f.columns if c != "raw_id"])


def stratified_quota_sample(s, d):
    """Strata in order, one row a site; a sampling operator."""
    f = _flags(s, d).withColumn("site", _site())
    strata = [("failed", F.col("clear_failure_union"), 5), ("markdown", F.col("markdown_like_without_html"), 5), ("long", F.col("body_words") >= 400, 10), ("short", F.col("body_words") < 150, 10)]
    return samples.quota_sample(f, "raw_id", "site", strata)


def payload_disjoint_split(s, d):
    """Candidate results dealt to dev and heldout, with whole payloads."""
    r = table(s, d, "candidate_results").select("result_id", "snapshot_id").join(table(s, d, "snapshots").select("snapshot_id", "payload_hash"), "snapshot_id")
    r = r.withColumn("split", F.when(F.pmod("result_id", F.lit(5)) < 3, "dev").otherwise("heldout"))
    return samples.rebalance(r, "result_id", "payload_hash", "split").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        flag_counts, hint_histogram, computed_path_hints, path_features, prompt_styles, clean_rows, matched_pairs, pair_counts, host_prompt_overlap, quality_anti_join, editorial_semi_join,
        omitted_pages, url_quality, first_occurrence, last_record, first_snapshot, hash_sample, first_of_flags, even_sample, host_paired_difference, wilcoxon_words, matched_query_difference,
        bh_adjusted, split_leakage, shared_payload_hosts, exclusion_reasons, split_summary, key_uniqueness, cross_tab, snapshot_identity, payload_checksums, connected_hosts, quality_probe, quality_agreement, prompt_style_counts, stratified_quota_sample, payload_disjoint_split,
    )
}

_SITE = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(nullif(trim(hostname), ''), regexp_extract(href, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)))), ':\d*$', ''), '\.+$', ''), ':\d*$', ''), '^www\.', ''), '')"
_SPLIT = "CASE WHEN lower(trim(split)) IN ('train', 'validation', 'test') THEN lower(trim(split)) END"
_PATH = r"regexp_extract(trim(href), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"
_WORDS = r"regexp_extract_all(replace(lower(%s), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_HINTS = " || ".join(f"CASE WHEN regexp_matches(p, '{rx}') THEN ['{n}'] ELSE [] END" for n, rx in text.PATH_CLASSES.items()) + " || CASE WHEN p IN ('', '/') THEN ['homepage'] ELSE [] END"
_DIFF = _F + ", l AS (SELECT 'body_words' AS feature, hostname, category, body_words::DOUBLE AS v FROM f UNION ALL SELECT 'prompt_chars', hostname, category, length(prompt)::DOUBLE FROM f), h AS (SELECT feature, hostname, avg(v) FILTER (category = 'top') - avg(v) FILTER (category = 'bottom') AS diff FROM l WHERE hostname IS NOT NULL AND category IN ('top', 'bottom') AND v IS NOT NULL GROUP BY 1, 2), k AS (SELECT * FROM h WHERE diff IS NOT NULL) "
_NAME = r"regexp_replace(lower(trim(regexp_replace(author, '\s+', ' ', 'g'))), '^by[:\s]\s*', '')"
_PERSON = rf"CASE WHEN {_NAME} <> '' AND regexp_replace(regexp_replace({_NAME}, '^([^,]+?)\s*,\s*([^,]+)$', '\2 \1'), '^(?:the|our)\s+', '') NOT IN ({', '.join(repr(x) for x in names.HOUSE_BYLINES)}) THEN regexp_replace({_NAME}, '^([^,]+?)\s*,\s*([^,]+)$', '\2 \1') END"
_STYLE = {
    "missing_or_blank": r"NOT regexp_matches(p, '[^\s\p{Z}]')", "contains_question_mark": "contains(p, '?') OR contains(p, '？')", "long_40plus_words": r"len(regexp_extract_all(p, '[\p{L}\p{N}_]+')) >= 40",
    "short_1to5_words": r"len(regexp_extract_all(p, '[\p{L}\p{N}_]+')) BETWEEN 1 AND 5", "contains_non_ascii": r"regexp_matches(p, '[^\x00-\x7f]')", "english_question_start": f"regexp_matches(p, '{text.QUESTION}')", "english_comparison_marker": f"regexp_matches(p, '{text.COMPARISON}')",
    **{f"contains_{n}_block": f"regexp_matches(p, '{quality.writing_pattern(n)}')" for n in quality.WRITING},
}
ORACLE = {
    "stratified_quota_sample": _F
    + ", b AS (SELECT raw_id, sha256('42:' || raw_id) AS h, " + _SITE + """ AS site, clear_failure_union AS c1, markdown_like_without_html AS c2, body_words >= 400 AS c3, body_words < 150 AS c4 FROM f),
t1 AS (SELECT * FROM (SELECT raw_id, site, h FROM b WHERE c1 AND site IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY h) = 1) ORDER BY h LIMIT 5),
t2 AS (SELECT * FROM (SELECT raw_id, site, h FROM b WHERE c2 AND site IS NOT NULL AND site NOT IN (SELECT site FROM t1) QUALIFY row_number() OVER (PARTITION BY site ORDER BY h) = 1) ORDER BY h LIMIT 5),
t3 AS (SELECT * FROM (SELECT raw_id, site, h FROM b WHERE c3 AND site IS NOT NULL AND site NOT IN (SELECT site FROM t1 UNION ALL SELECT site FROM t2) QUALIFY row_number() OVER (PARTITION BY site ORDER BY h) = 1) ORDER BY h LIMIT 10),
t4 AS (SELECT * FROM (SELECT raw_id, site, h FROM b WHERE c4 AND site IS NOT NULL AND site NOT IN (SELECT site FROM t1 UNION ALL SELECT site FROM t2 UNION ALL SELECT site FROM t3) QUALIFY row_number() OVER (PARTITION BY site ORDER BY h) = 1) ORDER BY h LIMIT 10)
SELECT raw_id, site, 'failed' AS stratum FROM t1 UNION ALL SELECT raw_id, site, 'markdown' FROM t2 UNION ALL SELECT raw_id, site, 'long' FROM t3 UNION ALL SELECT raw_id, site, 'short' FROM t4""",
    "prompt_style_counts": "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _STYLE.items()) + " FROM (SELECT coalesce(prompt, '') AS p FROM raw)",
    "flag_counts": _F + "SELECT category, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER ({n}) AS {n}" for n in ("clear_failure_union", "sparse_body_candidate", "sparse_script_shell_candidate", "html_markup", "markdown_like_without_html")) + " FROM f GROUP BY category",
    "hint_histogram": "SELECT hint, count(*) AS n FROM (SELECT DISTINCT raw_id, unnest(path_hints) AS hint FROM quality_flags) GROUP BY hint",
    "computed_path_hints": f"SELECT raw_id, array_to_string({_HINTS}, ',') AS hints FROM (SELECT raw_id, lower({_PATH}) AS p FROM raw WHERE href IS NOT NULL)",
    "path_features": f"SELECT raw_id, regexp_replace(trim(href), '#.*$', '') AS url, {_PATH} AS path, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS depth FROM raw WHERE href IS NOT NULL",
    "prompt_styles": r"SELECT raw_id, regexp_matches(prompt, '(?i)^\s*(?:what|which|where|when|why|how|who|can|could|is|are|do|does|should|will)\b') OR contains(prompt, '?') OR contains(prompt, '？') AS question, regexp_matches(prompt, '(?i)\b(?:best|compare|comparison|versus|vs|better|cheapest)\b') AS comparison, regexp_matches(prompt, '(?i)\bhow\s+to\b') AS how_to, regexp_matches(prompt, '\p{Han}|\p{Hiragana}|\p{Katakana}') AS cjk, length(prompt) > 200 AS long, len("
    + _WORDS % "prompt" + ") AS n_words FROM raw WHERE prompt IS NOT NULL",
    "clean_rows": _F + "SELECT raw_id FROM f WHERE html_markup AND NOT coalesce(clear_failure_union, false) AND NOT sparse_body_candidate AND body_words >= 100",
    "matched_pairs": _F + "SELECT a.hostname, count(*) AS pairs FROM f a JOIN f b ON a.hostname = b.hostname AND lower(trim(a.prompt)) = lower(trim(b.prompt)) AND a.category = 'top' AND b.category = 'bottom' AND a.href <> b.href GROUP BY a.hostname",
    "pair_counts": _F + "SELECT prompt, pairs FROM (SELECT prompt, count(*) FILTER (category = 'top') * count(*) FILTER (category = 'bottom') AS pairs FROM f WHERE prompt IS NOT NULL GROUP BY prompt) WHERE pairs > 0",
    "host_prompt_overlap": _F + "SELECT hostname, shared, either, round(CASE WHEN either > 0 THEN shared / either END, 6) AS jaccard FROM (SELECT hostname, count(*) FILTER (t AND b) AS shared, count(*) FILTER (t OR b) AS either FROM (SELECT hostname, prompt, bool_or(category = 'top') AS t, bool_or(category = 'bottom') AS b FROM f WHERE hostname IS NOT NULL AND prompt IS NOT NULL GROUP BY 1, 2) GROUP BY hostname)",
    "quality_anti_join": _F + ", u AS (SELECT regexp_replace(href, '#.*$', '') AS url, coalesce(clear_failure_union, false) AS bad FROM f WHERE href IS NOT NULL) SELECT DISTINCT url FROM u WHERE url NOT IN (SELECT url FROM u WHERE bad)",
    "editorial_semi_join": "SELECT raw_id, hostname FROM raw SEMI JOIN (SELECT raw_id FROM quality_flags WHERE list_has_any(path_hints, ['blog', 'news'])) USING (raw_id)",
    "omitted_pages": "SELECT 'snapshot' AS side, count(*) AS n FROM snapshots WHERE payload_hash NOT IN (SELECT sha256(html_content) FROM raw WHERE html_content IS NOT NULL) UNION ALL SELECT 'raw', count(*) FROM raw WHERE html_content IS NOT NULL AND sha256(html_content) NOT IN (SELECT payload_hash FROM snapshots)",
    "url_quality": "SELECT href, bool_or(coalesce(clear_failure_union, false)) AS failed, bool_or(sparse_body_candidate) AS sparse, coalesce(array_to_string(list_sort(list_distinct(flatten(list(path_hints)))), ','), '') AS hints FROM quality_flags WHERE href IS NOT NULL GROUP BY href",
    "first_occurrence": "SELECT raw_id FROM (SELECT raw_id, row_number() OVER (PARTITION BY prompt, citation_category, href, hostname, html_content ORDER BY source_file, source_row) AS n FROM raw) WHERE n > 1",
    "last_record": "SELECT record_id, max(raw_id) AS raw_id, count(*) AS n FROM (SELECT DISTINCT record_id, raw_id, snapshot_id FROM raw_stress) GROUP BY record_id",
    "first_snapshot": "SELECT h, href, source_file, source_row FROM (SELECT sha256(html_content) AS h, href, source_file, source_row, row_number() OVER (PARTITION BY html_content, href ORDER BY source_file, source_row) AS n FROM raw WHERE html_content IS NOT NULL) WHERE n = 1",
    "hash_sample": "SELECT raw_id, citation_category FROM (SELECT raw_id, citation_category, row_number() OVER (PARTITION BY citation_category ORDER BY sha256('42:' || source_file || ':' || source_row)) AS n FROM raw WHERE citation_category IN ('top', 'bottom')) WHERE n <= 4",
    "first_of_flags": "WITH x AS (SELECT hint, hostname, category, min(raw_id) AS raw_id FROM (SELECT raw_id, hostname, category, unnest(path_hints) AS hint FROM quality_flags WHERE hostname IS NOT NULL AND category IS NOT NULL) GROUP BY 1, 2, 3) SELECT hint, hostname, category, raw_id FROM (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY raw_id, hostname, category) AS n FROM x) WHERE n <= 8",
    "even_sample": "WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT DISTINCT i, doc_id FROM t, range(11) r(k) WHERE i = round_even(k * (n - 1) / 10, 0)::BIGINT",
    "host_paired_difference": _DIFF + "SELECT feature, count(*) AS hosts, round(avg(diff), 6) AS mean_diff, round(median(diff), 6) AS median_diff, count(*) FILTER (diff > 1e-12) AS positive, count(*) FILTER (diff < -1e-12) AS negative, count(*) FILTER (abs(diff) <= 1e-12) AS tied FROM k GROUP BY feature",
    "matched_query_difference": _F + "SELECT count(*) AS hosts, coalesce(sum(n), 0)::BIGINT AS groups, round(median(gap), 6) AS median_gap FROM (SELECT hostname, avg(gap) AS gap, count(*) AS n FROM (SELECT hostname, lower(trim(prompt)) AS p, avg(body_words) FILTER (category = 'top') - avg(body_words) FILTER (category = 'bottom') AS gap FROM f WHERE hostname IS NOT NULL AND prompt IS NOT NULL AND body_words IS NOT NULL GROUP BY 1, 2) WHERE gap IS NOT NULL GROUP BY hostname)",
    "bh_adjusted": "WITH t AS (SELECT block_type, round(exp(-avg(length(text)) / 100), 9) AS p FROM blocks WHERE text IS NOT NULL GROUP BY block_type), r AS (SELECT *, row_number() OVER (ORDER BY p, block_type) AS k, count(*) OVER () AS n FROM t) SELECT block_type, p, round(least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r",
    "split_leakage": f"WITH k AS (SELECT DISTINCT {_SPLIT} AS split, kind, value FROM (SELECT split, 'record_id' AS kind, record_id AS value FROM raw_stress UNION ALL SELECT split, 'snapshot_id', snapshot_id FROM raw_stress UNION ALL SELECT split, 'author', {_PERSON} FROM raw_stress) WHERE value IS NOT NULL AND {_SPLIT} IS NOT NULL) SELECT a.kind, a.split, b.split AS with_split, count(*) AS n FROM k a JOIN k b USING (kind, value) WHERE a.split < b.split GROUP BY 1, 2, 3",
    "shared_payload_hosts": f"SELECT payload_hash, count(DISTINCT {_SITE}) AS n_sites FROM snapshots GROUP BY payload_hash HAVING count(DISTINCT {_SITE}) > 1",
    "exclusion_reasons": _F + ", g AS (SELECT href, count(DISTINCT category) AS n FROM f GROUP BY href) SELECT raw_id, array_to_string(list_filter([CASE WHEN prompt IS NULL THEN 'no_prompt' END, CASE WHEN clear_failure_union THEN 'failure' END, CASE WHEN g.n > 1 THEN 'conflicting_label' END, CASE WHEN coalesce(body_words, 0) < 100 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f LEFT JOIN g ON f.href = g.href",
    "split_summary": _F + f"SELECT s.split, count(*) AS n_rows, count(DISTINCT {_SITE}) AS n_sites, count(*) FILTER (category = 'top') AS positives FROM (SELECT DISTINCT raw_id, {_SPLIT} AS split FROM raw_stress) s JOIN f USING (raw_id) GROUP BY s.split",
    "key_uniqueness": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS repeated FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in (("raw", "raw_id"), ("snapshots", "snapshot_id"), ("blocks", "block_uid"), ("documents", "doc_id"), ("raw_stress", "raw_id"), ("quality_flags", "raw_id"))),
    "cross_tab": _F + r"SELECT category, CASE WHEN regexp_matches(href, '\.html?(?:$|[?#])') THEN 'html' WHEN regexp_matches(href, '\?') THEN 'query' ELSE 'plain' END AS form, count(*) AS n FROM f WHERE href IS NOT NULL GROUP BY 1, 2",
    "snapshot_identity": """SELECT count(*) AS n, count(*) FILTER (sha256('["' || payload_hash || '","' || href || '"]') = snapshot_id) AS same FROM snapshots WHERE href IS NOT NULL""",
    "payload_checksums": "SELECT count(*) AS n, count(*) FILTER (sha256(html_content) = payload_hash) AS same, count(*) FILTER (html_content IS NULL) AS without FROM snapshots LEFT JOIN raw ON first_raw_id = raw_id",
    "connected_hosts": f"WITH RECURSIVE x AS (SELECT DISTINCT {_SITE} AS site, payload_hash FROM snapshots), e AS (SELECT DISTINCT a.site AS a, b.site AS b FROM x a JOIN x b USING (payload_hash) WHERE a.site IS NOT NULL AND b.site IS NOT NULL), r(site, reach) AS (SELECT site, site FROM x WHERE site IS NOT NULL UNION SELECT r.site, e.b FROM r JOIN e ON r.reach = e.a) SELECT site, min(reach) AS least FROM r GROUP BY site",
}
