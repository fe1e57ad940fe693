"""Queries on verified joins, manifests, sizes and structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import blocks as tree
from weftline.operators import relations as ops
from weftline.session import Scratch, table
from weftline.sources import corpus


def _once(s, d):
    """Flags with rows repeated whole counted once."""
    return table(s, d, "quality_flags").select("raw_id", "hostname", "href", "category", "prompt", "body_words", "clear_failure_union").distinct()


def bounded_scan(s, d):
    """S3: the first hundred rows in file order, which is the feature."""
    return ops.bounded(table(s, d, "raw"), ["source_file", "source_row"], 100).select("raw_id", F.length("html_content").alias("chars"))


def table_schema(s, d):
    """S6."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in ("raw", "snapshots", "documents", "blocks") for f in table(s, d, t).schema.fields]
    return s.createDataFrame(rows, "table_name STRING, column_name STRING, kind STRING")


def frozen_snapshots(s, d):
    """Payloads that a snapshot's hash verifies, by format."""
    raw = table(s, d, "raw").select(F.col("raw_id").alias("first_raw_id"), F.sha2("html_content", 256).alias("got"))
    x = table(s, d, "snapshots").join(raw, "first_raw_id", "left")
    return x.groupBy("payload_format").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("got") == F.col("payload_hash")).alias("verified"), F.count_if(F.col("got").isNull()).alias("missing"))


def view_units(s, d):
    """Units of one view by prefix, without chunks."""
    b = table(s, d, "blocks").where("method = 'conservative_dom' AND text IS NOT NULL").withColumn("subview", F.concat_ws(":", "block_type", F.when(F.length("text") > 400, "chunk")))
    return b.where(F.col("subview").startswith("head") & ~F.col("subview").endswith(":chunk")).groupBy("subview", "lang").agg(F.count(F.lit(1)).alias("n"))


def smallest_snapshots(s, d):
    """Blocks of the fifty smallest snapshot ids, which is the feature."""
    return ops.smallest(table(s, d, "blocks"), "snapshot_id", 50).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))


def aligned_features(s, d):
    """P15."""
    one = _once(s, d).groupBy("raw_id").agg(F.max("body_words").alias("body_words"))
    two = table(s, d, "raw").select("raw_id", F.length("prompt").alias("prompt_chars"))
    three = table(s, d, "raw_stress").groupBy("raw_id").agg(F.countDistinct("author").alias("authors"))
    return ops.aligned("raw_id", one, two, three)


def join_faults(s, d):
    """Flags against raw rows, column by column."""
    raw = table(s, d, "raw").select("raw_id", "href", "hostname", "prompt", F.col("citation_category").alias("category"))
    return ops.verified_join(_once(s, d), raw, ["raw_id"], ["href", "hostname", "prompt", "category"])


def imported_splits(s, d):
    """Splits taken over where row and snapshot agree with the snapshots' own table."""
    x = table(s, d, "raw_stress").distinct().join(table(s, d, "snapshots").select("snapshot_id", F.col("first_raw_id")), "snapshot_id", "left")
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("first_raw_id").alias("known"), F.count_if(F.col("first_raw_id") == F.col("raw_id")).alias("first"))


def common_population(s, d):
    """Every flagged row, with its split where it has one."""
    split = table(s, d, "raw_stress").groupBy("raw_id").agg(F.min("split").alias("split"))
    x = _once(s, d).join(split, "raw_id", "left").withColumn("common", F.col("split").isNotNull())
    return x.groupBy("common").agg(F.count(F.lit(1)).alias("n"), F.sum("body_words").alias("words"), F.countDistinct("hostname").alias("hosts"))


def overlap_rollup(s, d):
    """Sites with and without a prompt that stands under both labels."""
    r = table(s, d, "raw").where("prompt IS NOT NULL AND hostname IS NOT NULL AND citation_category IN ('top', 'bottom')")
    p = r.groupBy("hostname", "prompt").agg(F.countDistinct("citation_category").alias("labels"))
    h = p.groupBy("hostname").agg(F.count_if(F.col("labels") > 1).alias("shared"), F.count(F.lit(1)).alias("prompts"))
    return h.groupBy((F.col("shared") > 0).alias("has_shared")).agg(F.count(F.lit(1)).alias("hosts"), F.sum("shared").alias("shared"), F.sum("prompts").alias("prompts"))


def attempt_resources(s, d):
    """Outcome and tokens of attempts, unknown ones apart."""
    c = table(s, d, "candidate_results").withColumn("good", F.when(F.col("status") == "ok", True).when(F.col("status").isin("error", "timeout"), False))
    tokens = F.ceil(F.octet_length("text") / 4)
    return c.groupBy("method").agg(
        F.count_if("good").alias("true_n"), F.count_if(~F.col("good")).alias("false_n"), F.count_if(F.col("good").isNull()).alias("unknown_n"),
        F.count("text").alias("measured"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"),
    )


def url_collapse(s, d):
    """A29."""
    snap = table(s, d, "raw_stress").where("snapshot_id IS NOT NULL").select("raw_id", "snapshot_id").distinct()
    x = _once(s, d).where("href IS NOT NULL").join(snap, "raw_id").select(F.col("href").alias("url"), "prompt", "snapshot_id", F.col("body_words").cast("double").alias("v"), F.col("raw_id").alias("n"))
    return ops.collapsed_by_url(x, "v").select("url", "queries", F.round("mean", 6).alias("mean"))


def measure_quantiles(s, d):
    """A30."""
    c = table(s, d, "candidate_results").select(F.col("runtime_ms"), F.length("text").alias("chars"), F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("n_blocks"))
    q = ops.coverage_quantiles(c, ["runtime_ms", "chars", "n_blocks"])
    return q.select("measure", "rows", "present", *[F.round(n, 6).alias(n) for n in ("least", "q25", "median", "q75", "most")])


def embedding_sizing(s, d):
    """Blocks and prompts as units."""
    u = table(s, d, "blocks").select(F.lit("document").alias("role"), "text").unionAll(table(s, d, "raw").select(F.lit("query"), "prompt"))
    return ops.embedding_sizes(u, 3072, 128, 0.13)


def matched_by_prompt(s, d):
    """A38."""
    r = _once(s, d).where("prompt IS NOT NULL AND category IN ('top', 'bottom')")
    kinds = (("prompt", ["prompt"]), ("prompt and site", ["prompt", "hostname"]))
    one, two = (ops.matched_support(r, keys, "category").select(F.lit(name).alias("grouping"), "*") for name, keys in kinds)
    return one.unionAll(two)


def extraction_accounting(s, d):
    """Pages by site and address: repeats, labels, payloads, pages without words, payloads of several addresses."""
    r = table(s, d, "raw").where("href IS NOT NULL").select("raw_id", "hostname", "href", "citation_category", F.md5("html_content").alias("h"))
    words = _once(s, d).groupBy("raw_id").agg(F.max("body_words").alias("w"))
    p = r.join(words, "raw_id", "left").groupBy("hostname", "href").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("citation_category").alias("labels"), F.countDistinct("h").alias("payloads"), F.max("w").alias("w"))
    wide = r.where("h IS NOT NULL").groupBy("h").agg(F.countDistinct("href").alias("urls")).agg(F.count_if(F.col("urls") > 1).alias("shared_payloads"))
    sums = p.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("n") - 1).alias("collapsed"), F.count_if(F.col("labels") > 1).alias("conflicting"), F.count_if(F.col("payloads") > 1).alias("several_payloads"), F.count_if(F.col("w") == 0).alias("without_words"))
    return sums.join(wide)  # one row each


def validation_sample(s, d):
    """The ten first record ids of each split (the sample is the feature)."""
    x = table(s, d, "raw_stress").where("split IS NOT NULL").select("split", "record_id").distinct()
    return x.withColumn("r", F.row_number().over(W.partitionBy("split").orderBy("record_id"))).where("r <= 10").select("split", "record_id")


def report_queries(s, d):
    """Prompts in normal form with their stable place on their site."""
    n = F.lower(F.trim(F.regexp_replace("prompt", r"[\s\p{Z}]+", " ")))
    x = table(s, d, "raw").where("prompt IS NOT NULL AND hostname IS NOT NULL").select("hostname", n.alias("prompt"), "raw_id").where("prompt <> ''").groupBy("hostname", "prompt").agg(F.min("raw_id").alias("raw_id"))
    return x.select("hostname", "raw_id", F.row_number().over(W.partitionBy("hostname").orderBy("prompt", "raw_id")).alias("place"))


def record_places(s, d):
    """The place of each record in its file's order."""
    return table(s, d, "raw").select("raw_id", F.row_number().over(W.partitionBy("source_file").orderBy("source_row")).alias("place"))


def best_variant(s, d):
    """Of scores with one, two or three terms the one with the least log loss, by return flag."""
    p = F.lit(0.05)
    l = table(s, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("double").alias("y"), p.alias("one"), (p + F.col("l_discount") * 3).alias("two"), (p + F.col("l_discount") * 3 + F.col("l_tax") * 2).alias("three"))
    loss = lambda c: -(F.col("y") * F.log(F.col(c)) + (1 - F.col("y")) * F.log(1 - F.col(c)))
    g = l.groupBy("l_linestatus").agg(*[F.round(F.avg(loss(c)), 6).alias(c) for c in ("one", "two", "three")])
    pick = F.array_min(F.array(*[F.struct(F.col(c).alias("loss"), F.lit(c).alias("variant")) for c in ("one", "two", "three")]))
    return g.select("l_linestatus", pick.alias("b")).select("l_linestatus", "b.variant", "b.loss")


def latest_jobs(s, d):
    """The five latest events of each kind (the report is the feature)."""
    w = W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_type", "event_id", "r")


def usage_sums(s, d):
    """Sums of a field of the JSON details."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("used"), F.count(k).alias("told"), F.count(F.lit(1)).alias("n"))


def united_batches(s, d):
    """Attempts of each method as batches; snapshots that several have."""
    c = table(s, d, "candidate_results").select("snapshot_id", "method", "result_id")
    rows, repeated = ops.united("snapshot_id", *[c.where(F.col("method") == m) for m in ("conservative_dom", "readability", "trafilatura")])
    return rows.join(repeated, "snapshot_id", "left").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count("n").alias("repeated"))


def content_identities(s, d):
    """X26."""
    return ops.content_identity(tree.distinct_blocks(table(s, d, "blocks")), ["snapshot_id", "method"], ["block_order", "block_id"], "text")


def locator_diagnostics(s, d):
    """How many blocks have a place in their source, by kind."""
    m = F.col("mapping_status")
    return tree.distinct_blocks(table(s, d, "blocks")).groupBy("method", "block_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(m == "exact").alias("exact"), F.count_if(m == "normalized_match").alias("normal"), F.count_if(m == "ambiguous").alias("ambiguous"), F.count_if(m.isNull() | (m == "unavailable")).alias("without")
    )


def structure_checks(s, d):
    """H24."""
    return ops.structure_checks(tree.distinct_blocks(table(s, d, "blocks")))


def projection_disjointness(s, d):
    """M7: contents and sites that stand both in train and in the held-out splits."""
    x = table(s, d, "raw_stress").where("split IS NOT NULL AND snapshot_id IS NOT NULL").select("raw_id", "snapshot_id", (F.lower(F.trim("split")) == "train").alias("train")).distinct()
    x = x.join(table(s, d, "snapshots").select("snapshot_id", "payload_hash"), "snapshot_id").join(_once(s, d).select("raw_id", "hostname"), "raw_id")
    out = None
    for name, key in (("content", "payload_hash"), ("host", "hostname")):
        g = x.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("train").cast("int")).alias("a"), F.min(F.col("train").cast("int")).alias("b"))
        one = g.agg(F.lit(name).alias("key"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("both"))
        out = one if out is None else out.unionAll(one)
    return out


def training_manifests(s, d):
    """M9: units by block type."""
    split = table(s, d, "raw_stress").where("snapshot_id IS NOT NULL").select("snapshot_id", F.lower(F.trim("split")).alias("split")).distinct()
    u = tree.distinct_blocks(table(s, d, "blocks")).select("snapshot_id", "block_type", F.concat_ws(":", "snapshot_id", "method", "block_id").alias("unit"), F.md5("text").alias("c")).join(split, "snapshot_id")
    return ops.training_manifest(u, "block_type", "unit", "c", "split")


def provenance_faults(s, d):
    """V6: what a frozen record must have and lacks."""
    checks = {"source_file": "source_file IS NULL", "source_row": "source_row IS NULL OR source_row < 0", "address": "href IS NULL AND hostname IS NULL", "label": "citation_category IS NULL OR citation_category NOT IN ('top', 'bottom')", "late": "ingested_at < scraped_at"}
    x = table(s, d, "raw").agg(*[F.count_if(F.expr(c)).alias(k) for k, c in checks.items()])
    return x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in checks])).alias("x")).select("x.*")


def config_faults(s, d):
    """Limits and shares against their bounds."""
    a = F.col("amount")
    good = F.when(F.col("param").contains("share") | F.col("param").contains("same"), a.between(0, 1)).otherwise((a >= 1) & (a == F.floor(a)))
    return table(s, d, "run_config").select("param", "unit", good.alias("good"))


def matrix_round_trip(s, d):
    """A dense matrix written as an array column, with its ids, and read again."""
    path = f"{Scratch(s, 'matrix').base}/matrix"
    corpus.write_table(table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("row")), path)
    total = F.aggregate("row", F.lit(0.0), lambda a, v: a + v)
    return s.read.parquet(path).select("vec_id", F.size("row").cast("bigint").alias("width"), F.round(total, 4).alias("total"))


def robust_view(s, d):
    """Words, headings and blocks of each document, with unsupported headings left out."""
    b = tree.distinct_blocks(table(s, d, "blocks"))
    kept = tree.supported_headings(b)
    seen = b.where("block_type <> 'heading'").groupBy("snapshot_id", "method").agg(F.count(F.lit(1)).alias("others"), F.sum(F.length("text")).alias("chars"))
    heads = kept.groupBy("snapshot_id", "method").agg(F.count(F.lit(1)).alias("headings"))
    return seen.join(heads, ["snapshot_id", "method"], "left").select("snapshot_id", "method", "others", "chars", F.coalesce("headings", F.lit(0)).alias("headings"))


QUERIES = {
    f.__name__: f
    for f in (
        bounded_scan, table_schema, frozen_snapshots, view_units, smallest_snapshots, aligned_features, join_faults, imported_splits, common_population, overlap_rollup, attempt_resources, url_collapse, measure_quantiles,
        embedding_sizing, matched_by_prompt, extraction_accounting, validation_sample, report_queries, record_places, best_variant, latest_jobs, usage_sums, united_batches, content_identities, locator_diagnostics, structure_checks,
        projection_disjointness, training_manifests, provenance_faults, config_faults, matrix_round_trip, robust_view,
    )
}

_B = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, method, block_id ORDER BY block_uid) AS rn FROM blocks) WHERE rn = 1)"
_Q = "q AS (SELECT DISTINCT raw_id, hostname, href, category, prompt, body_words, clear_failure_union FROM quality_flags)"
_KIND = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"
ORACLE = {
    "bounded_scan": "SELECT raw_id, length(html_content) AS chars FROM raw ORDER BY source_file, source_row LIMIT 100",
    "table_schema": " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, {_KIND} AS kind FROM (DESCRIBE SELECT * FROM {t})" for t in ("raw", "snapshots", "documents", "blocks")),
    "frozen_snapshots": "SELECT payload_format, count(*) AS listed, count(*) FILTER (sha256(html_content) = payload_hash) AS verified, count(*) FILTER (html_content IS NULL) AS missing FROM snapshots LEFT JOIN raw ON raw_id = first_raw_id GROUP BY 1",
    "view_units": "SELECT subview, lang, count(*) AS n FROM (SELECT lang, block_type || CASE WHEN length(text) > 400 THEN ':chunk' ELSE '' END AS subview FROM blocks WHERE method = 'conservative_dom' AND text IS NOT NULL) WHERE starts_with(subview, 'head') AND NOT suffix(subview, ':chunk') GROUP BY 1, 2",
    "smallest_snapshots": "SELECT snapshot_id, count(*) AS n FROM blocks WHERE snapshot_id IN (SELECT DISTINCT snapshot_id FROM blocks WHERE snapshot_id IS NOT NULL ORDER BY 1 LIMIT 50) GROUP BY 1",
    "aligned_features": f"WITH {_Q}, a AS (SELECT raw_id, max(body_words) AS body_words FROM q GROUP BY 1), b AS (SELECT raw_id, length(prompt) AS prompt_chars FROM raw), c AS (SELECT raw_id, count(DISTINCT author) AS authors FROM raw_stress GROUP BY 1) SELECT raw_id, body_words, prompt_chars, authors FROM a FULL JOIN b USING (raw_id) FULL JOIN c USING (raw_id)",
    "join_faults": f"WITH {_Q}, j AS (SELECT q.*, r.href AS h2, r.hostname AS n2, r.prompt AS p2, r.citation_category AS c2 FROM q JOIN raw r USING (raw_id)) SELECT 'href' AS \"column\", count(*) AS pairs, count(*) FILTER (href IS DISTINCT FROM h2) AS differ FROM j UNION ALL SELECT 'hostname', count(*), count(*) FILTER (hostname IS DISTINCT FROM n2) FROM j UNION ALL SELECT 'prompt', count(*), count(*) FILTER (prompt IS DISTINCT FROM p2) FROM j UNION ALL SELECT 'category', count(*), count(*) FILTER (category IS DISTINCT FROM c2) FROM j",
    "imported_splits": "SELECT split, count(*) AS n, count(first_raw_id) AS known, count(*) FILTER (first_raw_id = raw_id) AS first FROM (SELECT DISTINCT * FROM raw_stress) LEFT JOIN snapshots USING (snapshot_id) GROUP BY 1",
    "common_population": f"WITH {_Q}, p AS (SELECT raw_id, min(split) AS split FROM raw_stress GROUP BY 1) SELECT split IS NOT NULL AS common, count(*) AS n, sum(body_words)::BIGINT AS words, count(DISTINCT hostname) AS hosts FROM q LEFT JOIN p USING (raw_id) GROUP BY 1",
    "overlap_rollup": "WITH p AS (SELECT hostname, prompt, count(DISTINCT citation_category) AS labels FROM raw WHERE prompt IS NOT NULL AND hostname IS NOT NULL AND citation_category IN ('top', 'bottom') GROUP BY 1, 2), h AS (SELECT hostname, count(*) FILTER (labels > 1) AS shared, count(*) AS prompts FROM p GROUP BY 1) SELECT shared > 0 AS has_shared, count(*) AS hosts, sum(shared)::BIGINT AS shared, sum(prompts)::BIGINT AS prompts FROM h GROUP BY 1",
    "attempt_resources": "SELECT method, count(*) FILTER (status = 'ok') AS true_n, count(*) FILTER (status IN ('error', 'timeout')) AS false_n, count(*) FILTER (status IS NULL OR status NOT IN ('ok', 'error', 'timeout')) AS unknown_n, count(text) AS measured, sum(ceil(strlen(text) / 4))::BIGINT AS tokens, max(ceil(strlen(text) / 4))::BIGINT AS most FROM candidate_results GROUP BY 1",
    "url_collapse": f"WITH {_Q}, x AS (SELECT href AS url, prompt, snapshot_id, arg_max(body_words::DOUBLE, raw_id) AS v FROM q JOIN (SELECT DISTINCT raw_id, snapshot_id FROM raw_stress WHERE snapshot_id IS NOT NULL) USING (raw_id) WHERE href IS NOT NULL GROUP BY 1, 2, 3), y AS (SELECT url, prompt, avg(v) AS v FROM x GROUP BY 1, 2) SELECT url, count(v) AS queries, round(avg(v), 6) AS mean FROM y GROUP BY 1",
    "measure_quantiles": "WITH x AS (SELECT 'runtime_ms' AS measure, runtime_ms AS v FROM candidate_results UNION ALL SELECT 'chars', length(text)::DOUBLE FROM candidate_results UNION ALL SELECT 'n_blocks', len(blocks)::DOUBLE FROM candidate_results) SELECT measure, count(*) AS rows, count(v) AS present, round(min(v), 6) AS least, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS most FROM x GROUP BY 1",
    "embedding_sizing": "WITH u AS (SELECT 'document' AS role, text FROM blocks UNION ALL SELECT 'query', prompt FROM raw), o AS (SELECT role, text, count(*) AS n FROM u WHERE text IS NOT NULL GROUP BY 1, 2), g AS (SELECT role, sum(n)::BIGINT AS units, count(*) AS requests, sum(strlen(text))::BIGINT AS bytes, sum(ceil(strlen(text) / 4))::BIGINT AS tokens FROM o GROUP BY 1) SELECT *, ceil(requests / 128)::BIGINT AS batches, requests * 3072 * 4 AS vector_bytes, round(tokens * 0.13 / 1e6, 6) AS cost FROM g",
    "matched_by_prompt": f"WITH {_Q}, r AS (SELECT * FROM q WHERE prompt IS NOT NULL AND category IN ('top', 'bottom')), g AS (SELECT 'prompt' AS \"grouping\", count(*) AS n, count(DISTINCT category) AS labels FROM r GROUP BY prompt UNION ALL SELECT 'prompt and site', count(*), count(DISTINCT category) FROM r GROUP BY prompt, hostname) SELECT \"grouping\", count(*) AS groups, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (labels > 1) AS mixed, coalesce(sum(n) FILTER (labels > 1), 0)::BIGINT AS mixed_rows FROM g GROUP BY 1",
    "extraction_accounting": f"WITH {_Q}, w AS (SELECT raw_id, max(body_words) AS w FROM q GROUP BY 1), r AS (SELECT raw.*, md5(html_content) AS h, w FROM raw LEFT JOIN w USING (raw_id) WHERE href IS NOT NULL), p AS (SELECT count(*) AS n, count(DISTINCT citation_category) AS labels, count(DISTINCT h) AS payloads, max(w) AS w FROM r GROUP BY hostname, href) SELECT count(*) AS pages, sum(n - 1)::BIGINT AS collapsed, count(*) FILTER (labels > 1) AS conflicting, count(*) FILTER (payloads > 1) AS several_payloads, count(*) FILTER (w = 0) AS without_words, (SELECT count(*) FROM (SELECT h FROM r WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT href) > 1)) AS shared_payloads FROM p",
    "validation_sample": "SELECT split, record_id FROM (SELECT split, record_id, row_number() OVER (PARTITION BY split ORDER BY record_id) AS r FROM (SELECT DISTINCT split, record_id FROM raw_stress WHERE split IS NOT NULL)) WHERE r <= 10",
    "report_queries": r"WITH x AS (SELECT hostname, lower(trim(regexp_replace(prompt, '[\s\p{Z}]+', ' ', 'g'))) AS prompt, min(raw_id) AS raw_id FROM raw WHERE prompt IS NOT NULL AND hostname IS NOT NULL GROUP BY 1, 2) SELECT hostname, raw_id, row_number() OVER (PARTITION BY hostname ORDER BY prompt, raw_id) AS place FROM x WHERE prompt <> ''",
    "record_places": "SELECT raw_id, row_number() OVER (PARTITION BY source_file ORDER BY source_row) AS place FROM raw",
    "best_variant": "WITH l AS (SELECT l_linestatus, (l_returnflag = 'R')::DOUBLE AS y, 0.05 AS a, 0.05 + l_discount * 3 AS b, 0.05 + l_discount * 3 + l_tax * 2 AS c FROM lineitem), g AS (SELECT l_linestatus, round(avg(-(y * ln(a) + (1 - y) * ln(1 - a))), 6) AS one, round(avg(-(y * ln(b) + (1 - y) * ln(1 - b))), 6) AS two, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS three FROM l GROUP BY 1) SELECT l_linestatus, CASE least(one, two, three) WHEN one THEN 'one' WHEN three THEN 'three' ELSE 'two' END AS variant, least(one, two, three) AS loss FROM g",
    "latest_jobs": "SELECT event_type, event_id, r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5",
    "usage_sums": "SELECT event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS used, count(props ->> '$.k') AS told, count(*) AS n FROM events GROUP BY 1",
    "united_batches": "WITH c AS (SELECT snapshot_id, list_position(['conservative_dom', 'readability', 'trafilatura'], method) - 1 AS batch FROM candidate_results WHERE method IN ('conservative_dom', 'readability', 'trafilatura')) SELECT batch, count(*) AS n, count(*) FILTER (snapshot_id IN (SELECT snapshot_id FROM c GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM c GROUP BY 1",
    "content_identities": f"WITH {_B} SELECT snapshot_id, method, sha256(coalesce(string_agg(sha256(text), ',' ORDER BY block_order, block_id) FILTER (text IS NOT NULL), '')) AS identity FROM b GROUP BY 1, 2",
    "locator_diagnostics": f"WITH {_B} SELECT method, block_type, count(*) AS n, count(*) FILTER (mapping_status = 'exact') AS exact, count(*) FILTER (mapping_status = 'normalized_match') AS normal, count(*) FILTER (mapping_status = 'ambiguous') AS ambiguous, count(*) FILTER (mapping_status IS NULL OR mapping_status = 'unavailable') AS without FROM b GROUP BY 1, 2",
    "structure_checks": f"WITH {_B} SELECT b.snapshot_id, b.method, bool_or(b.block_type = 'heading') AS heading, bool_or(b.block_type = 'code') AS code, coalesce(bool_or(b.block_type IN ('list', 'list_item') AND p.block_type IN ('list', 'list_item')), false) AS nested_list, bool_or(b.block_type = 'table') AS \"table\", max(b.block_order) - min(b.block_order) + 1 = count(*) AND count(DISTINCT b.block_order) = count(*) AS ordered FROM b LEFT JOIN b p ON p.snapshot_id = b.snapshot_id AND p.method = b.method AND p.block_id = b.parent_id GROUP BY 1, 2",
    "projection_disjointness": f"WITH {_Q}, x AS (SELECT DISTINCT r.raw_id, payload_hash, hostname, lower(trim(split)) = 'train' AS train FROM raw_stress r JOIN (SELECT snapshot_id, payload_hash FROM snapshots) USING (snapshot_id) JOIN (SELECT raw_id, hostname FROM q) USING (raw_id) WHERE split IS NOT NULL), a AS (SELECT 'content' AS key, bool_or(train) <> bool_and(train) AS mixed FROM x WHERE payload_hash IS NOT NULL GROUP BY payload_hash UNION ALL SELECT 'host', bool_or(train) <> bool_and(train) FROM x WHERE hostname IS NOT NULL GROUP BY hostname) SELECT key, count(*) AS n, count(*) FILTER (mixed) AS both FROM a GROUP BY 1",
    "training_manifests": f"WITH {_B}, p AS (SELECT DISTINCT snapshot_id, lower(trim(split)) AS split FROM raw_stress WHERE snapshot_id IS NOT NULL), u AS (SELECT block_type, snapshot_id || ':' || method || ':' || block_id AS unit, min(md5(text)) AS c, bool_or(split IS NULL OR split <> 'train') AS out FROM b JOIN p USING (snapshot_id) WHERE text IS NOT NULL GROUP BY 1, 2), k AS (SELECT block_type, c, count(*) AS n, count(*) FILTER (out) AS outs FROM u GROUP BY 1, 2), g AS (SELECT block_type, sum(n)::BIGINT AS eligible, sum(outs)::BIGINT AS held_out, coalesce(sum(n - outs) FILTER (outs > 0), 0)::BIGINT AS repeated FROM k GROUP BY 1) SELECT *, eligible - held_out - repeated AS train, eligible - held_out - repeated >= 33 AS enough FROM g",
    "provenance_faults": "SELECT 'source_file' AS fault, count(*) FILTER (source_file IS NULL) AS n FROM raw UNION ALL SELECT 'source_row', count(*) FILTER (source_row IS NULL OR source_row < 0) FROM raw UNION ALL SELECT 'address', count(*) FILTER (href IS NULL AND hostname IS NULL) FROM raw UNION ALL SELECT 'label', count(*) FILTER (citation_category IS NULL OR citation_category NOT IN ('top', 'bottom')) FROM raw UNION ALL SELECT 'late', count(*) FILTER (ingested_at < scraped_at) FROM raw",
    "matrix_round_trip": "SELECT vec_id, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "config_faults": "SELECT param, unit, CASE WHEN contains(param, 'share') OR contains(param, 'same') THEN amount BETWEEN 0 AND 1 ELSE amount >= 1 AND amount = floor(amount) END AS good FROM run_config",
}
