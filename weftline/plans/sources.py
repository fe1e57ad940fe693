"""Queries on sources, sinks, provenance, integrity and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import vectors
from weftline.session import Scratch, scratch_root, table
from weftline.sources import corpus
from weftline.streaming import ingest


def provenance(s, d):
    """Rows with their place in the file."""
    r = s.read.parquet(f"{d}/raw.parquet").select("raw_id", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_name", "row_index").alias("places"))


def source_keys(s, d):
    """Raw rows named by file and row of the bottom label, looked up by key."""
    r = table(s, d, "raw").withColumnsRenamed({"source_file": "file_name", "source_row": "row_index"})
    keys = r.where("citation_category = 'bottom'").select("file_name", "row_index")
    return corpus.lookup_rows(r, keys).select("raw_id", "file_name", "row_index")


def footers(s, d):
    """S7."""
    files = [r[0].removeprefix("file://") for r in table(s, d, "raw").select("_metadata.file_path").distinct().collect()]
    return corpus.parquet_footers(s, files).groupBy("column").agg(F.sum("values").alias("n"), F.sum("nulls").alias("nulls"), F.countDistinct("codec").alias("codecs"))


def ndjson_round_trip(s, d):
    """Snapshots written as gzip NDJSON and read again."""
    path = f"{Scratch(s, 'json').base}/snapshots"
    df = table(s, d, "snapshots")
    corpus.write_ndjson(df, path, gzip=True)
    back = corpus.read_ndjson(s, path, df.schema)
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snapshot_id").alias("ids"), F.count("href").alias("with_href"))


def csv_round_trip(s, d):
    """Block texts through CSV."""
    path = f"{Scratch(s, 'csv').base}/blocks"
    table(s, d, "blocks").select("block_uid", "text").where("text IS NOT NULL AND text <> ''").write.csv(path, header=True, quoteAll=True, escape='"')
    return corpus.read_csv(s, path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block_uid").alias("ids"))


def parquet_round_trip(s, d):
    """Flags written and compared null-safely, column by column."""
    path = f"{Scratch(s, 'parquet').base}/flags"
    df = table(s, d, "quality_flags").distinct()
    corpus.write_table(df, path)
    back = s.read.parquet(path)
    same = F.lit(True)
    a, b = df.alias("a"), back.alias("b")
    for c in df.columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = a.join(b, F.col("a.raw_id") == F.col("b.raw_id"), "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("mismatches"))


def vector_store(s, d):
    """Embeddings appended twice are stored once, and none is damaged."""
    store = corpus.VectorStore(s, f"{Scratch(s, 'vectors').base}/store")
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("request_key"), F.concat(F.lit("m"), F.col("label") % 3).alias("model"), "embedding", F.lit("success").alias("status"))
    store.append(e)
    store.append(e)
    damaged = store.damaged().count()
    return vectors.cache_status(store.read()).select("model", "vectors", "failed", F.col("width").cast("bigint").alias("width"), F.lit(damaged).cast("bigint").alias("damaged"))


def resume_pending(s, d):
    """Snapshots that no candidate result covers yet."""
    return corpus.pending(table(s, d, "snapshots").select("snapshot_id"), table(s, d, "candidate_results"), "snapshot_id")


def lineage(s, d):
    """From record to snapshot to blocks and candidates, with counts at each step."""
    b = table(s, d, "blocks").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    c = table(s, d, "candidate_results").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_results"))
    r = table(s, d, "raw_stress").select("raw_id", "snapshot_id").distinct()
    return r.join(b, "snapshot_id", "left").join(c, "snapshot_id", "left").select("raw_id", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_results", F.lit(0)).alias("n_results"))


def stream_snapshots(s, d):
    """Incremental ingestion of raw files: each payload and address once."""
    import shutil

    base = Scratch(s, "stream").base
    raw = table(s, d, "raw")
    raw.select("href", "html_content", "scraped_at").repartition(4).write.parquet(f"{base}/in")
    q = ingest.run_available(ingest.new_snapshots(ingest.raw_stream(s, f"{base}/in", s.read.parquet(f"{base}/in").schema, 2), "3650 days"), f"{base}/out", f"{base}/state")
    q.awaitTermination()
    if scratch_root(s).startswith("/"):
        shutil.rmtree(f"{base}/state", ignore_errors=True)
    return s.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snapshot_id").alias("ids"))


def arrivals(s, d):
    """The windowed counts of the stream, over the table at rest."""
    return ingest.arrivals(table(s, d, "raw"))


QUERIES = {
    f.__name__: f
    for f in (provenance, source_keys, footers, ndjson_round_trip, csv_round_trip, parquet_round_trip, vector_store, resume_pending, lineage, stream_snapshots, arrivals)
}
ORACLE = {
    "provenance": "SELECT count(*) AS n, count(*) AS places FROM raw",
    "source_keys": "SELECT raw_id, source_file AS file_name, source_row AS row_index FROM raw WHERE (source_file, source_row) IN (SELECT (source_file, source_row) FROM raw WHERE citation_category = 'bottom')",
    "ndjson_round_trip": "SELECT count(*) AS n, count(DISTINCT snapshot_id) AS ids, count(href) AS with_href FROM snapshots",
    "csv_round_trip": "SELECT count(*) AS n, count(DISTINCT block_uid) AS ids FROM blocks WHERE text IS NOT NULL AND text <> ''",
    "parquet_round_trip": "SELECT count(*) AS n, 0 AS mismatches FROM (SELECT DISTINCT * FROM quality_flags)",
    "vector_store": "SELECT 'm' || (label % 3) AS model, count(*) AS vectors, 0 AS failed, max(len(embedding)) AS width, 0 AS damaged FROM embeddings GROUP BY 1",
    "resume_pending": "SELECT snapshot_id FROM snapshots WHERE snapshot_id NOT IN (SELECT snapshot_id FROM candidate_results)",
    "lineage": "SELECT raw_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_results, 0) AS n_results FROM (SELECT DISTINCT raw_id, snapshot_id FROM raw_stress WHERE snapshot_id IS NOT NULL) LEFT JOIN (SELECT snapshot_id, count(*) AS n_blocks FROM blocks GROUP BY 1) USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, count(*) AS n_results FROM candidate_results GROUP BY 1) USING (snapshot_id) UNION ALL SELECT raw_id, 0, 0 FROM (SELECT DISTINCT raw_id FROM raw_stress WHERE snapshot_id IS NULL)",
    "stream_snapshots": "SELECT count(*) AS n, count(*) AS ids FROM (SELECT DISTINCT html_content, href FROM raw WHERE html_content IS NOT NULL)",
    "arrivals": "SELECT date_trunc('day', scraped_at) AS start, lower(trim(citation_category)) AS category, count(*) AS n, sum((epoch(date_trunc('second', ingested_at)) - epoch(date_trunc('second', scraped_at)) > 86400)::INT)::BIGINT AS late FROM raw GROUP BY 1, 2",
}
