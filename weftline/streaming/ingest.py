"""Incremental ingestion: new files are read once, snapshots are kept once, late rows are counted in their window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def raw_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_snapshots(stream: DataFrame, delay: str = "14 days") -> DataFrame:
    """(snapshot_id, payload_hash, href, scraped_at): each payload and address once while its state lasts; rows later than `delay` are left to the batch run."""
    payload = F.sha2("html_content", 256)
    rows = stream.where("html_content IS NOT NULL").select(F.sha2(F.to_json(F.array(payload, F.col("href"))), 256).alias("snapshot_id"), payload.alias("payload_hash"), "href", F.col("scraped_at").cast("timestamp").alias("scraped_at"))
    return rows.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["snapshot_id"])


def arrivals(stream: DataFrame, delay: str = "14 days", width: str = "1 day") -> DataFrame:
    """(start, category, n, late): rows for each day of scraping and label, and how many came more than a day after."""
    late = (F.unix_timestamp("ingested_at") - F.unix_timestamp("scraped_at") > 86400).cast("int")
    w = F.window("scraped_at", width)
    g = stream.withColumn("scraped_at", F.col("scraped_at").cast("timestamp")).withWatermark("scraped_at", delay).groupBy(w, F.lower(F.trim("citation_category")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(late).alias("late"))
    return g.select(F.col("window.start").alias("start"), "category", "n", "late")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there now and stops; run again, it takes up where it ended."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
