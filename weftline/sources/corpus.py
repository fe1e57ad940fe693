"""Reading and writing corpora: strict schemas, provenance, Parquet footers, NDJSON, CSV, gzip JSON, vector tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The five columns of a citation corpus.
CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in ("prompt", "citation_category", "href", "hostname", "html_content")])
#: Chunks at rest, for files without rows as well.
CHUNKS = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "snapshot_id", "method", "text")] + [T.StructField("chunk", T.IntegerType()), T.StructField("characters", T.IntegerType())])


def check_schema(df: DataFrame, expected: T.StructType) -> None:
    """Raises unless names and types are those expected, in order; nullability doesn't count."""
    found, wanted = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in expected]
    if found != wanted:
        raise ValueError(f"schema differs: {sorted(set(map(str, found)) ^ set(map(str, wanted)))}")


def read_corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A corpus with where each row stands: file_name and zero-based row_index. Payloads are read only if selected."""
    df = spark.read.parquet(path)
    if strict:
        check_schema(df, CORPUS)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def lookup_rows(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows at (file_name, row_index) of `keys`."""
    return corpus.join(keys.select("file_name", "row_index").distinct(), ["file_name", "row_index"], "left_semi")


_FOOTER = "path STRING, column STRING, row_group INT, codec STRING, encodings STRING, nulls BIGINT, values BIGINT, compressed BIGINT, uncompressed BIGINT, rows BIGINT, creator STRING"


def parquet_footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each column chunk of the files, read from their footers alone. Paths must be readable by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with pq.ParquetFile(path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path) as f:
                    meta = f.metadata
                    rows = []
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            col = group.column(c)
                            nulls = col.statistics.null_count if col.statistics and col.statistics.has_null_count else None
                            rows.append((path, col.path_in_schema, g, col.compression, ",".join(sorted(col.encodings)), nulls, col.num_values, col.total_compressed_size, col.total_uncompressed_size, group.num_rows, meta.created_by))
                cols = list(zip(*rows)) if rows else [[]] * 11
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _FOOTER.split(", ")])

    files = spark.createDataFrame([(p,) for p in paths], "path STRING").repartition(max(1, min(len(paths), 200)))
    return files.mapInArrow(run, _FOOTER)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """NDJSON, plain or gzip, with a schema of its own; lines that can't be read give nulls in `_corrupt`."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text, quoted line ends allowed."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', maxCharsPerColumn=-1)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet with zstd, never over what is there; an empty table keeps its schema."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_ndjson(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("errorifexists")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def pending(keys: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return keys if done is None else keys.join(done.select(key), key, "left_anti")


class VectorStore:
    """Vectors by model in a partitioned table; a key is written once, checked by a hash of its content."""

    SCHEMA = "request_key STRING, embedding ARRAY<FLOAT>, status STRING, checksum STRING, model STRING"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing has been written yet
            return None

    def append(self, vectors: DataFrame) -> None:
        """Adds what isn't there yet; `vectors` has request_key, model, embedding and status."""
        have = self.read()
        new = vectors.dropDuplicates(["request_key", "model"])
        if have is not None:
            new = new.join(have.select("request_key", "model"), ["request_key", "model"], "left_anti")
        sealed = new.withColumn("checksum", F.sha2(F.to_json(F.struct("embedding")), 256))
        sealed.select("request_key", "embedding", "status", "checksum", "model").write.mode("append").partitionBy("model").option("compression", "zstd").parquet(self.path)

    def damaged(self) -> DataFrame:
        """Keys whose vector doesn't match its checksum."""
        have = self.read()
        if have is None:
            return self.spark.createDataFrame([], "request_key STRING")
        return have.where(F.sha2(F.to_json(F.struct("embedding")), 256) != F.col("checksum")).select("request_key")


def run_identity(config: dict, code: str = "") -> str:
    """Identity of a run: a change of configuration or code gives another, and so another output folder."""
    return hashlib.sha256(json.dumps([config, code], sort_keys=True).encode()).hexdigest()[:16]


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def repeated_tail(tokens: list[int]) -> bool:
    """Whether a token list ends in three equal spans of one width from 16 to 256."""
    n = len(tokens)
    return any(3 * w <= n and tokens[n - w :] == tokens[n - 2 * w : n - w] == tokens[n - 3 * w : n - 2 * w] for w in range(16, 257))


def through_process(df: DataFrame, column: str, command: list[str], parse: Callable[[str], str | None]) -> DataFrame:
    """Sends a column's texts as JSON lines through an outside program, one process a task, and adds its parsed answers as `answer`.

    The program must answer each line with one line. A missing program gives null answers, not a failed job.
    """
    import subprocess

    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            proc = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        except OSError:
            proc = None
        for batch in batches:
            answers = []
            for text in batch.column(at).to_pylist():
                if proc is None or text is None or proc.poll() is not None:
                    answers.append(None)
                    continue
                proc.stdin.write(json.dumps(text) + "\n")
                proc.stdin.flush()
                line = proc.stdout.readline()
                answers.append(parse(line) if line else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, "answer"])
        if proc is not None:
            proc.stdin.close()
            proc.wait(timeout=30)

    return df.mapInArrow(run, schema)
