"""Vectors: similarity, nearest neighbours, pooling, alignment of queries and sections, principal components, a content-addressed cache."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of arrays; null if an element is null or the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector, a null or different lengths."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


QUERY_BLOCK = 2_000  # query vectors that go round together; at 3,072 floats 25 MB


def nearest(spark: SparkSession, queries: DataFrame, rows: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, rank, similarity): for each query its k nearest rows by cosine, itself left out, ties by vec_id. Exact.

    Queries go round in blocks of bounded size; each task keeps the k best of its own rows for each query, so
    what is shuffled is k rows a query and task. Vectors that are null, zero or of another length than the
    query are no neighbours.
    """
    out: DataFrame | None = None
    total = queries.count()
    numbered = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-total // block)))).alias("part"))
    for part in range(max(1, -(-total // block))):
        held = numbered.where(F.col("part") == part).select("vec_id", "embedding").toPandas().dropna()
        if held.empty:
            continue
        ids = held["vec_id"].to_numpy(np.int64)
        matrix = np.array([np.asarray(v, np.float64) for v in held["embedding"]])
        found = rows.select("vec_id", "embedding").mapInArrow(_best_of_task(ids, matrix, k), "query_id BIGINT, vec_id BIGINT, similarity DOUBLE")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id BIGINT, vec_id BIGINT, rank INT, similarity DOUBLE")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")


def _best_of_task(ids: np.ndarray, matrix: np.ndarray, k: int):
    lengths = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(lengths > 0, lengths, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_score = np.full((len(ids), 0), -np.inf)
        best_id = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            pairs = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1)) if i is not None and v.is_valid and len(v.values) == unit.shape[1] and v.values.null_count == 0]
            if not pairs:
                continue
            at = np.array([i for i, _ in pairs], np.int64)
            x = np.array([v.values.to_numpy(zero_copy_only=False) for _, v in pairs], np.float64)
            n = np.linalg.norm(x, axis=1)
            at, x, n = at[n > 0], x[n > 0], n[n > 0]
            scores = np.round(unit @ (x / n[:, None]).T, 12)
            scores[ids[:, None] == at[None, :]] = -np.inf
            scores[lengths == 0] = -np.inf
            score = np.hstack([best_score, scores])
            who = np.hstack([best_id, np.broadcast_to(at, scores.shape)])
            order = np.lexsort((who, -score), axis=1)[:, :k]
            best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
        live = np.isfinite(best_score)
        rows = np.nonzero(live)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[0]], pa.int64()), pa.array(best_id[live], pa.int64()), pa.array(best_score[live], pa.float64())], names=["query_id", "vec_id", "similarity"])

    return run


def weighted_pool(members: DataFrame, unit: str, vector: str, weight: str) -> DataFrame:
    """(unit, embedding): the sum of unit vectors times their weights, brought to length 1; zero vectors and null weights add nothing."""
    m = members.withColumn("len", norm(F.col(vector))).where(F.col("len") > 0)
    dims = m.select(unit, F.col(weight).alias("w"), "len", F.posexplode(vector).alias("i", "x")).groupBy(unit, "i").agg(F.sum(F.col("w") * F.col("x") / F.col("len")).alias("x"))
    lengths = dims.groupBy(unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return dims.join(lengths, unit).where("len > 0").groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("len")).alias("x")))), lambda s: s["x"]).alias("embedding"))


def section_summary(scores: DataFrame, record: str, section: str, score: str) -> DataFrame:
    """Per record: best, mean of the best three, median, quartiles, scored sections, and the ids of the best three (ties by id)."""
    s = scores.where(F.col(score).isNotNull())
    ranked = s.withColumn("r", F.row_number().over(W.partitionBy(record).orderBy(F.desc(score), section)))
    q = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = ranked.groupBy(record).agg(
        F.max(score).alias("best"), F.avg(F.when(F.col("r") <= 3, F.col(score))).alias("top3"), q.alias("q"), F.count(F.lit(1)).alias("n"), F.countDistinct(section).alias("sections"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", section)))).alias("b"),
    )
    return g.select(record, F.round("best", 6).alias("best"), F.round("top3", 6).alias("top3"), F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q75"), "n", "sections", F.concat_ws(",", F.transform("b", lambda x: x[section].cast("string"))).alias("best_sections"))


def column_means(df: DataFrame, vector: str) -> DataFrame:
    """(i, mean, deviation): mean and population deviation of each dimension."""
    return df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


class PrincipalComponents:
    """Components of centred vectors, from one pass of sums; signs are fixed by the largest loading. Nulls take no part."""

    def __init__(self, df: DataFrame, vector: str, count: int) -> None:
        size = df.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).collect()[0][0] or 0

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, outer, n = np.zeros(size), np.zeros((size, size)), 0
            for batch in batches:
                vs = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(0) if v.is_valid and len(v.values) == size]
                if vs:
                    x = np.array(vs, np.float64)
                    total, outer, n = total + x.sum(0), outer + x.T @ x, n + len(x)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([outer.ravel().tolist()])], names=["n", "total", "outer"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, outer, n = np.zeros(size), np.zeros(size * size), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    n += batch.column(0)[i].as_py()
                    total += batch.column(1)[i].values.to_numpy()
                    outer += batch.column(2)[i].values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64())), pa.array([outer], pa.list_(pa.float64()))], names=["n", "total", "outer"])

        ddl = "n BIGINT, total ARRAY<DOUBLE>, outer ARRAY<DOUBLE>"
        tasks = df.select(vector).mapInArrow(sums, ddl)
        # Matrices of the tasks are added on the executors, in as many groups as the root of their number, before the driver sees them.
        groups = max(1, math.isqrt(df.rdd.getNumPartitions()))
        parts = tasks.repartition(groups).mapInArrow(merged, ddl).toLocalIterator()
        n, total, outer = 0, np.zeros(size), np.zeros(size * size)
        for p in parts:  # one matrix a group, one at a time
            n, total, outer = n + p["n"], total + np.array(p["total"]), outer + np.array(p["outer"])
        self.mean = total / max(1, n)
        cov = outer.reshape(size, size) / max(1, n) - np.outer(self.mean, self.mean)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[:count]
        self.explained = values[order] / max(values.sum(), 1e-300)
        axes = vectors[:, order]
        self.axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    def apply(self, df: DataFrame, vector: str, out: str = "projection") -> DataFrame:
        mean, axes = self.mean, self.axes

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None or len(x) != len(mean) else ((np.asarray(x, float) - mean) @ axes).tolist())

        return df.withColumn(out, project(vector))


def fake_embedding(text: str, role: str = "document", size: int = 8) -> list[float]:
    """A deterministic stand-in for an embedding service: a unit vector seeded by the text."""
    seed = int.from_bytes(hashlib.sha256((role + text).encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(size)
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def embed_pending(units: DataFrame, cache: DataFrame | None, model: str, embed=fake_embedding, batch: int = 128, ceiling: int = 200_000) -> DataFrame:
    """(request_key, model, embedding, status) for texts not in the cache yet; equal texts of one role are asked once.

    Requests go out in batches of at most `batch` texts and `ceiling` bytes; a text above the ceiling and a
    failure of the provider give the status failed and no vector. `embed` takes (text, role).
    """
    key = F.sha2(F.to_json(F.array(F.lit(model), F.col("role"), F.col("text"))), 256)
    asked = units.where("text IS NOT NULL").select(key.alias("request_key"), "role", "text").dropDuplicates(["request_key"])
    if cache is not None:
        asked = asked.join(cache.where(F.col("model") == model).select("request_key"), "request_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, group, used = b.to_pylist(), [], 0
            groups = []
            for r in rows:
                n = len(r["text"].encode())
                if group and (len(group) >= batch or used + n > ceiling):
                    groups.append(group)
                    group, used = [], 0
                group.append((r, n))
                used += n
            groups += [group] if group else []
            out = []
            for g in groups:
                for r, n in g:
                    try:
                        vector = embed(r["text"], r["role"]) if n <= ceiling else None
                    except Exception:  # the provider's fault is a status, not a failed job
                        vector = None
                    out.append((r["request_key"], model, vector, "success" if vector is not None else "failed"))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.float32())), pa.array(cols[3], pa.string())], names=["request_key", "model", "embedding", "status"])

    return asked.mapInArrow(run, "request_key STRING, model STRING, embedding ARRAY<FLOAT>, status STRING")


def cache_status(cache: DataFrame) -> DataFrame:
    """(model, vectors, failed, width) of a cache table."""
    return cache.groupBy("model").agg(F.count_if(F.col("status") == "success").alias("vectors"), F.count_if(F.col("status") != "success").alias("failed"), F.max(F.size("embedding")).alias("width"))
