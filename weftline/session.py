"""Sessions, tables and scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests, the bench and the command line; on a cluster the caller's own session is used.

    Its checkpoint folder is a temporary one, as its executors are on this machine too.
    """
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("weftline")
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weftline-"))
    return builder.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark application, so that no path need be set on them.

    The archive is written by the driver and served by Spark; no task writes it or reads it from a local path.
    """
    context = spark.sparkContext
    if getattr(ship_package, "done", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    ship_package.done = context.applicationId


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def setting(spark: SparkSession, folder: str, name: str) -> float:
    """One limit of the fixed table run_config."""
    rows = table(spark, folder, "run_config").where(f"param = '{name}'").select("amount").collect()
    if not rows:
        raise KeyError(f"run_config has no {name}")
    return float(rows[0][0])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage that spark.checkpoint.dir names. Where it is unset, a session on one machine gets a folder of our own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weftline-"))
    return spark.conf.get("spark.checkpoint.dir")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch, where rows are whole payloads; a setting other than Spark's default is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def hash_joins(spark: SparkSession, most: str = "64MB") -> None:
    """Joins whose one side is small in every partition, as measured at run time, need no sort; a setting other than Spark's default is left alone."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name, "0") in ("0", "0b"):
        spark.conf.set(name, most)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, where it has at most half as many partitions as there are cores.

    A large table has partitions enough and stays where it is; so does anything that isn't a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this process. Results that weren't written yet can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written in the shared folder to cut lineage; a lost executor costs nothing that is already written.

    They stay until `drop` or `clear_scratch`, as the results of operators read them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/weftline/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _SCRATCH.append(self.base)

    def put(self, df: DataFrame) -> DataFrame:
        """Writes a table and returns it as read from there."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
