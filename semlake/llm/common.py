"""What the operators of this subpackage share: shared tables, words, hashes and links."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's, or one of our own on a local master that names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="semlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/semlake/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.shared_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now instead of at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows, as single texts may be very long; also sees that workers have the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session, unless their path has it already."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_semlake_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="semlake-")) / "semlake.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "semlake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._semlake_shipped = True


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Remembered(dict):
    """A dict that works out missing values by `make` and starts afresh at `most` entries."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, comp) with the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014); every round is one written table, so nothing
    is gathered on the driver but two counters. The number of rounds grows with the logarithm of the longest path.
    """
    e = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    digest = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = digest(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("shuffle_merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, e = e, written(spark, small.where("u <> v").distinct(), "edges")
        discard(before)
        now = digest(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v"))).distinct()
