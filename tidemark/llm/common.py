"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``.  Only where that is unset (tests on
    one machine) a folder is made and the setting is filled in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table outlives any executor, so a retry starts here and not at the input.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` made and nobody reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done; it does so when the driver's JVM collects what stands for them."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    sc.addPyFile(name)
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int):
    """crc32 of the id's text modulo ``parts``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, where, most: dict[int, int], seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``most[y]`` labelled documents of each class, and the classes' sizes among the labels.

    The rows with the smallest hashes of their ids are drawn, so the bound is a
    hard one.  Of texts that share an id the smallest is taken; null ids and
    labels other than 0 and 1 are left out; a null text counts as empty.
    """
    known = labels.where(where & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n) for y, n in most.items()]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # as many rows as ``most`` says
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cut(texts.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))), sizes
