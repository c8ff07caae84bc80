"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and bytes of text that are Python objects at once; Spark's own batches hold up to 64 MB.
PART_ROWS = 500
PART_BYTES = 4 << 20
#: Keys with more rows than this may be hot; so many of the hottest are dealt out over so many salts.
HOT_ROWS = 1000
HOT_KEYS = 10_000
SALTS = 64

_local: dict[str, str] = {}
_made: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none: in local mode a folder of our own, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="corpus-scratch-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that settle() writes within are deleted at the end: only for steps whose result is written before."""
    _made.append([])
    try:
        yield
    finally:
        discard(spark, _made.pop())


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], *, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with a column text, cut (without copying) into parts of bounded rows and bytes; a longer text is a part of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        start = 0
        while start < len(upto):
            before = int(upto[start - 1]) if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined to one, which holds few rows a key, by keys; rows of many with a hot key are dealt out over several tasks.

    Only the HOT_KEYS most frequent keys are broadcast, so any other key has at most a HOT_KEYS-th of all rows.
    """
    hot = many.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).orderBy(F.desc("count")).limit(HOT_KEYS).select(*keys, F.lit(True).alias("is_hot"))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).drop("is_hot")
    right = one.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(salts)).drop("is_hot")
    return left.join(right, [*keys, "salt"], how).drop("salt")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def held_out(id_: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, id_col: str, text_col: str, learn_from: Column, most: int) -> DataFrame:
    """doc_id, text, y, weight of about most documents of either class, chosen by a hash of the id.

    learn_from, over labels, says which rows may be learned from. weight brings the classes back to their shares
    among all rows that may be learned from. A document with several labels has the highest.
    """
    own = labels.where(learn_from).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}  # two rows
    share = F.when(F.col("y") == 1, most / max(most, counts.get(1, 0))).otherwise(most / max(most, counts.get(0, 0)))
    # The share bounds the sample, and so what is broadcast: some 20 bytes for each of about 2 * most rows.
    picked = own.withColumn("weight", 1 / share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
