"""A corpus pipeline: quality, near-duplicates, benchmark passages, source mix, token files.

Each stage takes (spark, docs, sf_dir); all but the last give back the columns of documents. Rows are told apart by
their id and a hash of the whole row, so null and repeated ids do no harm; exact repeated rows are near-duplicates
of each other. Copies that the mix takes are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontam, mixing, quality, simhash, tokenfile
from cairn.llm.common import discard, held_out, passing, scratch, settle
from cairn.llm.queries import END_ID, GOOD_FROM, table, vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def row_key(docs: DataFrame) -> Column:
    """Orders as doc_id does, nulls last; equal for equal rows only.

    The type is that of a key read back from a table, so that both are dealt out alike and texts are shuffled once.
    """
    own = F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), own, F.xxhash64(*docs.columns).alias("row")).cast("struct<unnamed:boolean,id:bigint,row:bigint>")


def each_once(keyed: DataFrame) -> DataFrame:
    """One row for each row_key, since exact repeated rows share it; they are brought together before the shuffle."""
    return keyed.groupBy("row_key").agg(*(F.first(c).alias(c) for c in keyed.columns if c != "row_key"))


def others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def given_back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field rejects go."""
    field = quality.train(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(F.col("doc_id"), 5, 0))
    scored = quality.score(docs, field, keep=others(docs))
    return given_back(scored.where(F.col("score") >= GOOD_FROM), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the first document stays."""
    keyed = docs.withColumn("row_key", row_key(docs))
    groups = simhash.near_duplicates(keyed, id_col="row_key")
    first = groups.where(F.col("row_key") == F.col("component_id")).select("row_key").distinct()
    return each_once(keyed).join(settle(first, "first-of-group"), "row_key", "left_semi").select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated go."""
    hits = decontam.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep=others(docs))
    return given_back(decontam.judge(hits).where("not contaminated"), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    keyed = docs.withColumn("row_key", row_key(docs))
    taken = settle(mixing.mix_sources(keyed, id_col="row_key").where("copies > 0").select("row_key", "copies"), "copies")
    # Repeated rows share a key: each gets its own number of copies, in any order.
    totals = taken.groupBy("row_key").agg(F.sum("copies").cast("int").alias("copies"))
    return each_once(keyed).join(totals, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in the order of doc_id, and where each document lies in them."""
    return tokenfile.tokenized(docs, vocabulary_path(), end_id=END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

#: Fitted scores, seeded hashes and token ids are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; tables that nothing reads any more are deleted on the way."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, done)
        docs, done = spark.read.parquet(path), [path]
    out = STAGES[-1][1](spark, docs, sf_dir)  # its files are written by now
    discard(spark, done)
    return out
