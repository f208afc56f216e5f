"""A corpus pipeline of the llm operators: STAGES over documents, each written as Parquet and read again.

toxicity drops documents that the learned score rejects; minhash_near_dedup keeps one document of each group;
substring_dedup takes passages of 50 words and more that stand in several places out of the texts; decontamination
drops documents that hold benchmark items; bpe adds token counts and ids. All but the last return the columns of documents.

Rows are decided by themselves, for doc_id may be repeated or null: near-dedup and decontamination number the rows of
their input in a stored table and drop the numbers again. Of each group of near or exact copies one row is kept, that of
the least doc_id (null ids last), then of the least hash of the text.

Cases, in every stage: null texts, ids, langs, sources and counts stay as they are; rows without words are kept (they are
not toxic, near to nothing, repeat nothing and hold no item) and have no tokens. Very long texts are handled whole. Repeated
rows are copies: near-dedup keeps one; the other stages treat each alike. Ties go to the least id. Columns that documents
does not have are left out, whatever their names. An empty table gives an empty table with the stage's columns.

Memory: a stage sets the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH_BYTES, for 10,000 whole texts (Spark's
batch) are some 20 MB that stand several times in an executor and its Python workers. It holds when a stage's rows are
written, so a stage called by itself leaves it set; run puts it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontamination, minhash_dedup, substring_dedup, toxicity
from loomgraph.llm.tables import read, stored
from loomgraph.sources.storage import drop, new_folder, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REPEATED_WORDS = 50
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """stage, whose rows go to Python in Arrow batches of about BATCH_BYTES, at least a row."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id, stored, for numbers hold only once they are written."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row_id"), *COLUMNS))


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, passed=tuple(COLUMNS[1:])).where("predicted = 0").select(COLUMNS)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    groups = minhash_dedup.near_duplicates(rows, id_col="row_id").select(F.col("doc_id").alias("row_id"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), "row_id")
    first = rows.select("row_id", order.alias("r")).join(groups, "row_id").groupBy("component_id").agg(F.min("r").alias("r"))
    return rows.join(stored(first.select("r.row_id")), "row_id", "left_semi").select(COLUMNS)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(docs.select(COLUMNS), window=REPEATED_WORDS, passed=tuple(COLUMNS[1:]))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    leaks = decontamination.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col="row_id").select(F.col("doc_id").alias("row_id")).distinct()
    return rows.join(stored(leaks), "row_id", "left_anti").select(COLUMNS)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(docs, passed=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the learned score nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored for itself is deleted when it is written, and so is its input."""
    docs, before, setting = read(spark, sf_dir, "documents"), None, spark.conf.get(BATCH_SETTING)
    try:
        for _, stage in STAGES:
            path = new_folder(spark)
            with scratch(spark):
                out = stage(spark, docs, sf_dir)
                out.write.parquet(path)
            if before:
                drop(spark, before)
            docs, before = spark.read.schema(out.schema).parquet(path), path
    finally:
        spark.conf.set(BATCH_SETTING, setting)
    return docs
