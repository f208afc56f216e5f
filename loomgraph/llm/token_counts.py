"""Token counts of documents in flat token files that have no index, by a separator scan.

A flat token file is the tokens of document after document, each ended by the end-of-document id, and nothing else. Its
byte ranges of BLOCK tokens are read by themselves (open and seek, a few ranges a time, whatever the file's size) and know
nothing of documents. In each block a vectorised search finds the separators; the block keeps the lengths of documents
that lie within it, the tokens before its first separator and those after its last. A prefix scan over the blocks (within
super-blocks of SUPER blocks, then over the super-blocks' sums) gives each block the number of separators before it and
the tokens carried into it, which stitches the documents that cross borders. No task holds more than a block or the sums
of a super-block's blocks, however long a file is.

Files are opened with pyarrow.fs, which reads local and shared folders, HDFS and object stores by their URI.

Cases: a file without separators is one document; one that ends in a separator has no document after it; empty documents
count 0; an empty file has no documents. For the tables here, null and empty texts are documents of 0 tokens, very long
ones are encoded whole, repeated rows are documents of their own, null ids come back as null, other columns do not pass,
and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import new_folder, stored
from .words import slices

BLOCK = 1 << 16  # tokens
SUPER = 1024  # blocks
TASK_BYTES, MOST_TASKS = 16 << 20, 20_000  # of a reading task, as long as there are not too many


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _opened(uri: str):
    """The file system and path of a URI; Hadoop's short forms of local and S3 ones are known."""
    from pyarrow import fs

    for short, long in (("file:/", "file:///"), ("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(short) and not uri.startswith("file://"):
            uri = long + uri[len(short) :]
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark would take."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes flat files of 16-bit tokens to folder, one a task, and returns, to be stored, a row (file_id, bytes) for each
    and rows (file_id, number, doc_ids) of the documents that went in from number on. A file that a task's lost attempt
    left behind has no rows."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    folder = _qualified(docs.sparkSession, folder)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name = _encoder(path).encode_ordinary, f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens"
        system, local = _opened(name)
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        number = size = 0

        def row(size: int | None, number: int | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file_id", "bytes", "number", "doc_ids"])

        with system.open_output_stream(local) as out:
            for batch in batches:
                for part in slices(batch, "text"):
                    tokens = np.concatenate([np.array([*encode(t or ""), separator], "<u2") for t in part["text"].to_pylist()])
                    size += out.write(tokens.tobytes())
                    yield row(None, number, part["doc_id"].to_pylist())
                    number += part.num_rows
        yield row(size, None, None)

    return chosen.mapInArrow(write, "file_id string, bytes long, number long, doc_ids array<long>")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file_id, bytes of the files under path; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), F.col("length").alias("bytes"))


def separator_scan(files: DataFrame, separator: int = 50256, width: int = 2) -> DataFrame:
    """file_id, document (number within its file, from 0) and n_tokens of every document of flat files (file_id, bytes).

    width: bytes of a token."""
    step = BLOCK * width
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]  # one number
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, total // TASK_BYTES))
    ranges = files.where("bytes > 0").select("file_id", F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / step).cast("long"))).alias("block"))
    blocks = ranges.repartition(tasks, "file_id", F.floor(F.col("block") / 16))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for file_id, block in zip(batch["file_id"].to_pylist(), batch["block"].to_pylist(), strict=True):
                if file_id != name:
                    system, local = _opened(file_id)
                    name, file = file_id, system.open_input_file(local)
                tokens = np.frombuffer(file.read_at(step, block * step), f"<u{width}")
                ends = np.flatnonzero(tokens == separator)
                inner = np.diff(ends) - 1
                rows.append((len(tokens), len(ends), int(ends[0]) if len(ends) else len(tokens), len(tokens) - 1 - int(ends[-1]) if len(ends) else None, inner))
            n, found, head, tail, inner = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["block"], *(pa.array(x, pa.int64()) for x in (n, found, head, tail)), pa.array(inner, pa.list_(pa.int64()))], names=["file_id", "block", "n", "found", "head", "tail", "inner"])

    seen = blocks.mapInArrow(find, "file_id string, block long, n long, found long, head long, tail long, inner array<long>")
    seen = stored(seen).withColumn("super", F.floor(F.col("block") / SUPER))
    within = Window.partitionBy("file_id", "super").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    end = F.when(F.col("found") > 0, F.col("past") + F.col("n") - F.col("tail"))  # just after the block's last separator
    seen = seen.withColumn("past", zero(F.sum("n").over(before))).withColumn("number", zero(F.sum("found").over(before))).withColumn("from", F.max(end).over(before))
    sums = seen.groupBy("file_id", "super").agg(F.sum("n").alias("sn"), F.sum("found").alias("sf"), F.max(end).alias("se"), F.max("block").alias("sb"))
    over = Window.partitionBy("file_id").orderBy("super")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("sp", zero(F.sum("sn").over(earlier))).withColumn("snum", zero(F.sum("sf").over(earlier))).withColumn("sfrom", zero(F.max(F.col("sp") + F.col("se")).over(earlier)))
    sums = sums.withColumn("last", F.lead("sb").over(over).isNull())
    both = seen.join(sums, ["file_id", "super"])
    carried = F.col("sp") + F.col("past") - F.coalesce(F.col("sp") + F.col("from"), F.col("sfrom"))
    both = both.withColumn("carried", carried).withColumn("first", F.col("snum") + F.col("number"))
    ending = F.when(F.col("last") & (F.col("block") == F.col("sb")), F.when(F.col("found") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("n")))
    whole = F.when(F.col("found") > 0, F.concat(F.array(F.col("carried") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(ending > 0, F.concat(whole, F.array(ending))).otherwise(whole)
    return both.select("file_id", "first", F.posexplode(whole).alias("i", "n_tokens")).select("file_id", (F.col("first") + F.col("i")).alias("document"), "n_tokens")


def op8_query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    files = stored(token_files(read(spark, sf_dir, "documents"), new_folder(spark)))
    counts = separator_scan(files.where("bytes is not null").select("file_id", "bytes"))
    names = files.where("bytes is null").select("file_id", "number", F.posexplode("doc_ids").alias("i", "doc_id")).select("file_id", (F.col("number") + F.col("i")).alias("document"), "doc_id")
    return names.join(counts, ["file_id", "document"]).select("doc_id", "n_tokens")
