"""Token counts of flat, unindexed token files by a vectorised separator scan.

A flat file is nothing but little-endian token ids, each document ended by the end-of-
document id. Blocks of a file are searched in parallel; a block knows the ends inside it but
neither how many documents came before nor where its first one began. Block summaries
(ends inside, last end) are stitched by a prefix scan over a file's blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .lib_tokens import chunk_encoder

LISTING = T.StructType().add("file", "string").add("ordinal", "long").add("doc_id", "long")
_LISTING_PA = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])


def write_flat(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts into flat files, a file a task, in the order of the rows.

    Returns the listing (file, ordinal, doc_id) of which document stands where; it holds
    no offsets and no counts. Null texts are empty documents; null ids are kept. The file
    of a retried task has another name, and only listed files are read.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def write(batches):
        encoder = chunk_encoder(tokenizer_path)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        uri, ids = f"{path}/{uuid.uuid4().hex}.tokens", []

        def chunks():
            for b in batches:
                bodies = encoder.encode_batch(b.column(1).cast(pa.binary()).to_pylist())
                ids.append(b.column(0))
                yield b"".join([x for body in bodies for x in (body, end)])

        source = chunks()
        head = next(source, None)
        if head is None:
            return
        common.write_file(uri, (x for part in ([head], source) for x in part))
        at = 0
        for col in ids:
            n = len(col)
            yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(np.arange(at, at + n)), col], schema=_LISTING_PA)
            at += n

    return common.stage(own.mapInArrow(write, LISTING), f"{path}/listing")


ENDS = T.StructType().add("file", "string").add("block", "long").add("nth", "long").add("at", "long")
_ENDS_PA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("at", pa.int64())])


def scan(files: DataFrame, end_id: int, *, width: int = 2, block_tokens: int = 4 << 20) -> DataFrame:
    """Per document of flat files (column ``file``): file, ordinal, start, n_tokens.

    n_tokens excludes the end id. A document may span any number of blocks; ids after a
    file's last end (a cut file) form no document.
    """
    spark = files.sparkSession
    common.prepare(spark)
    dtype = np.dtype("<u2" if width == 2 else "<u4")

    def blocks(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = common.filesystem(uri)
                n = fs.get_file_info(path).size // width
                count = -(-n // block_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * count, pa.string()), pa.array(np.arange(count))], names=["file", "block"])

    def search(batches):
        for b in batches:
            for uri, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = common.filesystem(uri)
                with fs.open_input_file(path) as f:
                    raw = f.read_at(block_tokens * width, block * block_tokens * width)
                ids = np.frombuffer(raw, dtype, len(raw) // width)
                at = np.flatnonzero(ids == end_id) + block * block_tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(at), pa.string()), pa.array(np.full(len(at), block)), pa.array(np.arange(len(at))), pa.array(at)], schema=_ENDS_PA
                )

    found = files.select("file").distinct()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count())  # given, so never merged
    dealt = found.mapInArrow(blocks, "file string, block long").repartition(tasks, "file", "block")
    ends = dealt.mapInArrow(search, ENDS)
    # blocks without an end add nothing to either sum, so they need no summary
    summary = ends.groupBy("file", "block").agg(F.count(F.lit(1)).alias("inside"), F.max("at").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "file", "block", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("documents_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before")
    )
    own = Window.partitionBy("file", "block").orderBy("nth")
    # ends compress so well that adaptive execution would take millions of rows for a small
    # side and broadcast them; both sides grow with the corpus, so they are merged
    joined = ends.hint("merge").join(carried.hint("merge"), ["file", "block"]).withColumn("previous", F.coalesce(F.lag("at").over(own), F.col("last_before")))
    return joined.select(
        "file",
        (F.col("documents_before") + F.col("nth")).alias("ordinal"),
        (F.col("previous") + 1).alias("start"),
        (F.col("at") - F.col("previous") - 1).alias("n_tokens"),
    )


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens (without the end id), start in its file.

    end_id must be an id that the vocabulary never gives a text's own words.
    """
    spark = docs.sparkSession
    path = common.workspace(spark, "token-counts")
    listing = write_flat(docs, path, tokenizer_path, end_id, id_col=id_col, text_col=text_col)
    width = chunk_encoder(tokenizer_path).dtype.itemsize
    counts = scan(listing, end_id, width=width, block_tokens=block_tokens)
    return listing.hint("merge").join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "start")
