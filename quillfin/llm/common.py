"""Shared plumbing: the cluster's shared folder, staging, shipping code to executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python, whichever is reached first.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master (tests) may leave it unset; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillfin-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_scratch: list[list[str]] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one for one run of an operator."""
    made = f"{shared_dir(spark)}/quillfin/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(made)
    return made


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the workspaces made inside when the block is left: for callers that have
    written the operators' results elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for made in _scratch.pop():
            drop_path(spark, made)


#: Spark's own setting that deletes a plan's shuffle files when the plan has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later plans start from stored rows, and
    the shuffle files of the write go as soon as it is done."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of a stored row's number that tell files apart; the others count a file's rows.
FILE_BITS = 36


def numbered(docs: DataFrame, path: str) -> tuple[DataFrame, str]:
    """``docs`` with a number that tells its rows apart, the same in every scan, and that column's name.

    Rows of a Parquet table just as it is stored are numbered by their place in their file and
    a hash of its name; it is checked that no number repeats. Other frames, whose rows may
    come otherwise in a second run, are staged with their numbers.
    """
    name = free_name(docs, "_uid")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            at = docs.metadataColumn("_metadata")
            file = F.xxhash64(at["file_path"]).bitwiseAND(F.lit((1 << FILE_BITS) - 1))
            own = docs.withColumn(name, F.shiftleft(at["row_index"], FILE_BITS).bitwiseOR(file))
            rows = own.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            if not rows.where(F.col("n") > 1).limit(1).count():
                return own, name
        except AnalysisException:  # a format whose rows have no place
            pass
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), path), name


#: Parts that the rows of one key are dealt into by :func:`spread_join`.
SPREAD = 64


def spread_join(rows: DataFrame, small: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """``rows.join(small, on, how)`` where one key may hold any share of ``rows``.

    ``small`` holds a key once. Rows are dealt by (key, hash of ``by``), so a hot key's rows
    go to SPREAD places; ``small`` is first joined with the distinct (key, part), of which a
    key has SPREAD at most, and then meets the rows part by part. ``rows`` should be staged.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    told = dealt.select(on, "_part").distinct().join(small, on)
    return dealt.join(told, [on, "_part"], how).drop("_part")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads (any Hadoop file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Between phases of many jobs: let the driver forget the plans and broadcasts of the
    last one, so that its memory does not grow with the number of jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI of the shared folder, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write byte chunks to a new file under a temporary name, then move it into place.

    A retried or speculative task writes its own temporary file; whichever is moved
    last wins, and both hold the same bytes.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, path)
    return size


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for clusters without it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quillfin_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quillfin-ship-")) / "quillfin_pkg.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    sc.addPyFile(str(to))
    sc._quillfin_shipped = True


def prepare(spark: SparkSession) -> None:
    """What every operator with Python stages needs: code on executors, small Arrow batches."""
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now > BATCH_ROWS or now <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_memos: dict[str, object] = {}
_using = ""


def memo(name: str, forget) -> None:
    """Register a worker's cache: ``forget()`` empties it."""
    _memos[name] = forget


def using(name: str) -> None:
    """Called by the owner of a cache before it works: when a Python worker turns from one
    operator to another, the caches of the others are emptied and their memory returned."""
    global _using
    if name == _using:
        return
    _using = name
    for other, forget in _memos.items():
        if other != name:
            forget()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
