"""File sources and sinks: JSON and CSV scans, discovery with screening, sidecars, reports, ledgers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; the schema is inferred from all rows unless given. Broken lines are null rows
    of ``_corrupt_record`` if the schema has that column."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader.option("samplingRatio", 1.0)).json(path)


def csv_utc(spark: SparkSession, path: str, schema: T.StructType, times: list[str], pattern: str | None = None) -> DataFrame:
    """CSV with a header; ``times`` become timestamps read as UTC whatever the session's zone.

    Text that is no time gives null (an offset in the text counts).
    """
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in schema])
    rows = spark.read.option("header", True).schema(texts).csv(path)
    zoned = lambda c: F.when(F.col(c).rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col(c)).otherwise(F.concat(F.col(c), F.lit("Z")))
    parse = lambda c: F.try_to_timestamp(F.col(c), F.lit(pattern)) if pattern else F.try_to_timestamp(zoned(c))
    return rows.withColumns({c: parse(c) for c in times})


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of some paths that exists, on any file system; None if none does."""
    for c in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return c
    return None


def screened(quotes: DataFrame, excluded: list[str], least_ms: int, file: str = "file") -> DataFrame:
    """Each file of ``quotes`` with rows, two_sided, duration_ms and why it is left out (null: it is not).

    One partial aggregation by file: EXCLUDED (its name holds a listed text), EMPTY, TOO_SHORT
    (under ``least_ms``) or NO_TWO_SIDED_QUOTES, the first that holds.
    """
    per = quotes.groupBy(file).agg(
        F.count("timestamp_ms").alias("rows"), F.count_if(F.col("bid").isNotNull() & F.col("ask").isNotNull()).alias("two_sided"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms")
    )
    listed = F.lit(False)
    for x in excluded:
        listed = listed | F.contains(F.col(file), F.lit(x))
    why = F.when(listed, "EXCLUDED").when(F.col("rows") == 0, "EMPTY").when(F.coalesce("duration_ms", F.lit(0)) < least_ms, "TOO_SHORT").when(F.col("two_sided") == 0, "NO_TWO_SIDED_QUOTES")
    return per.withColumn("left_out", why)


def discover(spark: SparkSession, pattern: str, excluded: list[str], least_ms: int) -> DataFrame:
    """Quotes of all Parquet files that match ``pattern`` and pass the screen, with their file."""
    rows = spark.read.parquet(pattern).withColumn("file", F.input_file_name())
    return rows.join(screened(rows, excluded, least_ms).where("left_out IS NULL").select("file"), "file", "left_semi")


def with_sidecar(rows: DataFrame, sidecars: DataFrame, file: str = "file") -> DataFrame:
    """``rows`` with ``meta``: the sidecar (rows of path and meta) whose path is the file's,
    folder and all, without its endings and with .meta.json; null if there is none. A scheme
    before a path (file:, s3:) and its authority count for nothing."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    stem = lambda c: F.regexp_replace(bare(c), r"(\.meta\.json|\.[A-Za-z0-9]+)+$", "")
    side = sidecars.groupBy(stem(F.col("path")).alias("_stem")).agg(F.max("meta").alias("meta"))
    return rows.withColumn("_stem", stem(F.col(file))).join(side, "_stem", "left").drop("_stem")


def sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, meta): one JSON document a file, as text."""
    return spark.read.option("wholetext", True).text(pattern).select(F.input_file_name().alias("path"), F.col("value").alias("meta"))


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files; a count without columns is answered from the footers."""
    return spark.read.parquet(path).count()


def overwrite_parquet(df: DataFrame, path: str, *, by: list[str] | None = None, sort: list[str] | None = None) -> None:
    """Replace a Parquet table: a folder for each value of ``by``, rows sorted by ``sort``
    inside each file (a multi-key order without a global sort)."""
    if by:
        df = df.repartition(*by)
    if sort:
        df = df.sortWithinPartitions(*(by or []), *sort)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def report(df: DataFrame, path: str, kind: str, most: int = 100_000) -> None:
    """A table of at most ``most`` rows as one CSV or JSON file in a folder, or a Markdown table
    as text. A larger one is refused with an error before anything is written: that is a table
    for ``overwrite_parquet``."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report has at most {most} rows")
    one = df.coalesce(1)
    if kind == "csv":
        one.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        one.write.mode("overwrite").json(path)
    elif kind == "markdown":
        line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
        body = one.select(line([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("line"))
        body.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.collect_list("line"), "\n")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such report: {kind}")


def decision_log(decisions: DataFrame, path: str, order: list[str], epoch: str) -> DataFrame:
    """Write an epoch's decisions as JSON lines, and return the manifest of what is stored:
    epoch, decisions, first and last of ``order[0]``, digest of all lines' digests (in any order).

    An epoch (a session, a batch) is a folder of its own: a retry replaces its lines instead
    of adding them again, other epochs stay. The manifest reads the stored lines, so it cannot
    tell of others than these, however often the plan behind ``decisions`` runs.
    """
    first = order[0]
    at = f"{path.rstrip('/')}/epoch={epoch}"
    line = F.to_json(F.struct(*sorted(decisions.columns)), {"ignoreNullFields": "false"})
    rows = decisions.select(*order, line.alias("value"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(at)
    kind = decisions.schema[first].dataType
    stored = decisions.sparkSession.read.schema("value string").text(at).select(F.sha2("value", 256).alias("sha256"), F.get_json_object("value", f"$['{first}']").cast(kind).alias("at"))
    part = lambda k: F.conv(F.substring("sha256", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return stored.agg(
        F.lit(epoch).alias("epoch"), F.count(F.lit(1)).alias("decisions"), F.min("at").alias("first"), F.max("at").alias("last"), F.sha2(F.concat_ws(":", F.sum(part(0)), F.sum(part(1)), F.sum(part(2)), F.sum(part(3))), 256).alias("digest")
    )


LEDGER = T.StructType().add("session_id", "string").add("reason", "string").add("at_ms", "long")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Aborts recorded so far (empty if none)."""
    return spark.read.schema(LEDGER).json(path) if first_existing(spark, [path]) else spark.createDataFrame([], LEDGER)


def record_abort(spark: SparkSession, path: str, session_id: str, reason: str, at_ms: int) -> bool:
    """Add a session's abort unless it has one; says whether it was added. Survives restarts.

    A session's entry is one file, named by a digest of its id and created exclusively, so of
    two writers one adds it.
    """
    jvm, line = spark._jvm, json.dumps({"session_id": session_id, "reason": reason, "at_ms": at_ms}) + "\n"
    at = jvm.org.apache.hadoop.fs.Path(path, hashlib.sha256(session_id.encode()).hexdigest() + ".json")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as e:  # another writer was first
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    out.write(bytearray(line.encode()))
    out.close()
    return True


def record_raw(frames: DataFrame, path: str):
    """A running query that appends a stream of raw frames (column value) as text, by day of receipt."""
    day = frames.withColumn("day", F.to_date("at"))
    return day.select("value", "day").writeStream.format("text").partitionBy("day").option("path", path).option("checkpointLocation", f"{path}/_log").trigger(availableNow=True).start()


def to_json_file(spark: SparkSession, path: str, data: dict) -> None:
    """A small document as one JSON line."""
    spark.createDataFrame([(json.dumps(data, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
