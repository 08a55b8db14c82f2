"""Audit of raw JSON-lines files: what each holds, how long it runs and whether it is usable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHAPE = "received_at string, asset_id string, event struct<event_type:string, market:string, asset_id:string, timestamp:string, price_changes:array<struct<asset_id:string>>>"


def digests(spark: SparkSession, pattern: str) -> DataFrame:
    """source_file, bytes, sha256 of whole files (of at most 2 GiB each, Spark's limit for a
    binary value; a larger one stops the job)."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("path").alias("source_file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def slug(file: Column) -> Column:
    """A file's name without its folder and its last ending."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.[^.]*$", "")


def audit(lines: DataFrame, tokens: DataFrame, complete_ms: int = 200_000, partial_ms: int = 50_000, block: int = 100_000) -> DataFrame:
    """A row a file of ``lines`` (source_file, source_line, value).

    ``tokens`` (source_file, up_token, down_token) says which two assets a file should hold;
    a file without them counts as one-sided. Lines that are no JSON object are malformed.
    max_gap_ms is the largest step forward between a line's source time and the one before in
    the file's order, over lines that have one; duration is between the least and the largest
    of them, else between the first and the last receipt. A file's order is kept by blocks of
    ``block`` lines whose ends are compared afterwards, so a large file is no one task. Files
    without lines have no row.
    """
    v = F.col("value")
    sound = F.trim(v).startswith("{") & F.try_parse_json(v).isNotNull()
    rows = lines.select("source_file", "source_line", sound.alias("sound"), F.when(sound, F.from_json(v, _SHAPE)).alias("r"))
    e = F.col("r.event")
    rows = rows.select(
        "source_file", "source_line", "sound", e["event_type"].alias("kind"), e["market"].alias("market"), e["timestamp"].try_cast("long").alias("ts"),
        F.unix_millis(F.try_to_timestamp("r.received_at")).alias("received"),
        F.array_distinct(F.array_compact(F.concat(F.array("r.asset_id", e["asset_id"]), F.when(e["event_type"] == "price_change", F.coalesce(e["price_changes"]["asset_id"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))).alias("assets"),
    )
    at, quote, got = F.col("source_line"), F.coalesce(F.col("kind").isin("book", "price_change"), F.lit(False)), F.col("received")
    before = F.last("ts", True).over(Window.partitionBy("source_file", "b").orderBy("source_line").rowsBetween(Window.unboundedPreceding, -1))
    receipt, timed = F.when(got.isNotNull(), F.struct(at.alias("at"), got.alias("ms"))), F.when(F.col("ts").isNotNull(), at)
    rows = rows.withColumn("b", F.floor(at / block)).withColumn("gap", F.col("ts") - before)
    # one pass over the lines; what is asked of a file is asked of its blocks
    blocks = rows.groupBy("source_file", "b").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.coalesce("sound", F.lit(False))).alias("malformed"), F.count_if(quote).alias("quotes"), F.collect_set("kind").alias("kinds"), F.collect_set("market").alias("markets"),
        F.array_distinct(F.flatten(F.collect_set("assets"))).alias("assets"), F.min("ts").alias("first_ms"), F.max("ts").alias("last_ms"), F.min(receipt).alias("first_got"), F.max(receipt).alias("last_got"),
        F.max("gap").alias("gap"), F.min_by("ts", timed).alias("head"), F.max_by("ts", timed).alias("tail"),
    ).persist()
    along = Window.partitionBy("source_file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    joint = F.col("head") - F.last("tail", True).over(along)
    per = blocks.withColumn("gap", F.greatest("gap", joint)).groupBy("source_file").agg(
        *[F.sum(c).alias(c) for c in ("lines", "malformed", "quotes")], F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("event_types"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        (F.max("last_got")["ms"] - F.min("first_got")["ms"]).alias("_received_ms"), F.max("gap").alias("gap"),
    )
    markets = blocks.select("source_file", F.explode("markets").alias("market")).distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("markets"))

    held = blocks.select("source_file", F.explode("assets").alias("asset")).distinct().join(tokens, "source_file", "left")
    held = held.groupBy("source_file").agg(F.count(F.lit(1)).alias("assets"), *[F.coalesce(F.bool_or(F.col("asset") == F.col(f"{s}_token")), F.lit(False)).alias(f"{s}_represented") for s in ("up", "down")])
    out = per.join(markets, "source_file", "left").join(held, "source_file", "left")
    no = F.lit(False)
    both = F.coalesce("up_represented", no) & F.coalesce("down_represented", no)
    lasts = F.coalesce(F.col("last_ms") - F.col("first_ms"), "_received_ms", F.lit(0))
    # fixed values: the classes' names
    kind = F.when(F.col("quotes") == 0, "DEGENERATE_EMPTY").when(~both, "ONE_SIDED_OR_INCOMPLETE").when(lasts >= complete_ms, "COMPLETE").when(lasts >= partial_ms, "TRUNCATED").otherwise("MINIMAL_TRUNCATED")
    out = out.withColumns({"slug": slug(F.col("source_file")), "duration_ms": lasts, "max_gap_ms": F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)), "classification": kind, "usable": kind.isin("COMPLETE", "TRUNCATED")})
    out = out.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in (("markets", 0), ("assets", 0), ("up_represented", False), ("down_represented", False))})
    out = out.withColumn("files_of_slug", F.count(F.lit(1)).over(Window.partitionBy("slug")))
    return out.select("source_file", "slug", "files_of_slug", "lines", "malformed", "quotes", "event_types", "markets", "assets", "up_represented", "down_represented", "first_ms", "last_ms", "duration_ms", "max_gap_ms", "classification", "usable")
