"""Benchmark decontamination by spaced seeds (DataFrame operations only).

Fixed masks look at some word positions of a window and ignore the others, so a window
with a substituted word still agrees under the masks that ignore it. Windows of the
benchmark and of the documents are hashed under every mask and joined. A hit fixes an
alignment of a document and an item (document position minus item position); the words on
each such alignment are fetched and compared one by one, and an item leaks only if a single
alignment has a stretch with enough equal words. Hits of different alignments never add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed masks over nine words: 1 counts, 0 is ignored. In fifteen words any two
#: substitutions, and 99.8 % of all three, leave a window on which some mask agrees.
MASKS = ("111001011", "100011111", "110101011", "111010011")
SPAN = 9
#: Items of fewer words get shorter masks too, that survive one substitution anywhere.
SHORT, SHORT_SPAN = 15, 8
#: Words of a document whose windows are laid out side by side at a time.
CHUNK = 4096
#: What tells rows apart: two independent hashes of id and text.
ROW = ["_r1", "_r2"]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; case and punctuation do not tell texts apart."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _row_key(id_col: Column, text_col: Column) -> list[Column]:
    text = F.coalesce(text_col.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), id_col, text), F.xxhash64(text, id_col, F.lit(2))]


def masks_for(lengths: list[int]) -> list[tuple[str, int, int]]:
    """(mask, least, most words of the items it is for), given the lengths below SHORT that occur.

    Items under five words may not differ at all; of those up to SHORT_SPAN words each mask
    ignores every third word, so one substitution anywhere leaves a mask that agrees.
    """
    out = [(m, SPAN, 1 << 30) for m in MASKS]
    thirds = lambda n: ["".join("0" if k % 3 == r else "1" for k in range(n)) for r in range(3)]
    for n in sorted(x for x in lengths if x <= SHORT_SPAN):
        out += [("1" * n, n, n)] if n < 5 else [(m, n, n) for m in thirds(n)]
    if any(SHORT_SPAN < x < SHORT for x in lengths):
        out += [(m, SPAN, SHORT - 1) for m in thirds(SHORT_SPAN)]
    return out


def _windows(df: DataFrame, keep: list[str], words: str) -> DataFrame:
    """A row per word position: ``keep``, pos, w0 .. w8 (null past the end).

    A long text is cut into chunks (with the words that the last windows reach into), so
    only a chunk's windows stand side by side.
    """
    n = F.size(words)
    chunks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), lambda s: F.struct(s.alias("at"), F.slice(words, s + 1, CHUNK + SPAN - 1).alias("h")))
    cut = df.where(n > 0).select(*keep, F.inline(chunks))
    own = F.least(F.size("h"), F.lit(CHUNK))
    shifted = [F.slice("h", k + 1, own).alias(f"w{k}") for k in range(SPAN)]
    at = F.sequence(F.col("at"), F.col("at") + own - 1).alias("pos")
    return cut.select(*keep, F.inline(F.arrays_zip(at, *shifted))).where(F.col("pos").isNotNull())


def _seed(masks: list[tuple[str, int, int]], item_words: Column | None = None) -> Column:
    """A seed a mask; null where the window is cut by the text's end or the mask is not for the item."""
    out = []
    for number, (mask, least, most) in enumerate(masks):
        used = [F.col(f"w{k}") for k, c in enumerate(mask) if c == "1"]
        fits = F.col(f"w{len(mask) - 1}").isNotNull()
        if item_words is not None:
            fits &= item_words.between(least, most)
        out.append(F.when(fits, F.xxhash64(F.lit(number), *used)))
    return F.explode(F.array(*out))


def _leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    least_words: int = 13,
    stretch: int = 16,
    least_share: float = 0.8,
    broadcast_seeds: int = 500_000,
) -> DataFrame:
    """(_r1, _r2, _doc, item_id, matched_words, item_words) of rows and items with a leak."""
    spark = docs.sparkSession
    path = common.workspace(spark, "decontaminate")
    item = F.xxhash64(benchmark[item_id_col], benchmark[item_text_col].cast("string"))
    items = benchmark.select(item.alias("_item"), benchmark[item_id_col].alias("item_id"), words_of(benchmark[item_text_col]).alias("_words"))
    items = items.where(F.size("_words") > 0).withColumn("item_words", F.size("_words")).dropDuplicates(["_item"])
    items = common.stage(items, f"{path}/items")
    lengths = [r[0] for r in items.where(F.col("item_words") < SHORT).select("item_words").distinct().collect()]  # at most 14 numbers
    masks = masks_for(lengths)
    ours = _windows(items, ["_item", "item_words"], "_words").select("_item", F.col("pos").alias("item_pos"), _seed(masks, F.col("item_words")).alias("seed"))
    seeds = common.stage(ours.where(F.col("seed").isNotNull()).distinct(), f"{path}/seeds")
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds  # then there are no more items either
    maybe = F.broadcast if small else lambda df: df

    key = [k.alias(name) for k, name in zip(_row_key(docs[id_col], docs[text_col]), ROW)]
    own = docs.select(*key, docs[id_col].alias("_doc"), words_of(docs[text_col]).alias("_words"))
    theirs = _windows(own, [*ROW, "_doc"], "_words").select(*ROW, "_doc", "pos", _seed(masks).alias("seed"))
    hits = theirs.join(maybe(seeds), "seed").select(*ROW, "_doc", "_item", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
    hits = common.stage(hits.distinct(), f"{path}/hits")

    # around each hit the words of its alignment, compared one by one
    aligned = hits.join(maybe(items), "_item").select(*ROW, "_doc", "_item", "item_id", "item_words", "diagonal", F.posexplode("_words").alias("item_pos", "item_word"))
    aligned = aligned.withColumn("pos", F.col("diagonal") + F.col("item_pos")).where("pos >= 0")
    # only documents with hits are cut into words again; stored keys have a known size
    wanted = common.stage(hits.select(*ROW).distinct(), f"{path}/wanted")
    raw = docs.select(*key, docs[text_col].alias("_text")).join(wanted, ROW, "left_semi").dropDuplicates(ROW)
    fetched = raw.select(*ROW, F.posexplode(words_of(F.col("_text"))).alias("pos", "word"))
    equal = aligned.join(fetched, [*ROW, "pos"]).where(F.col("word") == F.col("item_word"))
    on = Window.partitionBy(*ROW, "_item", "diagonal").orderBy("item_pos")
    need = F.least(F.lit(least_words), F.ceil(F.col("item_words") * F.lit(least_share)))
    equal = equal.withColumn("_enough", F.count(F.lit(1)).over(on.rangeBetween(0, stretch - 1)) >= need)
    equal = equal.withColumn("_inside", F.max("_enough").over(on.rangeBetween(-(stretch - 1), 0))).where("_inside")
    per = equal.groupBy(*ROW, "_item", "diagonal").agg(F.first("_doc").alias("_doc"), F.first("item_id").alias("item_id"), F.first("item_words").alias("item_words"), F.count(F.lit(1)).alias("matched_words"))
    return per.groupBy(*ROW, "_doc", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pairs (doc_id, item_id, matched_words, item_words, overlap) of contaminated documents.

    An item leaks into a document if on one alignment ``stretch`` (16) consecutive words of
    the item hold at least ``least_words`` (13) that stand in the document at the same
    distance; of an item of fewer words than 16, at least ``least_share`` (0.8) of all its
    words, 13 at most. matched_words counts the equal words in all such stretches of the
    best alignment. Found are all leaks with a window on which a mask agrees: any two
    substitutions in fifteen words, any one in shorter items of five words or more.

    Options: id_col, text_col, item_id_col, item_text_col, and ``broadcast_seeds``: the
    benchmark's seeds and items are broadcast only if counted to be at most that many; a
    larger benchmark is joined by shuffle, of narrow rows. Null and empty texts match
    nothing. Repeated items and documents count once per id (null ids group together), with
    the best of what their texts match; texts of any length are cut into chunks; empty
    tables give an empty result; other columns are not read.
    """
    id_col = options.get("id_col", "doc_id")
    found = _leaks(docs, benchmark, **options).groupBy("_doc", "item_id").agg(F.max(F.struct("matched_words", "item_words")).alias("best"))
    share = F.col("best.matched_words") / F.col("best.item_words")
    return found.select(F.col("_doc").alias(id_col), "item_id", "best.matched_words", "best.item_words", share.alias("overlap"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns.

    Rows are told apart by hashes of id and text, so a clean row stays although another row
    has its id; rows that repeat both go together. Null and empty texts stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = _leaks(docs, benchmark, **options).select(*ROW).distinct()
    # stored, so that its size is known: rows are shuffled only if it is too large to broadcast
    bad = common.stage(bad, common.workspace(docs.sparkSession, "contaminated"))
    one, two = _row_key(docs[id_col], docs[text_col])
    return docs.join(bad, (one == bad[ROW[0]]) & (two == bad[ROW[1]]), "left_anti")
