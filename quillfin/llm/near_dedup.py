"""Near-duplicate links by chosen-path trees over minwise tokens.

Texts with equal shingle sets form a class. A class has TOKENS minwise tokens (its least
shingles under as many hash functions). Each tree deals the classes into nodes by START tokens
of its own. A node's classes share these tokens, so two sets of similarity s share a node
in a tree with probability s**START, and independent trees repeat that.

Pass 1 links the nodes' classes to pivots; verified links give components. Pass 2 recurses:
nodes within one component are dropped; small nodes, and large ones with few classes outside
their main component, are compared exhaustively; every class of another node goes to BRANCH
children of it, each named by one more of its minwise tokens. Two sets of similarity s share
BRANCH * s children of a node they share, in expectation, so links at 0.75 survive at any
depth while classes that are less alike than 1 / BRANCH come apart. Each node decides for
itself: one that branching would not make cheaper (its classes are alike throughout), or that
LEVELS have left large, is compared by blocks of full shingle sets, so no pair is given up. Every link is confirmed on full sets; components are connected by
least-label rounds on stored tables. A hot node, pivot or component is never one join key:
its rows are dealt into parts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .substring_dedup import _parts
from .word_hashes import hash_words, mix

#: Trees, tokens that each starts with, and tokens that only sketches use.
TREES, START, MORE = 16, 2, 32
TOKENS = TREES * START + MORE
#: Children of a node that each of its classes goes to, and the tokens they are chosen from.
BRANCH, CHOICES = 2, 7
#: Levels of branching; beyond them nodes are compared by blocks.
LEVELS = 7
#: A node branches only if its children take at most so much of its own comparisons.
GAIN = 0.75
#: A node of at most so many classes is compared exhaustively.
SMALL = 24
#: Up to so many classes outside the main component of a large node meet all its classes.
OUTSIDERS = 8
#: Classes and bytes of shingles that a block of a large node has on average at most.
BLOCK, BLOCK_BYTES = 128, 4 << 20
#: Trees whose pivots pass 1 links; its only aim is to join what is alike before pass 2,
#: which goes through all trees.
STAR_TREES = 3
#: Pivots of a large node. One class seldom reaches all that a large group links together;
#: a few, chosen by hashes that are the same in all trees, do.
PIVOTS = 8

_rng = np.random.default_rng(20240517)
_XOR = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(texts: list[bytes], words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words_each`` words (of the whole text, if it has fewer), and starts."""
    h, starts = hash_words([t.lower().split() for t in texts])  # bytes.lower() maps A-Z alone
    lengths = np.diff(starts)
    run, n = h, len(h)
    for k in range(1, words_each):
        run = mix(run[: n - k], h[k:]) if n > k else run[:0]
    count = np.maximum(lengths - words_each + 1, 0)
    short = np.flatnonzero((lengths > 0) & (lengths < words_each))
    count[short] = 1
    out_starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=out_starts[1:])
    out = np.empty(int(out_starts[-1]), np.uint64)
    at = np.arange(len(out)) - np.repeat(out_starts[:-1], count) + np.repeat(starts[:-1], count)
    whole = np.ones(len(out), bool)
    whole[out_starts[short]] = False
    out[whole] = run[at[whole]]
    for k in short.tolist():
        part = h[starts[k] : starts[k + 1]]
        one = np.array([len(part)], np.uint64)
        for x in part:
            one = mix(one, np.array([x], np.uint64))
        out[out_starts[k]] = one[0]
    return out, out_starts


def _sets(texts: list[bytes], words_each: int):
    """Per text its sorted distinct shingle hashes; and all of them with starts."""
    h, starts = shingle_hashes(texts, words_each)
    return [np.unique(h[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], h, starts


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


SIGNED = T.StructType().add("uid", "long").add("doc_id", "long").add("key", "binary").add("n", "long").add("tokens", "binary").add("sketch", "binary")


def signatures(docs: DataFrame, uid: Column, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """uid (tells rows apart), doc_id, key (of the set), n (its size), tokens (uint32 each), sketch (a byte each); null for empty sets."""
    own = docs.select(uid.alias("uid"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def sign(batches):
        for b in batches:
            uids, ids, at = b.column(0), b.column(1), 0
            for part in _parts(b.column(2).cast(pa.binary()).to_pylist()):
                sets, h, starts = _sets(part, words_each)
                full = np.flatnonzero(np.diff(starts) > 0)
                least = np.empty((len(full), TOKENS), np.uint32)
                if len(full):
                    for k in range(TOKENS):
                        v = h ^ _XOR[k]
                        v *= _ODD[k]
                        v >>= np.uint64(32)
                        least[:, k] = np.minimum.reduceat(v, starts[full])
                tokens: list[bytes | None] = [None] * len(part)
                sketch = list(tokens)
                low = least.astype(np.uint8)
                for j, k in enumerate(full.tolist()):
                    tokens[k], sketch[k] = least[j].tobytes(), low[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [uids[at : at + len(part)], ids[at : at + len(part)], pa.array([_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(tokens, pa.binary()), pa.array(sketch, pa.binary())],
                    names=SIGNED.names,
                )
                at += len(part)

    return own.mapInArrow(sign, SIGNED)


def _sizes_fit(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) but those whose minwise tokens say that they are far below ``percent``.

    A pair at the threshold is lost with a probability of about one in a million: it would
    have to agree on 4.7 standard deviations fewer tokens than expected.
    """
    p = percent / 100
    least = int(TOKENS * p - 4.7 * (TOKENS * p * (1 - p)) ** 0.5)
    two = classes.select(F.col("key").alias("b"), F.col("sketch").alias("sb"))
    one = classes.select(F.col("key").alias("a"), F.col("sketch").alias("sa"))

    def agree(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, TOKENS) for k in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    joined = common.spread_join(common.spread_join(pairs, two, "b", "a"), one, "a", "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(agree, "a binary, b binary")


def _members(involved: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words_each: int, path: str) -> DataFrame:
    """key, members (uint64 each, sorted) of the classes ``involved`` (distinct keys).

    One document of each class is read again for its set.
    """
    # stored, so that its size is known: texts are shuffled only if it is too large to broadcast
    wanted = common.stage(reps.join(involved, "key").select(F.col("rep").alias("_rep")).distinct(), f"{path}/wanted")
    own = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    texts = own.join(wanted, common.same(F.col("_id"), F.col("_rep")), "left_semi").select("_text")

    def sets(batches):
        for b in batches:
            for part in _parts(b.column(0).cast(pa.binary()).to_pylist()):
                own_sets = _sets(part, words_each)[0]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in own_sets], pa.binary()), pa.array([s.tobytes() for s in own_sets], pa.binary())], names=["key", "members"])

    # the same id may stand for several texts, and a class come from several of them
    found = texts.mapInArrow(sets, "key binary, members binary").join(involved, "key", "left_semi")
    found = common.stage(found, f"{path}/sets")
    if found.select("key").distinct().count() < found.count():
        found = common.stage(found.dropDuplicates(["key"]), f"{path}/distinct")
    return found


def _keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def _verified(pairs: DataFrame, found: DataFrame, percent: int, path: str) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b: set keys), confirmed on the full sets ``found``."""
    one = found.select(F.col("key").alias("a"), F.col("members").alias("ma"))
    two = found.select(F.col("key").alias("b"), F.col("members").alias("mb"))

    def confirm(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                common_n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_n >= percent * (len(p) + len(q) - common_n))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = common.spread_join(common.spread_join(pairs, two, "b", "a"), one, "a", "b").select("a", "b", "ma", "mb")
    return common.stage(joined.mapInArrow(confirm, "a binary, b binary"), f"{path}/links")


def _connect(links: DataFrame, path: str) -> DataFrame:
    """(key, label): every linked key with the least key reachable by links (a, b).

    Rounds on stored tables: a class takes the least label around it, then its label's
    label, until none changes; the number of rounds grows with the logarithm of the
    longest chain.
    """
    both = common.stage(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{path}/edges")
    labels = common.stage(both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("label")), f"{path}/labels0")
    turn = 0
    while True:
        turn += 1
        told = common.spread_join(both, labels.withColumnRenamed("key", "b"), "b", "a")
        around = told.groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "key", "left").select("key", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        nearer = common.stage(nearer, f"{path}/near{turn}")
        if nearer.where(F.col("new") != F.col("label")).limit(1).count() == 0:
            break
        hop = nearer.select(F.col("key").alias("new"), F.col("new").alias("next"))
        labels = common.stage(common.spread_join(nearer, hop, "new", "key").select("key", F.col("next").alias("label")), f"{path}/labels{turn}")
    return labels


def _pairs_within(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components in one node."""
    one = nodes.select("path", F.col("key").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    two = nodes.select("path", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    both = one.join(two, "path").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")))
    return both.where(_sizes_fit("na", "nb", percent)).select("a", "b")


def _pairs_across(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a node's few classes outside its main component with all its classes."""
    out = nodes.where(F.col("label") != F.col("main"))
    few = out.groupBy("path").agg(F.collect_list(F.struct(F.col("key").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))).alias("few"))
    fits = lambda x: (x["la"] != F.col("label")) & _sizes_fit(x["na"], F.col("n"), percent)
    both = common.spread_join(nodes, few, "path", "key").select("key", F.explode(F.filter("few", fits)).alias("x"))
    return both.select(F.least("x.a", "key").alias("a"), F.greatest("x.a", "key").alias("b"))


def _mixed(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (staged: path, key, label, ...) in nodes that several components
    share, with the node's size, its main component and the number of classes outside it."""
    per = nodes.groupBy("path", "label").agg(F.count(F.lit(1)).alias("c"))
    kinds = per.groupBy("path").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("components")).where("components > 1")
    mixed = kinds.select("path", "size", F.col("top.label").alias("main"), (F.col("size") - F.col("top.c")).alias("others"))
    return common.spread_join(nodes, mixed, "path", "key")


def _worth_branching(large: DataFrame, children: DataFrame) -> DataFrame:
    """(path, worth) of each node in ``large``: whether its ``children`` (mixed nodes) cost less."""
    cost = F.min(F.col("size") * F.col("others"))
    own = large.groupBy("path").agg(cost.alias("own"))
    below = children.groupBy("path").agg(F.min("parent").alias("parent"), cost.alias("cost")).groupBy(F.col("parent").alias("path")).agg(F.sum("cost").alias("below"))
    return own.join(below, "path", "left").select("path", (F.coalesce("below", F.lit(0)) <= F.col("own") * GAIN).alias("worth"))


def _branched(nodes: DataFrame, level: int) -> DataFrame:
    """Each row of ``nodes`` (tree, path, key, n, label, tokens) in BRANCH children of its node.

    A node's path alone says which of the level's CHOICES tokens lead to children, so its
    classes agree on that; no level takes a token of another or of the tree's start.
    """
    pick = F.xxhash64(F.lit(level), "path")
    one = F.pmod(pick, F.lit(CHOICES))
    step = 1 + F.pmod(F.shiftright(pick, 20), F.lit(CHOICES - 1))
    at = [F.pmod(F.col("tree") * START + START + level * CHOICES + F.pmod(one + k * step, F.lit(CHOICES)), F.lit(TOKENS)).cast("int") for k in range(BRANCH)]
    child = [F.xxhash64("path", i, F.substring(F.col("tokens"), i * 4 + 1, F.lit(4))) for i in at]
    return nodes.select("tree", F.col("path").alias("parent"), F.explode(F.array(*child)).alias("path"), "key", "n", "label", "tokens")


def _linked_sets(one: list[bytes], la: list[bytes], two: list[bytes], lb: list[bytes], percent: int) -> set[tuple[bytes, bytes]]:
    """Pairs of different labels that a link between a set of ``one`` and a set of ``two`` joins."""
    p = [np.frombuffer(x, np.uint64) for x in one]
    q = [np.frombuffer(x, np.uint64) for x in two]
    nq = np.array([len(x) for x in q])
    starts = np.concatenate(([0], np.cumsum(nq)[:-1]))
    known, numbers = np.unique(np.concatenate(q), return_inverse=True)
    labels, mark, out = np.array(lb, object), np.zeros(len(known), np.uint8), set()
    for x, label in zip(p, la):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        at = at[known[at] == x]
        mark[at] = 1
        both = np.add.reduceat(mark[numbers], starts, dtype=np.int64)
        mark[at] = 0
        near = labels[100 * both >= percent * (len(x) + nq - both)]
        out.update((min(label, y), max(label, y)) for y in set(near.tolist()) if y != label)
    return out


def _linked_in_blocks(nodes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of labels that a link joins in large nodes, whose classes outside the main
    component meet all its classes on full sets: a row a block, not one a pair."""
    sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    dealt = common.spread_join(nodes, sizes.select("path", blocks.alias("blocks")), "path", "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
    full = dealt.join(found, "key").select("path", "blocks", "block", "label", "main", "members")
    gather = [F.collect_list("members"), F.collect_list("label")]
    two = full.groupBy("path", "block").agg(gather[0].alias("mb"), gather[1].alias("lb"))
    one = full.where(F.col("label") != F.col("main")).groupBy("path", "blocks", F.col("block").alias("own")).agg(gather[0].alias("ma"), gather[1].alias("la"))
    one = one.select("path", "ma", "la", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compare(batches):
        for b in batches:
            for k in range(b.num_rows):
                out = _linked_sets(*(b.column(c)[k].as_py() for c in range(4)), percent)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], names=["a", "b"])

    return one.join(two, ["path", "block"]).select("ma", "la", "mb", "lb").mapInArrow(compare, "a binary, b binary")


#: What block comparison needs of a node's row.
_BLOCKED = ("path", "key", "n", "label", "main")


def _text_components(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, words_each: int, percent: int, path: str) -> DataFrame:
    """(key, label), staged: each class with the least key that links reach from it."""
    spark = docs.sparkSession
    classes = common.stage(
        signed.where(F.col("tokens").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("tokens").alias("tokens"), F.min("sketch").alias("sketch")),
        f"{path}/classes",
    )
    roots = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("tokens", 4 * START * t + 1, 4 * START)).alias("path")) for t in range(TREES)]
    nodes = classes.select("key", "n", F.explode(F.array(*roots)).alias("at")).select("at.tree", "at.path", "key", "n")
    nodes = common.stage(nodes, f"{path}/nodes")

    # pass 1: pivots of the nodes of a few trees
    starred = nodes.where(F.col("tree") < STAR_TREES)
    chosen = [F.min(F.struct(F.xxhash64(F.lit(k), "key").alias("by"), "key", "n")) for k in range(PIVOTS)]
    pivots = starred.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.array(*chosen).alias("p")).where("size > 1")
    pivots = pivots.select("path", F.when(F.col("size") > SMALL, F.col("p")).otherwise(F.slice("p", 1, 1)).alias("p"))
    fits = lambda x: (x["key"] != F.col("key")) & _sizes_fit(F.col("n"), x["n"], percent)
    stars = common.spread_join(starred, pivots, "path", "key").select("key", F.explode(F.filter("p", fits)).alias("p"))
    one, two = F.least("key", "p.key"), F.greatest("key", "p.key")
    pairs = common.stage(stars.select(one.alias("a"), two.alias("b")).distinct(), f"{path}/stars")
    pairs = common.stage(_promising(pairs, classes, percent), f"{path}/pairs1")
    found = _members(common.stage(_keys_of(pairs).distinct(), f"{path}/keys1"), classes, docs, id_col, text_col, words_each, f"{path}/sets1")
    links = _verified(pairs, found, percent, f"{path}/pass1")
    common.drop_path(spark, f"{path}/sets1")
    first = _connect(links, f"{path}/connect1")
    labels = common.stage(classes.select("key").join(first, "key", "left").select("key", F.coalesce("label", "key").alias("label")), f"{path}/labels")

    # pass 2: what different components have in common
    level, pairs, blocks = 0, [], []
    common.drop_path(spark, f"{path}/connect1")
    common.release(spark)
    now = common.stage(_mixed(common.stage(nodes.join(labels, "key"), f"{path}/labelled")), f"{path}/mixed0")
    for done in ("nodes", "labelled", "stars"):
        common.drop_path(spark, f"{path}/{done}")
    while True:
        few = F.col("others") <= OUTSIDERS
        pairs += [_pairs_within(now.where(F.col("size") <= SMALL), percent), _pairs_across(now.where((F.col("size") > SMALL) & few), percent)]
        large = now.where((F.col("size") > SMALL) & ~few)
        if not large.limit(1).count():
            break
        if level == LEVELS:
            blocks.append(large.select(*_BLOCKED))
            break
        own = large if level else large.join(classes.select("key", "tokens"), "key")
        children = common.stage(_mixed(common.stage(_branched(own, level), f"{path}/children{level}")), f"{path}/below{level}")
        common.drop_path(spark, f"{path}/children{level}")
        worth = common.stage(_worth_branching(large, children), f"{path}/worth{level}")
        blocks.append(common.spread_join(large, worth.where(~F.col("worth")), "path", "key").select(*_BLOCKED))
        level += 1
        now = common.spread_join(children, worth.where("worth").select(F.col("path").alias("parent")), "parent", "key")
        now = common.stage(now, f"{path}/mixed{level}")
    every = common.stage(functools.reduce(DataFrame.union, pairs).distinct(), f"{path}/met")
    common.release(spark)
    promising = common.stage(_promising(every, classes, percent), f"{path}/pairs2")
    large = common.stage(functools.reduce(DataFrame.union, blocks), f"{path}/large") if blocks else None
    involved = _keys_of(promising)
    if large is not None:
        involved = involved.union(large.select("key"))
    found = _members(common.stage(involved.distinct(), f"{path}/keys2"), classes, docs, id_col, text_col, words_each, f"{path}/sets2")
    links = _verified(promising, found, percent, f"{path}/pass2")
    told = common.spread_join(links, labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a", "b")
    across = common.spread_join(told, labels.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b", "a")
    across = across.where(F.col("la") != F.col("lb")).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    if large is not None:
        across = across.union(common.stage(_linked_in_blocks(large, found, percent).distinct(), f"{path}/blocks"))
    across = common.stage(across, f"{path}/across")
    common.drop_path(spark, f"{path}/sets2")
    return _merged(labels, across, f"{path}/connect2")


def _merged(labels: DataFrame, across: DataFrame, path: str) -> DataFrame:
    """``labels`` (key, label) after links (a, b) between labels, staged."""
    joined = _connect(across, path).select(F.col("key").alias("label"), F.col("label").alias("top"))
    merged = common.spread_join(labels, joined, "label", "key", "left")
    return common.stage(merged.select("key", F.coalesce("top", "label").alias("label")), f"{path}/merged")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct runs
    of ``words_each`` words (the whole sequence of a shorter text). Sets are linked if 100 *
    intersection >= ``percent`` * union; component_id is the least doc_id reachable, kept
    whether it is the row's own. Empty and null texts are linked with nothing. Rows that
    repeat an id are one document: their texts' components are one. Rows without id are not
    united by that and are kept; they are told the component of their text. All links found
    are confirmed on full sets. A link at the very threshold is missed in all trees with a
    chance of (1 - 0.75**2)**16, about 2e-6, in nodes that are not branched, and 1e-6 where
    sketches are compared first. Below branched nodes trees share tokens and are not
    independent: drawing tokens at random (60,000 pairs a depth), a pair of similarity 0.75
    was missed with a chance of 0.0003 two levels deep and 0.001 from five levels on, one of
    0.8 of 0.0001 at most. Comparing what LEVELS of branching leave large takes time with the
    square of its classes.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    path = common.workspace(spark, "near-dedup")
    signed = common.stage(signatures(docs, F.monotonically_increasing_id(), id_col, text_col, words_each), f"{path}/signed")
    labels = _text_components(signed, docs, id_col, text_col, words_each, percent, path)
    rows = common.stage(common.spread_join(signed.select("uid", "doc_id", "key", "n"), labels, "key", "uid"), f"{path}/rows")
    # texts of one id are one document
    several = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "label").distinct()
    least = several.groupBy("doc_id").agg(F.min("label").alias("a"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    least = common.stage(least.select("doc_id", "a"), f"{path}/repeated")
    if least.limit(1).count():
        told = common.spread_join(rows, least, "doc_id", "uid").where(F.col("a") != F.col("label")).select("a", F.col("label").alias("b"))
        of_label = rows.select(F.col("label").alias("key"), "label").distinct()
        united = _merged(common.stage(of_label, f"{path}/labels2"), told.distinct(), f"{path}/connect3")
        rows = common.spread_join(rows, united.select(F.col("key").alias("label"), F.col("label").alias("top")), "label", "uid").withColumn("label", F.col("top"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component"))
    found = common.spread_join(rows, least, "label", "uid").select("doc_id", "n", "component")
    # empty sets have no class
    empty = signed.where(F.col("tokens").isNull()).select("doc_id", "n", F.col("doc_id").alias("component"))
    return found.union(empty).select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component of texts.

    That with the least id stays, of equal ids the one with the least set key and row
    number; rows without id come last. Rows are told apart by a number of their own, so a
    text is never dropped because another row has its id. Rows with empty and null texts
    stay; an empty table stays empty.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    path = common.workspace(spark, "near-dedup")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    words_each, percent = options.get("words_each", 5), options.get("percent", 75)
    docs, uid = common.numbered(docs, f"{path}/docs")
    own = f"{path}/own"
    signed = common.stage(signatures(docs, docs[uid], id_col, text_col, words_each), f"{own}/signed")
    labels = _text_components(signed, docs, id_col, text_col, words_each, percent, own)
    rows = common.stage(common.spread_join(signed.select("uid", "doc_id", "key"), labels, "key", "uid"), f"{own}/rows")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "uid")).alias("best"))
    gone = common.spread_join(rows, best, "label", "uid").where(F.col("uid") != F.col("best.uid")).select(F.col("uid").alias(uid))
    gone = common.stage(gone, f"{path}/gone")
    common.drop_path(spark, own)
    return docs.join(gone, uid, "left_anti").drop(uid)
