"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

Texts are word sequences; equal sequences are one node, whatever their number. A node
has ``trees`` label sequences of ``depth`` min-hashes of its word shingles. The sequences of
all trees are range-partitioned and sorted, so each tree is a prefix trie in sorted order and
the common prefix of neighbours is that of their subtrees.

Matched prefixes start at the full depth and are shortened in two ways. In each trie
a prefix is cut shorter while at most ``crowd`` nodes share it: sparse places give up depth and
gain recall at no cost, crowded ones keep it. A node misses a similar node with chance
prod(1 - s^cut) over its trees at the threshold similarity s; a node whose miss is above
1 - ``recall`` shortens its crowded prefixes too, level by level, to the deepest level at which
it is not. A pair meets under the longer of its two levels, so every node keeps its recall.

Nodes that share a prefix are candidates. For the comparison, nodes lie in blocks of about
``block`` nodes (by the smallest node that two steps over shared prefixes reach; only the
layout depends on it), and two blocks are compared if some prefix has nodes of both.
As blocks are disjoint, a pair meets once, whatever the number of prefixes it shares. A task
compares two blocks exactly, words and not hashes, by matrix products, and gives for each node
its number of links and one link to its group, never a row for each pair. So a large group
is spread over many tasks of bounded memory. Classes are the components of verified links.

Result: one row per document: its class (the smallest id that chains of links reach),
its number of links (documents with similarity at or above the threshold, copies
counted), its class's size, ``stays`` (rows of one id and text of each class) and ``text_hash``.

Edge cases: a text of fewer words than a shingle is one shingle of all its words and links to
its copies only; null and blank texts have no words, they are copies of each other and link
to nothing else; null ids are kept, a class of null ids only has a null id; repeated (id,
text) rows are copies; very long texts are compared whole, a block closes early at 400
shingles a node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import SPACE_CLASS, drop_tables, sliced, prepare, staged, tables_mark, tables_since
from rankloom.llm.components import connected_components

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Sorted label sequences of a task that are cut together.
CHUNK_ROWS = 1 << 16


def split_words(text: str | None) -> list[bytes]:
    """Words between characters of [\\x20\\x09-\\x0D], as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def words_hash(words: list[bytes]) -> str:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).hexdigest()


def text_hash(text: Column) -> Column:
    """``words_hash`` of a text, in Spark's own functions."""
    return F.md5(F.btrim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE_CLASS}]+", " "), F.lit(" ")).cast("binary"))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word windows; none for fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s = s * _MUL + h[k : len(h) - n + 1 + k]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ s >> np.uint64(32))


def prefix_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, from ``depth`` down, at which a forest cut everywhere alike reaches the recall."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


class Forest:
    """Label sequences: ``depth`` 16-bit labels for each of ``trees`` trees."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = trees * depth
        self.a = (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        self.held = np.empty((n, 512), np.uint32)

    def labels(self, s: np.ndarray) -> bytes:
        s = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(s), 512):
            part = s[at : at + 512]
            h = np.multiply(self.a, part, out=self.held[:, : len(part)])
            h += self.b
            np.minimum(low, h.min(1), out=low)
        return (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16).tobytes()


def cuts(labels: np.ndarray, shortest: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix length of each of the sorted label sequences (column 0 is the tree), and whether
    another of them shares that prefix.

    The prefix is the shortest, from ``shortest`` labels on, that at most ``crowd`` of the
    sequences share, else the whole. Sequences under the first or the last prefix
    may go on in another chunk: they keep the whole on both sides.
    """
    n, depth = len(labels), labels.shape[1] - 1
    same = labels[1:] == labels[:-1]
    common = np.where(same.all(1), depth + 1, same.argmin(1)) - 1  # labels in common, -1: other trees
    cut, shared, open_ = np.full(n, depth), np.zeros(n, bool), np.ones(n, bool)
    for k in range(shortest, depth + 1):
        run = np.concatenate([[0], np.cumsum(common < k)])
        size = np.bincount(run)[run]
        if k == shortest:
            edge = (run == 0) | (run == run[-1])
            open_ &= ~edge
        fits = open_ & ((size <= crowd) | (k == depth))
        cut[fits], shared[fits] = k, size[fits] > 1
        open_ &= ~fits
    shared[edge] = True
    return cut, shared


def prefix_ids(labels: np.ndarray) -> np.ndarray:
    """A 64-bit name of each prefix, by row and number of labels (column 0 is the tree)."""
    out = np.zeros(labels.shape, np.uint64)
    h = np.zeros(len(labels), np.uint64)
    for k, column in enumerate(labels.T):
        h = (h ^ column ^ np.uint64(k << 32)) * _MUL
        h ^= h >> np.uint64(29)
        out[:, k] = h
    return out.view(np.int64)


def exact_sets(texts: list[list[bytes]], n: int) -> list[np.ndarray]:
    """The n-word windows of each text as numbers: equal numbers for equal windows, and for no others."""
    numbers: dict[bytes, int] = {}
    piece = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)

    def joined(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Numbers of a window (of ``width`` words) and the one that follows it."""
        m = max(0, len(b) - width)
        pairs = a[:m] * (b.max(initial=0) + 1) + b[width : width + m]
        return np.unique(pairs, return_inverse=True)[1]

    # Windows of 1, 2, 4, ... words, joined by the binary digits of n.
    whole, width, size = None, 0, 1
    while True:
        if n & size:
            whole = piece if whole is None else joined(whole, piece, width)
            width += size
        if size * 2 > n:
            break
        piece, size = joined(piece, piece, size), size * 2
    ends = np.cumsum([len(t) for t in texts])
    return [np.unique(whole[e - len(t) : e - n + 1]) if len(t) >= n else np.zeros(0, np.int64) for e, t in zip(ends.tolist(), texts, strict=True)]


def _verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix over ``left`` x ``right`` (indexes of ``sets``): Jaccard at or above the threshold."""
    sizes = np.array([len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[ids] > 1  # a shingle of one set only is in no intersection
    place = np.cumsum(counts > 1) - 1
    ids, owner = place[ids[shared]], owner[shared]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        a, b = np.searchsorted(ids, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], ids[a:b] - at] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (both >= threshold * union - 1e-6) & (both > 0)


def compared(sets: list[np.ndarray], copies: np.ndarray, first: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and a local group (smallest index) of each node. In a block
    against itself (``same``) all pairs count, otherwise only those of a node of the first
    block and one of the second: none if one of the blocks is empty."""
    n = len(sets)
    if not same and (first.all() or not first.any()):
        return np.zeros(n, np.int64), np.arange(n)
    left, right = (np.arange(n), np.arange(n)) if same else (np.flatnonzero(first), np.flatnonzero(~first))
    ok = _verified(sets, left, right, threshold)
    if same:
        np.fill_diagonal(ok, False)
    links = np.zeros(n, np.int64)
    links[left] += ok @ copies[right]
    if not same:
        links[right] += ok.T @ copies[left]
    group = np.arange(n)
    while True:
        before = group.copy()
        group[left] = np.minimum(group[left], np.where(ok, group[right][None, :], n).min(1, initial=n))
        group[right] = np.minimum(group[right], np.where(ok, group[left][:, None], n).min(0, initial=n))
        if (before == group).all():
            return links, group


def shared_prefixes(nodes: DataFrame, trees: int, depth: int, threshold: float, recall: float, crowd: int) -> DataFrame:
    """``prefix`` (a name) and ``node`` for all prefixes under which nodes meet; ``nodes`` has ``node`` and ``labels``."""
    level = prefix_depth(trees, depth, threshold, recall)
    shortest = max(1, level - 1)
    size = 2 * depth
    keys = nodes.where(F.octet_length("labels") > 0).select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    keys = keys.select("node", "tree", F.substring("labels", F.col("tree") * size + 1, F.lit(size)).alias("key"))
    tries = keys.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            labels = np.frombuffer(b"".join(t["key"].to_pylist()), np.uint16).reshape(-1, depth)
            labels = np.concatenate([t["tree"].to_numpy()[:, None].astype(np.uint16), labels], 1)
            cut, shared = cuts(labels, shortest, crowd)
            told = np.flatnonzero(shared | (cut > shortest))  # all others are alone at the shortest prefix
            names, cut, shared = prefix_ids(labels[told]), cut[told], shared[told]
            # Names from the level that reaches the recall everywhere down to the cut; 0 where a prefix is not shared.
            ids = [[*r[min(level, c) : c].tolist(), int(r[c]) if s else 0] for r, c, s in zip(names, cut.tolist(), shared.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(t["node"].to_numpy()[told]), pa.array(cut, pa.int32()), pa.array(ids, pa.list_(pa.int64()))], names=["node", "cut", "ids"])

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= CHUNK_ROWS:
                yield out()
                held = []
        if sum(len(b) for b in held):
            yield out()

    told = tries.mapInArrow(task, "node bigint, cut int, ids array<bigint>")
    # A node's miss with prefixes of at most k labels; trees that aren't told are cut at the shortest.
    of_node = Window.partitionBy("node")
    miss = lambda k: F.log(1 - F.pow(F.lit(threshold), k))
    total = lambda k: F.sum(miss(F.least("cut", F.lit(k)))).over(of_node) + (trees - F.count(F.lit(1)).over(of_node)) * miss(F.lit(shortest))
    reach = F.lit(level)
    for k in range(level + 1, depth + 1):
        reach = F.when(total(k) <= float(np.log(1 - recall)), F.lit(k)).otherwise(reach)
    settled = told.withColumn("reach", reach).select("node", "cut", "reach", F.posexplode("ids").alias("p", "prefix"))
    length = F.least(F.lit(level), "cut") + F.col("p")
    return settled.where((length >= F.least("reach", "cut")) & (F.col("prefix") != 0)).select("prefix", "node")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, trees: int = 32, depth: int = 9, recall: float = 0.9999, crowd: int = 16, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id``, ``n_links``, ``class_size``, ``stays`` and ``text_hash`` of every document."""
    prepare(docs.sparkSession)
    forest = Forest(trees, depth)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                w = split_words(text)
                s = shingles(w, shingle)
                cols[0].append(words_hash(w))
                cols[1].append(len(s))
                cols[2].append(forest.labels(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["id", "h", "n", "labels"])

    rows = staged(source.mapInArrow(signed, f"id {kind}, h string, n bigint, labels binary"), "forest-rows")
    # Nodes: one for each distinct word sequence, with its smallest id and its number of copies.
    nodes = staged(rows.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")).withColumn("node", F.monotonically_increasing_id()), "forest-nodes")
    mark = tables_mark()
    met = staged(shared_prefixes(nodes, trees, depth, threshold, recall, crowd), "forest-prefixes")
    met = met.join(met.groupBy("prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1"), "prefix")
    # Layout: two steps to the smallest node under shared prefixes.
    once = met.groupBy("node").agg(F.min("head").alias("near"))
    near = staged(met.select("prefix", "node").join(once, "node"), "forest-near")
    twice = near.join(near.groupBy("prefix").agg(F.min("near").alias("home")), "prefix").groupBy("node").agg(F.min("home").alias("home"))
    sized = twice.join(nodes.select("node", "rep", "h", "copies", "n"), "node")
    parts = sized.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / F.lit(400.0 * block))).alias("parts"))
    placed = sized.join(parts, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))))
    placed = staged(placed.select("node", "rep", "h", "copies", "block"), "forest-blocks")
    # Two blocks meet if a prefix has nodes of both; a block always meets itself.
    # The blocks under a prefix are rows and not a list, so one that very many blocks share is a skewed join key, which is split.
    under = staged(near.select("prefix", "node").join(placed.select("node", "block"), "node").select("prefix", "block").distinct(), "forest-under")
    several = under.join(under.groupBy("prefix").count().where("count > 1").select("prefix"), "prefix")
    pairs = several.withColumnRenamed("block", "i").join(under.withColumnRenamed("block", "j"), "prefix").where("i < j").select("i", "j").distinct()
    pairs = staged(pairs.unionByName(placed.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct()), "forest-pairs")
    ends = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    # Candidates grow with the corpus, so this join always deals out by id, also where they would fit a broadcast.
    texts = source.join(placed.hint("merge"), source["id"].eqNullSafe(placed["rep"])).select("node", "h", "copies", "block", "t")
    paired = texts.join(ends.hint("merge"), "block").select("i", "j", "node", "h", "copies", (F.col("block") == F.col("i")).alias("first"), "t")
    dealt = paired.repartition("i", "j").sortWithinPartitions("i", "j", "node")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def close() -> tuple[list, list, list]:
            nodes_, found = list(group), list(group.values())
            if len(found) < 2:
                return [], [], []
            links, local = compared(exact_sets([f[2] for f in found], shingle), np.array([f[0] for f in found]), np.array([f[1] for f in found]), threshold, key[0] == key[1])
            at = np.flatnonzero(links)
            return [nodes_[k] for k in at], links[at].tolist(), [nodes_[local[k]] for k in at]

        for batch in sliced(batches):
            out: tuple[list, list, list] = ([], [], [])
            for i, j, node, h, copies, first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (i, j):
                    for col, x in zip(out, close(), strict=True):
                        col += x
                    key, group = (i, j), {}
                if node not in group:
                    w = split_words(text)
                    if words_hash(w) == h:  # another text may share the id
                        group[node] = (copies, bool(first), w)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "links", "to"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in close()], names=["node", "links", "to"])

    used = tables_since(mark)
    links = staged(dealt.mapInArrow(verified, "node bigint, links bigint, to bigint"), "forest-links")
    drop_tables(docs.sparkSession, used)
    classes = connected_components(links.select(F.col("node").alias("u"), F.col("to").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "h", "rep", "copies").join(classes, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The class's row: the smallest id (null ids last), then the smallest hash.
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h"))
    total = known.groupBy("root").agg(best.alias("best"), F.sum("copies").alias("class_size"))
    result = known.join(total, "root").select("h", F.col("best.rep").alias("class_id"), "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("h") == F.col("best.h")).alias("elected"))
    own = rows.select("id", "h").join(result, "h")
    stays = F.col("elected") & F.col("id").eqNullSafe(F.col("class_id"))
    return own.select(F.col("id").alias(id_col), "class_id", "n_links", "class_size", stays.alias("stays"), F.col("h").alias("text_hash"))
