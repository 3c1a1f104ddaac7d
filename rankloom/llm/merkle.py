"""Merkle manifest of a dataset: a digest and a proof of membership for every row.

Leaves are digests of rows. Within each group (``by``), leaves in order of ``order`` are the lowest
level of a tree: while a level has several nodes, every ``fan`` consecutive ones (the last run: fewer, even
one) become the digest of their joined hex texts. The groups' last nodes, in order of the groups (null
first, then by UTF-8 bytes), are the lowest level of one more tree, which ends in the root.

Positions come from one range partitioning and a running number in each task, shifted by
the rows of the same group in earlier tasks; only a task's first group can have any, so the shifts are as many rows
as tasks. Leaves are then dealt out in aligned blocks of ``block`` (a power of ``fan``). A task traverses its block
postorder: a call returns its subtree's digest and, while unwinding, appends the siblings of
each child to the leaves below. Block roots are the nodes of the next traversal, distributed
alike, until each group has one; then siblings come back down the same blocks, a parent's joining those
found in its block. So texts are never shuffled, no task holds more than a block's siblings, and a group that
holds most rows is only more blocks. Rows and block roots are staged; lost executors repeat their tasks only.

Edge cases: a null field is ``-`` in its row's digest, so null and empty differ. Rows without ``order``
come first in their group; equal ones are ordered by their digests, and equal rows are interchangeable. A group
of one row is that row's digest, with no proof below the groups; the only row of a table is the root and its proof is
empty. An empty table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import drop_tables, prepare, staged, tables_mark, tables_since

FAN, BLOCK = 16, 256
PROOF = "array<struct<before:string,after:string>>"
_ARROW_PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf_digest(*fields: Column | str) -> Column:
    """Lowercase hex sha256 of the fields' texts, each as byte count, ``:`` and value; ``-`` if null."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof joined, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def depth(leaves: int, block: int, number: int, fan: int) -> int:
    """Levels above the ``leaves`` of a block; only the first block of a tree may be shallow, as it may be the only one."""
    reach, levels = 1, 0
    while reach < (leaves if number == 0 else block):
        reach, levels = reach * fan, levels + 1
    return levels


def traversed(nodes: list[str], levels: int, fan: int, proofs: list[list[tuple[str, str]]] | None = None, at: int = 0) -> str:
    """Digest of the subtree of ``levels`` over ``nodes`` from ``at`` on; appends to ``proofs`` what stands beside each node's ancestors."""
    if not levels:
        return nodes[at]
    step = fan ** (levels - 1)
    starts = range(at, min(at + fan * step, len(nodes)), step)
    children = [traversed(nodes, levels - 1, fan, proofs, s) for s in starts]
    if proofs is not None:
        for i, s in enumerate(starts):
            beside = ("".join(children[:i]), "".join(children[i + 1 :]))
            for own in proofs[s : s + step]:
                own.append(beside)
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the position within their group ``g`` by ``order``; staged."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            at, heads, start = [], [], 0
            runs = pc.run_end_encode(batch.column("g"))
            for g, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if g != last:
                    head = last is None
                    last, seen = g, 0
                at += range(seen, seen + end - start)
                heads += [head] * (end - start)
                seen, start = seen + end - start, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(heads, pa.bool_())], names=[*batch.schema.names, "task", "within", "head"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = staged(dealt.mapInArrow(number, f"{kinds}, task int, within long, head boolean"), "merkle-placed")
    runs = placed.groupBy("task", "g").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.withColumn("before", before).where(F.col("head") & F.col("before").isNotNull()).select("task", "g", "before")  # one a task at most
    at = F.col("within") + F.coalesce("before", F.lit(0))
    return placed.join(F.broadcast(shifts), ["task", "g"], "left").select(*rows.columns, at.alias("at"))


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("b", F.floor(F.col("at") / block))


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("at").combine_chunks()


def _climbed(nodes: DataFrame, block: int, fan: int) -> list[DataFrame]:
    """``nodes`` (g, at, h), then the roots of its blocks, their blocks' and so on until each group has one."""

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        own = _sorted(rows)["h"].to_pylist()
        root = traversed(own, depth(len(own), block, key[1].as_py(), fan), fan)
        return pa.table({"g": pa.array([key[0].as_py()]), "at": pa.array([key[1].as_py()], pa.int64()), "h": pa.array([root])})

    levels = [nodes]
    while not levels[-1].where("at > 0").isEmpty():
        blocks = _in_blocks(levels[-1].select("g", "at", "h"), block).groupBy("g", "b")
        levels.append(staged(blocks.applyInArrow(fold, "g string, at long, h string"), "merkle-blocks"))
    return levels


def _descended(nodes: DataFrame, parents: DataFrame, block: int, fan: int, carried: list[str]) -> DataFrame:
    """``nodes`` with ``top`` and ``proof``: their parents' (g, at, top, proof) after the siblings found in their own block."""

    def join(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        own, proofs = rows["h"].to_pylist(), [[] for _ in range(rows.num_rows)]
        traversed(own, depth(len(own), block, key[1].as_py(), fan), fan, proofs)
        rest = [(p["before"], p["after"]) for p in above["proof"][0].as_py()]
        whole = pa.array([[{"before": b, "after": a} for b, a in [*p, *rest]] for p in proofs], _ARROW_PROOF)
        return rows.select(["g", "at", "h", *carried]).append_column("top", pa.array([above["top"][0].as_py()] * len(own), pa.string())).append_column("proof", whole)

    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in ("g", "at", "h", *carried))
    left = _in_blocks(nodes.select("g", "at", "h", *carried), block).groupBy("g", "b")
    right = parents.select("g", F.col("at").alias("b"), "top", "proof").groupBy("g", "b")
    return left.cogroup(right).applyInArrow(join, f"{kinds}, top string, proof {PROOF}")


def merkle_manifest(rows: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), order: str = "doc_id", by: str = "source", carry: dict[str, Column] | None = None, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """``order``, ``carry``'s columns, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row: for each level
    that a leaf's ancestors are hashed at, the digests before and after, up to the root."""
    spark = rows.sparkSession
    prepare(spark)
    mark = tables_mark()
    extra = carry or {}
    carried = ["_id", *(f"_c{i}" for i in range(len(extra)))]
    column = lambda c: F.col(f"`{c}`")
    group = F.coalesce(F.concat(F.lit("s"), column(by).cast("string")), F.lit("n"))
    leaves = rows.select(group.alias("g"), column(order).alias("_id"), leaf_digest(*fields).alias("h"), *(c.alias(f"_c{i}") for i, c in enumerate(extra.values())))
    # The salt parts equal rows; texts are read once, here.
    leaves = staged(leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    own = _climbed(_numbered(leaves, ["_id", "h", "_salt"]), block, fan)
    subroots = own[-1].select(F.lit("t").alias("g"), F.col("g").alias("_of"), "h")
    top = _climbed(_numbered(subroots, ["_of"]), block, fan)
    root = top[-1].first()
    if root is None:
        drop_tables(spark, tables_since(mark))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(column(order), *(c.alias(n) for n, c in extra.items())).schema.fields)
        return spark.createDataFrame([], f"{kinds}, leaf string, subroot string, root string, proof {PROOF}")
    paths = top[-1].withColumns({"top": F.col("h"), "proof": F.array().cast(PROOF)})
    for nodes in reversed(top[:-1]):
        paths = _descended(nodes, paths, block, fan, ["_of"] if "_of" in nodes.columns else [])
    paths = paths.select(F.col("_of").alias("g"), F.lit(0).cast("long").alias("at"), F.col("h").alias("top"), "proof")
    if len(own) == 1:  # each group is one leaf
        paths = own[0].join(paths.select("g", "top", "proof"), "g")
    for nodes in reversed(own[:-1]):
        paths = _descended(nodes, paths, block, fan, carried if "_id" in nodes.columns else [])
    names = dict(zip(carried, [order, *extra], strict=True))
    return paths.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("h").alias("leaf"), F.col("top").alias("subroot"), F.lit(root["h"]).alias("root"), "proof")
