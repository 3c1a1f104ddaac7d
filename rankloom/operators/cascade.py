"""Deletes that follow declared references between tables.

A reference says what happens to rows whose parent goes: they go too (``cascade``), or lose their link (``null``). One of
kind ``last`` works the other way round: a parent goes with the last row that refers to it. Tables are taken in the
order in which deletes travel; only keys travel (anti- and semi-joins), rows never meet more than the keys they name.
References that form a ring are walked again until no further key goes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import checkpointed


@dataclass(frozen=True)
class Reference:
    """``table.column`` names the rows of ``parent`` by ``key``."""

    table: str
    column: str
    parent: str
    key: str = "id"
    deleted: str = "cascade"

    @property
    def travels(self) -> tuple[str, str]:
        return (self.table, self.parent) if self.deleted == "last" else (self.parent, self.table)


#: The references between the screening tables; a candidate goes with the last résumé.
REFERENCES = (
    Reference("job_skills", "job_id", "jobs"),
    Reference("resumes", "job_id", "jobs"),
    Reference("resumes", "candidate_id", "candidates", deleted="null"),
    Reference("resumes", "candidate_id", "candidates", deleted="last"),
    Reference("candidate_analysis", "job_id", "jobs"),
    Reference("candidate_analysis", "resume_id", "resumes"),
    Reference("candidate_analysis", "candidate_id", "candidates"),
    Reference("shortlists", "job_id", "jobs"),
    Reference("shortlists", "candidate_id", "candidates"),
    Reference("processing_queue", "job_id", "jobs"),
    Reference("processing_queue", "resume_id", "resumes"),
    Reference("embeddings", "job_id", "jobs"),
    Reference("embeddings", "resume_id", "resumes"),
    Reference("job_embeddings", "job_id", "jobs"),
)


def travel_order(tables: Sequence[str], references: Sequence[Reference]) -> tuple[list[str], bool]:
    """Tables so that deletes travel forwards, and whether they can also travel back (a ring)."""
    before: dict[str, set[str]] = {t: set() for t in tables}
    for r in references:
        start, end = r.travels
        if r.deleted != "null":  # a lost link deletes nothing
            before[end].add(start)
    try:
        return list(TopologicalSorter(before).static_order()), False
    except CycleError:
        return list(tables), True


def deleted(tables: dict[str, DataFrame], gone: dict[str, DataFrame], references: Sequence[Reference] = REFERENCES) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after the rows of ``gone`` (table: one column of the same name as its key) and all that hangs on them
    are removed, and the removed rows of each table. Tables without rows to lose come back as they are."""
    known = [r for r in references if r.table in tables and r.parent in tables and r.column in tables[r.table].columns and r.key in tables[r.parent].columns]
    order, ring = travel_order(list(tables), known)
    # What to remove, as (column, values) of each table.
    hit: dict[str, list[tuple[str, DataFrame]]] = {t: [(df.columns[0], df.distinct())] for t, df in gone.items()}
    seen = None
    while True:
        out, lost = _walked(tables, order, known, hit)
        if not ring:
            break
        # In a ring, keys found late may delete rows of tables walked before: these are walked again.
        for r in known:
            start, _ = r.travels
            if start in lost and r.deleted == "cascade":
                values = checkpointed(lost[start].select(F.col(r.key).alias(r.column)).where(F.col(r.column).isNotNull()).distinct())
                hit.setdefault(r.table, [])
                hit[r.table] = [h for h in hit[r.table] if h[0] != f"{r.column}<{r.parent}"] + [(f"{r.column}<{r.parent}", values)]
        counts = {t: df.count() for t, df in lost.items()}
        if counts == seen:
            break
        seen = counts
    for r in known:
        if r.deleted == "null" and r.parent in lost:
            values = lost[r.parent].select(F.col(r.key).alias("_gone")).distinct()
            linked = out[r.table].join(values, F.col(r.column) == F.col("_gone"), "left")
            out[r.table] = linked.withColumn(r.column, F.when(F.col("_gone").isNull(), F.col(r.column))).select(*tables[r.table].columns)
    return out, lost


def _walked(tables: dict[str, DataFrame], order: list[str], known: Sequence[Reference], hit: dict[str, list[tuple[str, DataFrame]]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """One walk in ``order``: what is kept and what is lost of each table."""
    out, lost = dict(tables), {}
    for name in order:
        found = list(hit.get(name, []))
        for r in known:
            start, end = r.travels
            if end != name or start not in lost:
                continue
            if r.deleted == "cascade":
                found.append((r.column, lost[start].select(F.col(r.key).alias(r.column))))
            elif r.deleted == "last":
                named = lost[start].select(F.col(r.column).alias(r.key)).where(F.col(r.key).isNotNull()).distinct()
                found.append((r.key, named.join(out[start].select(F.col(r.column).alias(r.key)), r.key, "left_anti")))
        if not found:
            continue
        df = tables[name]
        by = {}  # keys of one column are joined at once
        for column, values in found:
            column = column.partition("<")[0]
            values = values.select(F.col(values.columns[0]).alias(column))
            by[column] = by[column].unionByName(values) if column in by else values
        keys = {c: v.distinct() for c, v in by.items()}
        out[name] = reduce(lambda rows, c: rows.join(keys[c], c, "left_anti"), keys, df).select(*df.columns)
        # Rows named by several columns are lost once: each by the first that names it.
        parts, left = [], df
        for c in keys:
            parts.append(left.join(keys[c], c, "left_semi").select(*df.columns))
            left = left.join(keys[c], c, "left_anti")
        lost[name] = reduce(DataFrame.unionByName, parts)
    return out, lost
