"""The layout rebuilding of ``functions.layout`` over rows, in JVM expressions.

What is told of a token needs its next two at most, and a header or bullet and the words behind it stand for themselves: so
a text is rebuilt where it is read. No token becomes a row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.layout import STORED, Layout, normalized
from rankloom.session import spread


def overlap_rounds(layout: Layout) -> int:
    """How many wide headers can overlap in a row: a header that begins inside another one is none."""
    words = [w.split() for w in layout.wide]
    after = {i: [j for j, b in enumerate(words) if any(a[k:] == b[: len(a) - k] for k in range(1, len(a)))] for i, a in enumerate(words)}
    rounds, ends = 1, set(after)
    while ends := {j for i in ends for j in after[i]}:
        rounds += 1
        if rounds > 8:
            raise ValueError("wide headers overlap in a ring")
    return rounds


def rebuilt_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", layout: Layout = STORED) -> DataFrame:
    """``key`` and ``text`` of every row, rebuilt as ``functions.layout.rebuilt`` does; headers that overlap in a ring are refused."""
    overlap_rounds(layout)
    return spread(docs.select(key, text)).select(key, normalized(F.col(text), layout).alias("text"))
