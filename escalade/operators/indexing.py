"""Positions 0, 1, 2, ... for rows of a table without a key, by a total order.

Rows are dealt by ranges of the order and sorted within each; a row's number in its range is
fixed by writing it. The ranges' sizes are counted, and a position is the number of rows in the
ranges before plus the number in the own range. No task sees more than its range, and no window runs
over everything. Equal rows are told apart by their place in the input, so they can't pile up in one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.session import materialize

# Bits of ``monotonically_increasing_id`` that hold the row's number in its partition.
_ROW_BITS = 33


def positional_index(df: DataFrame, order: Sequence[str | Column], out: str = "position", start: int = 0,
                     ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the rows' positions by ``order`` (gapless, from ``start``).

    Rows that are equal in ``order`` come in some fixed order. ``ranges`` is the number of
    partitions (default: the session's shuffle partitions).
    """
    if out in df.columns:
        raise ValueError(f"the input has a column {out} already")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(n, *order, F.col("__place"))
    ordered = dealt.sortWithinPartitions(*order, F.col("__place"))
    own = F.monotonically_increasing_id()  # of the sorted rows: range number and row number
    fixed = materialize(ordered.select(*df.columns, F.shiftright(own, _ROW_BITS).cast("int").alias("__range"),
                                       own.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__row")), "positions")
    sizes = {r["__range"]: r["n"] for r in fixed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    last = max(sizes, default=-1)
    before = [start, *accumulate((sizes.get(k, 0) for k in range(last + 1)), initial=start)][1:]
    offsets = df.sparkSession.createDataFrame(list(enumerate(before)), "__range int, __before long")
    return fixed.join(F.broadcast(offsets), "__range").select(*df.columns, (F.col("__before") + F.col("__row")).alias(out))
