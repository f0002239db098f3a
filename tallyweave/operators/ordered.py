"""Running values over long ordered groups, without a task that holds a whole group.

A plain window with an ordered frame sends each group to one task.  Here rows
are cut into blocks by position; each block is scanned on its own, block totals
are scanned a level up, and the carry is joined back.  A group of any length is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _combine(kind: str, before: Column, own: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))
    # Running maximum; structs compare field by field.
    return F.when(before.isNull() | (own > before), F.coalesce(own, before)).otherwise(before)


def _exclusive(df: DataFrame, group: Sequence[str], order: Sequence[str], kinds: Mapping[str, str], blocks: Sequence[str]):
    """Add ``_before_<name>``: the running value over the rows ahead of each row."""
    totals = {"sum": F.sum, "max": F.max}
    inside = list(group) + list(blocks)
    frame = Window.partitionBy(*inside).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"_before_{n}": totals[k](n).over(frame) for n, k in kinds.items()})
    if not blocks:
        return local
    sums = df.groupBy(*inside).agg(*[totals[k](n).alias(n) for n, k in kinds.items()])
    carried = _exclusive(sums, group, [blocks[0]], kinds, blocks[1:])
    carried = carried.select(*inside, *[F.col(f"_before_{n}").alias(f"_carry_{n}") for n in kinds])
    joined = local.join(carried, inside, "left")
    merged = {f"_before_{n}": _combine(k, F.col(f"_carry_{n}"), F.col(f"_before_{n}")) for n, k in kinds.items()}
    return joined.withColumns(merged).drop(*[f"_carry_{n}" for n in kinds])


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    position: Column,
    block_rows: int = 4096,
    levels: int = 2,
    keep_blocks: bool = False,
) -> DataFrame:
    """Add one running column per entry of ``values``, the current row included.

    ``values`` maps a new column to ``("sum" | "max", expression)``.  A running
    maximum over ``struct(order, payload)`` is a forward fill.  ``position`` is
    an integer that never falls along ``order``; rows of a block share
    ``position div block_rows``.  Group columns must not be NULL.

    With ``keep_blocks`` the block columns stay for a second call over the same
    rows, which then finds them partitioned and sorted as it needs them.
    """
    kinds = {name: kind for name, (kind, _) in values.items()}
    blocks = [f"_block_{i}" for i in range(levels)]
    cut = {b: F.floor(position / F.lit(block_rows ** (i + 1))).cast("long") for i, b in enumerate(blocks)}
    base = df.withColumns({name: expr for name, (_, expr) in values.items()})
    if not set(blocks) <= set(df.columns):
        base = base.withColumns(cut)
    scanned = _exclusive(base, group, order, kinds, blocks)
    done = scanned.withColumns({n: _combine(k, F.col(f"_before_{n}"), F.col(n)) for n, k in kinds.items()})
    return done.drop(*([] if keep_blocks else blocks), *[f"_before_{n}" for n in kinds])
