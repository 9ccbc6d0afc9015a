"""Running sums and last values over long ordered groups, without one window over a whole group.

Level one: a group is cut into segments, and windows run inside each.  Level
two: one row for each segment carries its sums and last values, and a window
over these few rows tells every segment what came before it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(
    rows: DataFrame,
    keys: list[str],
    order: str,
    segment: int,
    sums: Mapping[str, Column],
    sums_at_last: Mapping[str, tuple[Column, str]] | None = None,
    last_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """rows with running values of each group of keys in the order of a number that counts from 0.

    sums: the sum of a value up to the row itself.  sums_at_last: of (condition,
    name of a sum) that sum's value at the last row up to this one where the
    condition holds, else null.  last_before: the last value that isn't null of
    the rows before this one, else null.  A segment has ``segment`` numbers.
    """
    at, before_values = dict(sums_at_last or {}), dict(last_before or {})
    cut = rows.withColumn("_seg", F.floor(F.col(order) / segment))
    within = Window.partitionBy(*keys, "_seg").orderBy(order)
    so_far, before = within.rowsBetween(Window.unboundedPreceding, Window.currentRow), within.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({n: F.sum(c).over(so_far) for n, c in sums.items()})
    local = local.withColumns({n: F.last(F.when(c, F.col(s)), ignorenulls=True).over(so_far) for n, (c, s) in at.items()} | {n: F.last(c, ignorenulls=True).over(before) for n, c in before_values.items()})
    ends = [F.max_by(n, order).alias(f"_{n}") for n in [*sums, *at]]
    ends += [F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_{n}") for n, c in before_values.items()]
    state = local.groupBy(*keys, "_seg").agg(*ends)
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumns({f"_{n}_c": F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)) for n in sums})
    # a sum at a segment's last such row counts from the group's start once what came before the segment is added
    carries = {f"_{n}_c": F.last(F.col(f"_{n}") + F.col(f"_{s}_c"), ignorenulls=True).over(earlier) for n, (_, s) in at.items()}
    carries |= {f"_{n}_c": F.last(f"_{n}", ignorenulls=True).over(earlier) for n in before_values}
    names = [*sums, *at, *before_values]
    state = state.withColumns(carries).select(*keys, "_seg", *[f"_{n}_c" for n in names])
    whole = {n: F.col(n) + F.col(f"_{n}_c") for n in sums}
    whole |= {n: F.coalesce(F.col(n) + F.col(f"_{s}_c"), F.col(f"_{n}_c")) for n, (_, s) in at.items()}
    whole |= {n: F.coalesce(n, f"_{n}_c") for n in before_values}
    return local.join(state, [*keys, "_seg"]).withColumns(whole).drop("_seg", *[f"_{n}_c" for n in names])
