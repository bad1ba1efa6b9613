"""Operators on sequences of frames that stand alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames_window(*keys: str):
    return Window.partitionBy(*(keys or ("match_id",))).orderBy("frame_idx")


def known_before(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def debounce(rows: DataFrame, keys: list[str], gap: int | float, strict: bool = True, order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Rows accepted one after another: each must lie more than gap (at least gap, if not strict) behind the last
    accepted row of its keys. A fold over each key's candidates, which are few; order[0] is the frame."""
    rest = [c for c in rows.columns if c not in keys]
    inner = [*order, *[c for c in rest if c not in order]]
    held = F.array_sort(F.collect_list(F.struct(*inner)))
    listed = rows.groupBy(*keys).agg(held.alias("_all"))
    test = f"x.{order[0]} - element_at(acc, -1).{order[0]} {'>' if strict else '>='} {gap}"
    fold = f"aggregate(slice(_all, 2, size(_all)), slice(_all, 1, 1), (acc, x) -> CASE WHEN {test} THEN array_append(acc, x) ELSE acc END)"
    return listed.select(*keys, F.expr(f"inline({fold})")).select(rows.columns)


def islands(rows: DataFrame, value: str, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """Runs of equal values, null runs included: keys, seg_id, value, start, end."""
    w = frames_window(*keys)
    first = F.row_number().over(w) == 1
    changed = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    numbered = rows.withColumn("_new", changed)
    numbered = numbered.withColumn("seg_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "seg_id").agg(F.first(value).alias(value), F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"))
