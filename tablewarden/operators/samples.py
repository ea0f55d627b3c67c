"""First failing rows of failed checks, in source order. Fetched only for checks that failed.

Only failing rows are numbered: each knows its partition and its place there, the first few are taken in this
order, and the driver adds the number of rows in the partitions before. The order is that of the source when it
is one file; for several files it is the scan's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "__row"
_PART, _PLACE = "__part", "__place"


def located(frame: DataFrame) -> DataFrame:
    """The frame with each row's partition and its place there, from 0. A source that numbers its rows itself is
    one partition."""
    if ROW in frame.columns:
        return frame.withColumns({_PART: F.lit(0), _PLACE: F.col(ROW) - 1})
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return frame.withColumns({_PART: F.spark_partition_id(), _PLACE: inside})


def partition_sizes(frame: DataFrame) -> dict[int, int]:
    """Rows by partition: one row each reaches the driver."""
    if ROW in frame.columns:
        return {}
    return {r["p"]: r["n"] for r in frame.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def after_first(frame: DataFrame, n: int) -> DataFrame:
    """The frame without its first ``n`` rows."""
    part, left = 0, n
    sizes = partition_sizes(frame)
    for part in sorted(sizes):
        if sizes[part] > left:
            break
        left -= sizes[part]
    rows = located(frame)
    return rows.where((F.col(_PART) > part) | (F.col(_PART) == part) & (F.col(_PLACE) >= left)).drop(_PART, _PLACE)


def _numbered(rows: list, sizes: Callable[[], dict[int, int]]) -> list[dict]:
    before, total, counted = {}, 0, sizes() if rows else {}
    for p in sorted(counted):
        before[p], total = total, total + counted[p]
    return [{"row": before.get(r[_PART], 0) + r[_PLACE] + 1, "value": r["value"]} for r in rows]


def first_rows(frame: DataFrame, bad: Column, value: Column, n: int, sizes: Callable[[], dict[int, int]]) -> list[dict]:
    """Up to ``n`` rows of a located frame for which ``bad`` holds, by row number."""
    rows = frame.where(bad).select(_PART, _PLACE, value.cast("string").alias("value")).orderBy(_PART, _PLACE).limit(n).collect()
    return _numbered(rows, sizes)


def repeated_rows(frame: DataFrame, key: list[Column], value: Column, n: int, sizes: Callable[[], dict[int, int]]) -> list[dict]:
    """Second and later rows of a key in a located frame. Keys that repeat are found first, so that only their rows
    are ordered."""
    names = [f"__k{i}" for i in range(len(key))]
    keyed = frame.select(_PART, _PLACE, value.cast("string").alias("value"), *(k.alias(c) for k, c in zip(key, names, strict=True))).dropna(subset=names)
    place = F.struct(_PART, _PLACE)
    repeats = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select(*names, "first")
    rows = keyed.join(repeats, names).where(place > F.col("first")).orderBy(_PART, _PLACE).limit(n).collect()
    return _numbered(rows, sizes)


def repeats_frame(frame: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All second and later occurrences of a key, by an explicit order: the rows a `unique` check rejects."""
    w = Window.partitionBy(*key).orderBy(*order)
    return frame.dropna(subset=key).withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")
