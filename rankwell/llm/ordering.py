"""Places of rows within their groups, for groups of any size.

Rows are range-partitioned by group and order, so that a group with a third of all rows
lies in several runs; each run is numbered as a stream, and only a run's first group can
have begun before it. What is needed to put that right is one row per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored


def changes(columns: list[pa.Array], last: list[pa.Array] | None) -> np.ndarray:
    """Where a row of the batch differs from the row before it; ``last`` is the row before the batch, if any."""
    out = np.zeros(len(columns[0]), bool)
    for i, column in enumerate(columns):
        before = column.slice(0, 0) if last is None else last[i]
        joined = pa.concat_arrays([before, column])
        a, b = joined.slice(0, len(joined) - 1), joined.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        differs = ~same.to_numpy(zero_copy_only=False)
        out[len(out) - len(differs) :] |= differs
    if last is None and len(out):
        out[0] = True
    return out


def _number(at: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, held, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.columns[at]
            new = changes([group], last)
            index = np.arange(len(new))
            begun = np.maximum.accumulate(np.where(new, index, -1))
            nth = np.where(begun < 0, index + held, index - begun)
            # the very first row opens the run's first group; a later change ends it
            later = np.cumsum(new) > (1 if last is None else 0)
            edge = np.logical_and(first, ~later)
            first, held, last = bool(edge[-1]), int(nth[-1]) + 1, [group.slice(len(group) - 1)]
            columns = [*batch.columns, pa.array(np.full(len(new), run, np.int32)), pa.array(nth.astype(np.int64)), pa.array(edge)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_run", "_nth", "_edge"])

    return number


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their 0-based place within ``group`` (a column without nulls) by ``order``, nulls first.

    ``rows`` should be a stored table, as the ranges are found by a pass of their own. Rows equal in
    group and order lie in one run in any order.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField("_nth", T.LongType()), T.StructField("_edge", T.BooleanType())])
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    runs = stored(sorted_.mapInArrow(_number(rows.columns.index(group)), schema), "runs")
    edges = runs.where("_edge").select(group).distinct()
    # one group per run at most, so this is broadcast with a proven bound
    counted = runs.join(F.broadcast(edges), group, "left_semi").groupBy(group, "_run").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counted.select(F.col(group).alias("_group"), F.col("_run").alias("_at"), before.alias("_before")).where("_before > 0"), "offsets")
    at = (F.col(group) == F.col("_group")) & (F.col("_run") == F.col("_at"))
    out = runs.join(F.broadcast(offsets), at, "left")
    return out.select(*rows.columns, (F.col("_nth") + F.coalesce("_before", F.lit(0))).alias("pos"))

