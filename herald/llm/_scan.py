"""Distributed prefix sums within groups, in a total order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herald.llm._common import materialize


def _starts(batch: pa.RecordBatch, group: list[str], last: dict | None) -> np.ndarray:
    """Rows at which another group begins than that of the row before; ``last`` has the values of the row before the batch."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for c in group:
        col = batch.column(c)
        if n > 1:
            a, b = col.slice(0, n - 1), col.slice(1)
            differs = pc.fill_null(pc.not_equal(a, b), False)
            new[1:] |= pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        new[0] |= last is None or last[c] != col[0].as_py()
    return np.flatnonzero(new)


def prefix_sums(
    df: DataFrame, group: list[str], order: list[Column], values: dict[str, str], late: dict[str, Column] | None = None
) -> DataFrame:
    """``df`` with, for each ``{value: name}``, the sum of ``value`` over earlier rows of the group.

    Rows are range-sorted by (group, order), so a group of any size spreads
    over many partitions, and rows are shuffled once. Each partition sums its
    own rows as they stream past, the sums of the partitions (a row for each
    partition and group in it) are summed in turn, and a join adds what came
    before. ``order`` should be total; rows that tie get one of their possible
    orders, the same in all columns. A null value counts as 0, a null group is
    a group. An empty table gives an empty result. The columns ``__p`` and
    ``__b_*`` are used inside.

    ``df`` is read twice, once to find the ranges: give a written table where
    it is costly, or columns that the order does not need as ``late``, which
    are computed after the shuffle and stay. Keep texts out of the order, whose
    samples go to the driver.
    """
    outs, late = list(values.values()), late or {}
    keys = [F.col(c) for c in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(outs, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            start = _starts(batch, group, last)
            arrays = list(batch.columns)
            for v, o in values.items():
                x = pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(x)])
                sums = before[:-1] + carry[o]
                for i, j in zip(start, [*start[1:], len(x)]):
                    sums[i:j] = before[i:j] - before[i]
                carry[o] = int(sums[-1] + x[-1])
                arrays.append(pa.array(sums))
            last = {c: batch.column(c)[batch.num_rows - 1].as_py() for c in group}
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *outs])

    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({**late, "__p": F.spark_partition_id()})
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(o, T.LongType()) for o in outs]])
    rows = materialize(dealt.mapInArrow(run, schema))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__p", *group).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"__s_{o}") for v, o in values.items()])
    base = sums.select(
        F.col("__p").alias("__q"), *[F.col(c).alias(f"__g_{i}") for i, c in enumerate(group)],
        *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).cast("long").alias(f"__b_{o}") for o in outs]
    )
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(base[f"__g_{i}"]) for i, c in enumerate(group)], rows["__p"] == base["__q"])
    joined = rows.join(base, same, "left")
    return joined.select(
        *[rows[c] for c in (*df.columns, *late)], *[(rows[o] + F.coalesce(base[f"__b_{o}"], F.lit(0))).alias(o) for o in outs]
    )
