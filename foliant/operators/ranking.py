"""Row numbers and running sums within groups that may each be larger than a task.

A window function puts a whole group into one task. Here the rows are range-partitioned
and sorted by (group, order), each partition counts only its own rows, and the partitions'
totals, one row for each group and partition, are prefix-summed and added back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.workspace import small, store

_LOW = (1 << 33) - 1


def null_safe(left: DataFrame, right: DataFrame, on: dict[str, str]) -> Column:
    """left.k <=> right.v for all pairs."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[v]) for k, v in on.items()])


def ranked(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """df with `rank` (1 is first), `group_rows` and, with a weight, `before` and `group_weight`.

    Rows of a group (null is a group) stand in the order of the columns `order`; ties stand in
    any, but fixed, order. `before` sums the weights (bigint; null counts 0) of the rows ahead.
    No group is ever brought into one task. An empty table gives an empty table. Columns of df that
    are named like a result and are neither key, order nor weight are replaced; none may start with `_r_`.
    """
    by = [*keys, *order]
    df = df.drop(*({"rank", "group_rows", *(("before", "group_weight") if weight else ())} - {*by, weight}))
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_r_mid", F.monotonically_increasing_id())
    if weight:
        schema = T.StructType([*out.schema.fields, T.StructField("_r_cum", T.LongType())])
        at = out.columns.index(weight)

        def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                c = pc.cumulative_sum(pc.fill_null(b.column(at).cast(pa.int64()), 0), start=total)
                if len(c):
                    total = c[-1].as_py()
                yield pa.RecordBatch.from_arrays([*b.columns, c], names=[*b.schema.names, "_r_cum"])

        out = out.mapInArrow(running, schema)
    kept = store(out, "ranked")
    t = kept.withColumns({"_r_pid": F.shiftright("_r_mid", 33), "_r_at": F.col("_r_mid").bitwiseAND(F.lit(_LOW))})
    ahead = W.partitionBy(*(f"_r_k{i}" for i in range(len(keys)))).orderBy("_r_p")
    whole = W.partitionBy(*(f"_r_k{i}" for i in range(len(keys))))
    prior = ahead.rowsBetween(W.unboundedPreceding, -1)
    runs = t.groupBy(*(F.col(k).alias(f"_r_k{i}") for i, k in enumerate(keys)), F.col("_r_pid").alias("_r_p")).agg(
        F.count(F.lit(1)).alias("_r_c"), F.min("_r_at").alias("_r_i"),
        *([F.sum(F.coalesce(F.col(weight), F.lit(0)).cast("bigint")).alias("_r_w"), F.min_by(F.col("_r_cum") - F.coalesce(F.col(weight), F.lit(0)).cast("bigint"), "_r_at").alias("_r_s")] if weight else []),
    )
    runs = runs.withColumns({"_r_b": F.coalesce(F.sum("_r_c").over(prior), F.lit(0)), "group_rows": F.sum("_r_c").over(whole)})
    if weight:
        runs = runs.withColumns({"_r_bw": F.coalesce(F.sum("_r_w").over(prior), F.lit(0)), "group_weight": F.sum("_r_w").over(whole)})
    runs = small(runs, "runs")
    on = null_safe(t, runs, {**{k: f"_r_k{i}" for i, k in enumerate(keys)}, "_r_pid": "_r_p"})
    out = t.join(runs, on).withColumn("rank", F.col("_r_b") + F.col("_r_at") - F.col("_r_i") + 1)
    if weight:
        out = out.withColumn("before", F.col("_r_bw") + F.col("_r_cum") - F.coalesce(F.col(weight), F.lit(0)).cast("bigint") - F.col("_r_s"))
    return out.drop(*[c for c in out.columns if c.startswith("_r_")])
