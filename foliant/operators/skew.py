"""Per-key results when a handful of keys hold most rows.

Everything is an algebraic aggregate: each task first combines its own rows in a bounded
hash table (spilling mergeable states when it is full), so only one compact state for each
key and task is shuffled, however hot a key is. The largest rows of a key are cut to the
first k in each task before the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranking import ranked


def key_profile(df: DataFrame, key: str, size: str, hot_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """One row for each key: n_rows, n_sized, total_size, min_size, max_size, share, is_hot.

    A null key is a group of its own and counts among all rows, but is never hot. Null sizes count
    in n_rows only. A key is hot if it holds at least hot_share (a fraction, compared in integers)
    of all rows. Other columns of df are left aside; an empty table gives an empty table.
    """
    num, den = hot_share
    per = df.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(size).alias("n_sized"), F.sum(size).alias("total_size"),
        F.min(size).alias("min_size"), F.max(size).alias("max_size"),
    )
    total = df.agg(F.count(F.lit(1)).alias("all_rows"))
    return (
        per.withColumn("all_rows", total.scalar())
        .withColumn("share", F.col("n_rows") / F.col("all_rows"))
        .withColumn("is_hot", F.col("key").isNotNull() & (F.col("n_rows") * den >= F.col("all_rows") * num))
        .drop("all_rows")
    )


def largest_per_key(df: DataFrame, key: str, size: str, row_id: str, k: int, extra: list[str] | None = None) -> DataFrame:
    """The k largest rows of each key: key, rank, row_id, size and the extra columns.

    Rows without a size are left aside; equal sizes are ordered by row_id. The filter on the row
    number becomes a group limit that runs in each task before the exchange.
    """
    w = W.partitionBy("key").orderBy(F.desc("size"), F.asc("row_id"))
    rows = df.select(F.col(key).alias("key"), F.col(row_id).alias("row_id"), F.col(size).alias("size"), *(extra or [])).filter(F.col("size").isNotNull())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """key columns, field, median: the exact median of each of several numeric columns for each key.

    Equal values are combined in each task before the shuffle. The counts of the distinct values are then range-partitioned
    by (key, field, value) and summed up across partitions, so neither a hot key nor one with very many distinct or far-flung values
    comes into one task. Null values are left aside; a key and field without values has no row; a null key is a key. The median of an even
    number of values is the mean of the middle two. Values are compared as doubles.
    """
    fields = F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("value")) for v in values))).alias("x")
    counts = df.select(*keys, fields).select(*keys, "x.*").filter("value IS NOT NULL").groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    line = ranked(counts, [*keys, "field"], ["value"], "n")
    low, high = F.floor((F.col("group_weight") + 1) / 2), F.floor((F.col("group_weight") + 2) / 2)
    upto = F.col("before") + F.col("n")
    line = line.filter((F.col("before") < high) & (upto >= low)).select(*keys, "field", "value", (upto >= low).alias("reaches_low"), (upto >= high).alias("reaches_high"))
    middle = lambda c: F.min(F.when(F.col(c), F.col("value")))
    return line.groupBy(*keys, "field").agg(((middle("reaches_low") + middle("reaches_high")) / 2).alias("median"))
