"""Manifests: exact deduplication, quarantine, numbering, label indices, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranking import null_safe, ranked


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first by `order`, nulls last; rows with a null key are all kept. Columns stay as they are.

    The filter on the row number becomes a group limit in each task, so a key that holds most rows sends one row
    from each task. Rows that are equal in `order` are interchangeable: end it with a unique column.
    """
    w = W.partitionBy(key).orderBy(*(F.asc_nulls_last(c) for c in order))
    once = df.filter(F.col(key).isNotNull()).withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
    return once.unionByName(df.filter(F.col(key).isNull()))


def quarantine(df: DataFrame, row_id: str, path: str, ok: str, md5: str, order: list[str]) -> DataFrame:
    """row_id, path, reason of the rows that would be moved away: corrupt, or duplicate of an earlier row with the same md5.

    Nothing is moved; running it again gives the same rows. row_id must be unique.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    corrupt = df.filter(~good).select(row_id, path, F.lit("corrupt").alias("reason"))
    kept = keep_first(df.filter(good).select(row_id, path, md5, *[c for c in order if c not in (row_id, path, md5)]), md5, order).select(F.col(row_id).alias("kept_id"))
    dup = df.filter(good).join(kept, F.col(row_id) == F.col("kept_id"), "left_anti").select(row_id, path, F.lit("duplicate").alias("reason"))
    return corrupt.unionByName(dup)


def dense_ids(df: DataFrame, group: str, order: list[str], out: str = "cluster") -> DataFrame:
    """df with a dense number of each group, from 0, in the order in which the groups first appear by `order`.

    Null is a group. The groups' first rows are numbered by the distributed ranking; no global window is used.
    """
    first = df.groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(*order)).alias("_o"))
    first = first.select("_g", *(F.col(f"_o.{c}").alias(f"_o{i}") for i, c in enumerate(order)))
    numbered = ranked(first, [], [f"_o{i}" for i in range(len(order))]).select("_g", (F.col("rank") - 1).alias(out))
    return df.join(numbered, null_safe(df, numbered, {group: "_g"})).drop("_g")


def row_ids(df: DataFrame, order: list[str], out: str = "cluster", start: int = 0) -> DataFrame:
    """df with a running number over all rows by `order`: the trivial cluster of each row."""
    return ranked(df, [], order).withColumn(out, F.col("rank") - 1 + start).drop("rank", "group_rows")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """label, idx: sorted distinct labels from 0; null labels have no index. Take it from the training rows once and join it to all splits."""
    names = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return row_ids(names, [label], "idx")


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, uniformly at random by the hash of seed and row_id: the same rows on every run."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))).orderBy("_h").limit(n).drop("_h")


def fraction_per_label(df: DataFrame, label: str, order: list[str], fraction: float) -> DataFrame:
    """The first max(1, rint(n * fraction)) rows of each label by `order`; not random. fraction must lie in (0, 1]."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return ranked(df, [label], order).filter(F.col("rank") <= F.greatest(F.lit(1), F.rint(F.col("group_rows") * F.lit(fraction)))).drop("rank", "group_rows")


def hash_sample_per(df: DataFrame, group: str, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows of each group by the hash of seed and row_id; cut to n in each task before the shuffle."""
    w = W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))), row_id)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def smoke_subset(df: DataFrame, order: list[str], n: int = 64) -> DataFrame:
    """The first n rows by `order`, for a trial run."""
    return df.orderBy(*order).limit(n)
