"""Stratified train, validation and test splits of whole clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.ranking import ranked


def cluster_rollup(df: DataFrame, cluster: list[str], label: str) -> DataFrame:
    """cluster columns, label (the smallest of the cluster), size."""
    return df.groupBy(*cluster).agg(F.min(label).alias("label"), F.count(F.lit(1)).alias("size"))


def assign(clusters: DataFrame, cluster: list[str], train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """clusters (cluster columns, label, size) with `split`.

    Within a label, clusters stand by size, smallest first, ties in a seeded hash order. Of n clusters the
    first rint(n * train) are train, the next rint(n * val) val, the rest test; shares are of clusters,
    not of rows, and halves round to even. A null label is a label. Ranks are distributed, so a
    label may hold any share of the clusters.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cluster)))
    r = ranked(clusters.withColumn("_k", key), ["label"], ["size", "_k"])
    n_train, n_val = F.rint(F.col("group_rows") * F.lit(train)), F.rint(F.col("group_rows") * F.lit(val))
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return r.withColumn("split", split).drop("_k", "rank", "group_rows")


def split_counts(df: DataFrame, group: str, split: str) -> DataFrame:
    """group, train, val, test: rows of each split, 0 where there are none."""
    return df.groupBy(group).agg(*(F.count_if(F.coalesce(F.col(split) == s, F.lit(False))).alias(s) for s in ("train", "val", "test")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight_inverse (1/n scaled to a mean of 1) and weight_balanced (all/(K*n) scaled to a sum of 1).

    Null labels are left aside.
    """
    per = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    x = per.withColumn("t", per.agg(F.struct(F.sum(1 / F.greatest("n", F.lit(1))).alias("s"), F.count(F.lit(1)).alias("k"))).scalar()).select("*", "t.*")
    inv = 1 / F.greatest("n", F.lit(1))
    return x.select(label, "n", (inv * F.col("k") / F.col("s")).alias("weight_inverse"), (inv / F.col("s")).alias("weight_balanced"))


def label_weights(df: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """label, n, weight of a given list of labels; a label without rows weighs as if it had one."""
    per = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    out = labels.join(per, F.col(label) == F.col("_l"), "left").select(label, F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("n"))
    sums = out.agg(F.struct(F.sum(1 / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k")))
    return out.withColumn("t", sums.scalar()).select("*", "t.*").select(label, "n", (F.col("k") / F.col("n") / F.col("s")).alias("weight"))
