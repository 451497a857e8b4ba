"""Profiles of labelled file collections: counts, balance, integrity, sizes, duplicates.

Each is an algebraic aggregate over one scan; per-dataset figures and grand totals come from
the same grouping instead of a loop over datasets. Medians come from the distributed ranking. The nested report
stores the columns it needs once and takes all its parts from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.ranking import null_safe
from foliant.operators.skew import exact_medians
from foliant.plans.workspace import store


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of every combination of `by`, whatever their status: by, n."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, classes, n, min_n, max_n, mean_n, imbalance: largest class over smallest (at least 1), to two digits.

    A null label is a class. A group without rows does not appear.
    """
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(group).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("_c").alias("n"), F.min("_c").alias("min_n"), F.max("_c").alias("max_n"),
        F.round(F.avg("_c"), 1).alias("mean_n"), F.round(F.max("_c") / F.greatest(F.min("_c"), F.lit(1)), 2).alias("imbalance"),
    )


def integrity(df: DataFrame, group: str, ok: str, unsupported: str | None = None) -> DataFrame:
    """group, n_files, n_valid, n_corrupt by the boolean column ok (null is corrupt), n_unsupported by another one (0 without it), whose rows are not corrupt."""
    other = F.coalesce(F.col(unsupported), F.lit(False)) if unsupported else F.lit(False)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.coalesce(F.col(ok), F.lit(False))).alias("n_valid"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(False)) & ~other).alias("n_corrupt"), F.count_if(other).alias("n_unsupported"),
    )


def value_counts(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """group, field, value, n: counts of the values of several columns in one pass; nulls are a value."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(group, stacked.alias("x")).groupBy(group, F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(df: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """key, n_files, extra_files and, with a size, wasted_size (all but one of each group) of keys held more than once.

    Null keys are no duplicates. Copies are alike, so which one is kept makes no difference; where sizes differ the smallest is kept.
    """
    more = [(F.sum(size) - F.min(size)).alias("wasted_size")] if size else []
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), *more).filter("n_files > 1")
    return out.withColumn("extra_files", F.col("n_files") - 1)


def near_estimate(df: DataFrame, key: str, group: str) -> DataFrame:
    """group, near_duplicates: rows beyond the first with an equal perceptual hash. Null hashes count for nothing."""
    per = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(group).agg(F.sum(F.when(F.col(key).isNotNull(), F.col("_c") - 1).otherwise(0)).alias("near_duplicates"))


def size_profile(df: DataFrame, group: str, size: str, width: str, height: str) -> DataFrame:
    """Sizes and dimensions of each group; nulls are left out of each figure. Minima of width and height are independent."""
    medians = exact_medians(df, [group], [size, width, height]).groupBy(F.col(group).alias("_g")).agg(*(F.max(F.when(F.col("field") == f, F.col("median"))).alias(n) for f, n in ((size, "median_size"), (width, "median_width"), (height, "median_height"))))
    out = df.groupBy(group).agg(
        F.count(size).alias("n_sized"), F.round(F.sum(size) / 1024**2, 1).alias("total_mb"), F.round(F.sum(size) / 1e9, 3).alias("total_gb"), F.round(F.avg(size) / 1024, 1).alias("mean_kb"),
        F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.min(width).alias("min_width"), F.min(height).alias("min_height"),
        F.max(width).alias("max_width"), F.max(height).alias("max_height"), F.count_if((F.col(width) < 64) | (F.col(height) < 64)).alias("n_tiny"),
    )
    return out.join(medians, null_safe(out, medians, {group: "_g"}), "left").drop("_g")


def totals(df: DataFrame, group: str, ok: str, md5: str, size: str) -> DataFrame:
    """group, n_files, n_ok, n_corrupt, dup_groups, dup_files, wasted_bytes of every group and, with group null and is_total, of all.

    Duplicates are counted among the rows that are ok, within a group.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    per = df.groupBy(group, F.when(good, F.col(md5)).alias("_k")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(good).alias("_g"), F.sum(size).alias("_s"), F.min(size).alias("_m"))
    dup = F.col("_k").isNotNull() & (F.col("_c") > 1)
    return per.rollup(group).agg(
        F.grouping(group).cast("boolean").alias("is_total"), F.sum("_c").alias("n_files"), F.sum("_g").alias("n_ok"), F.sum(F.col("_c") - F.col("_g")).alias("n_corrupt"),
        F.count_if(dup).alias("dup_groups"), F.sum(F.when(dup, F.col("_c") - 1).otherwise(0)).alias("dup_files"), F.sum(F.when(dup, F.col("_s") - F.col("_m")).otherwise(0)).alias("wasted_bytes"),
    )


def first_examples(df: DataFrame, group: str, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows of each group by the columns `order`: df and `rank`. The limit acts in each task before the shuffle."""
    from pyspark.sql import Window as W

    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def tasks_supported(df: DataFrame, group: str, label: str, identify: tuple[str, ...] = (), deficiency: tuple[str, ...] = ()) -> DataFrame:
    """Which tasks the classes of each group allow. A class is healthy if its lower-case name holds `healthy`; null labels are no class."""
    per = df.filter(F.col(label).isNotNull()).select(group, label).distinct()
    healthy = F.count_if(F.contains(F.lower(F.col(label)), F.lit("healthy")))
    out = per.groupBy(group).agg(F.count(F.lit(1)).alias("classes"), healthy.alias("healthy_classes"))
    diseased = F.col("classes") > F.col("healthy_classes")
    within = lambda names: F.coalesce(F.col(group).isin(*names), F.lit(False)) if names else F.lit(False)
    return out.select(
        group, "classes", "healthy_classes", within(identify).alias("plant_identification"), ((F.col("healthy_classes") > 0) & diseased).alias("health_classification"),
        diseased.alias("disease_classification"), within(deficiency).alias("deficiency_classification"), F.lit(False).alias("severity_estimation"),
    )


def report(df: DataFrame, group: str, label: str, suffix: str, ok: str, md5: str, size: str, width: str, height: str, unsupported: str | None = None) -> DataFrame:
    """One nested document for each group: files{n, valid, corrupt, unsupported}, classes (label -> n, of valid files), formats (suffix -> n),
    sizes{total_mb, mean_kb, min, median, max}, dimensions{min, median, max as [width, height]}, duplicates{groups, files, wasted_bytes}.

    Null labels and suffixes are named `unknown` in the maps. The columns needed are stored once, so df is read once;
    every part is an aggregate of them, joined on the group.
    """
    df = store(df.select(*dict.fromkeys(c for c in (group, label, suffix, ok, md5, size, width, height, unsupported) if c)), "report")
    good = df.filter(F.coalesce(F.col(ok), F.lit(False)))
    counted = lambda d, c, name: d.groupBy(F.col(group).alias("_g"), F.coalesce(F.col(c), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("_g").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))
    s, i, t = size_profile(df, group, size, width, height), integrity(df, group, ok, unsupported), totals(df, group, ok, md5, size).filter("NOT is_total")
    parts = [
        counted(good, label, "classes"), counted(df, suffix, "formats"),
        s.select(F.col(group).alias("_g"), F.struct("total_mb", "mean_kb", F.col("min_size").alias("min"), F.col("median_size").alias("median"), F.col("max_size").alias("max")).alias("sizes"),
                 F.struct(F.array("min_width", "min_height").alias("min"), F.array("median_width", "median_height").alias("median"), F.array("max_width", "max_height").alias("max")).alias("dimensions")),
        t.select(F.col(group).alias("_g"), F.struct(F.col("dup_groups").alias("groups"), F.col("dup_files").alias("files"), "wasted_bytes").alias("duplicates")),
    ]
    out = i.select(F.col(group), F.struct(F.col("n_files").alias("n"), F.col("n_valid").alias("valid"), F.col("n_corrupt").alias("corrupt"), F.col("n_unsupported").alias("unsupported")).alias("files"))
    for p in parts:
        out = out.join(p, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    return out


def summary(report: DataFrame) -> DataFrame:
    """One row: datasets, total_valid, total_corrupt of the documents of `report`; zeros without any."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return report.agg(F.count(F.lit(1)).alias("datasets"), total("files.valid").alias("total_valid"), total("files.corrupt").alias("total_corrupt"))
