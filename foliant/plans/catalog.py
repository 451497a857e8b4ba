"""The registered queries and their SQL for the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.keys import name_key
from foliant.operators import skew
from foliant.plans import etl, forms, monitoring, pictures, scores
from foliant.plans.tables import table

# 4. A few keys holding most records


def _by_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "split_csv").select("record_id", name_key("label").alias("label"), "path", "size_bytes")


def p4_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sizes of every label; a null label is a row of its own."""
    return skew.key_profile(_by_label(spark, folder), "label", "size_bytes").select(
        F.col("key").alias("label"), "n_rows", "n_sized", F.col("total_size").alias("total_bytes"), F.col("min_size").alias("min_bytes"),
        F.col("max_size").alias("max_bytes"), F.round("share", 6).alias("share"), "is_hot",
    )


def p4_largest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest files of every label."""
    out = skew.largest_per_key(_by_label(spark, folder), "label", "size_bytes", "record_id", 10, ["path"])
    return out.select(F.col("key").alias("label"), F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("record_id"), F.col("size").alias("size_bytes"), "path")


def p4_median(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median file size of every label."""
    return skew.exact_medians(_by_label(spark, folder), ["label"], ["size_bytes"]).select("label", F.round("median", 1).alias("median_bytes"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The labels that hold at least a twentieth of all rows."""
    return p4_profile(spark, folder).filter("is_hot").select("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**etl.QUERIES, **{f.__name__: f for f in (p4_profile, p4_largest, p4_median, p4_found)}}
assert forms and monitoring and pictures and scores  # they register their queries in etl.QUERIES

_LABEL = "trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_')"

SQL: dict[str, str] = {
    **etl.SQL,
    "p4_profile": f"""
SELECT {_LABEL} AS label, count(*) AS n_rows, count(size_bytes) AS n_sized, sum(size_bytes)::BIGINT AS total_bytes, min(size_bytes) AS min_bytes, max(size_bytes) AS max_bytes,
  round(count(*) / (SELECT count(*) FROM split_csv)::DOUBLE, 6) AS share, {_LABEL} IS NOT NULL AND count(*) * 20 >= (SELECT count(*) FROM split_csv) AS is_hot
FROM split_csv GROUP BY {_LABEL}""",
    "p4_largest": f"""
SELECT label, rank::INT AS rank, record_id, size_bytes, path FROM (
  SELECT {_LABEL} AS label, record_id, size_bytes, path, row_number() OVER (PARTITION BY {_LABEL} ORDER BY size_bytes DESC, record_id) AS rank
  FROM split_csv WHERE size_bytes IS NOT NULL) WHERE rank <= 10""",
    "p4_median": f"SELECT {_LABEL} AS label, round(median(size_bytes), 1) AS median_bytes FROM split_csv WHERE size_bytes IS NOT NULL GROUP BY 1",
    "p4_found": f"SELECT {_LABEL} AS label FROM split_csv WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) * 20 >= (SELECT count(*) FROM split_csv)",
}
