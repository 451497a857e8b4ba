"""Writing manifests, splits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.workspace import store


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """One folder for each split, so that readers of one split skip the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, blank: list[str] | None = None) -> None:
    """CSV with a header; nulls of the columns `blank` become empty strings. Binary columns are written in hexadecimal digits."""
    cols = [F.lower(F.hex(c)).alias(c) if t == "binary" else (F.coalesce(F.col(c), F.lit("")).alias(c) if c in (blank or []) else F.col(c)) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


def write_report(df: DataFrame, path: str, stamp: str | None = None) -> None:
    """Each row as one JSON document, nulls kept, under path/latest and, with a stamp, under path/stamp too."""
    doc = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    if stamp:
        doc = store(doc, "document")  # written twice, computed once
    for name in ["latest", *([stamp] if stamp else [])]:
        doc.write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")


def write_entries(entries: DataFrame, path: str) -> None:
    """Extracted archive entries as rows of target and content; damaged archives are left out."""
    entries.filter("error IS NULL").select("target", "content").write.mode("overwrite").parquet(path)
