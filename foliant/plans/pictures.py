"""Queries of the file sources and sinks. The test data hold no pictures, so each class of the table kb (a fixed, small one) gets a picture file
whose hash is known, some are spoilt, and the files and an archive of them are written to the shared folder and read back."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import profile
from foliant.plans import pipeline
from foliant.plans.etl import FILES, files, query
from foliant.plans.tables import table
from foliant.plans.workspace import shared_folder
from foliant.sources import files as source
from foliant.sources import sinks


def _picture(name: str) -> bytes:
    """A grey PNG of 16x16 pixels, white where a bit of two checksums of the name is set."""
    bits = bin(int("1" + hashlib.md5(name.encode()).hexdigest() + hashlib.md5(f"x{name}".encode()).hexdigest(), 16))[3:]
    raw = b"".join(b"\0" + bytes(255 * int(b) for b in bits[i : i + 16]) for i in range(0, 256, 16))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _made(spark: SparkSession, folder: str) -> dict[str, bytes]:
    """Relative path and bytes of the files of every class: a picture; one spoilt where the name holds `rust`; a copy where it holds `healthy`; and a note."""
    out = {}
    for r in table(spark, folder, "kb").select("class").filter("class IS NOT NULL").collect():
        c = r["class"]
        out[f"kb/train/{c}/a.PNG"] = _picture(c)
        if "rust" in c:
            out[f"kb/test/{c}/b.png"] = _picture(c)[:50]
        if "healthy" in c:
            out[f"kb/test/{c}/b.png"] = _picture(c)
        out[f"notes/{c}.txt"] = c.encode()
    return out


def _written(spark: SparkSession, made: dict[str, bytes]) -> str:
    root = f"{shared_folder(spark)}/made-{uuid.uuid4().hex}"
    for rel, data in made.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{rel}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(data))
        out.close()
    return root


def _tree(spark: SparkSession, folder: str) -> str:
    return _written(spark, _made(spark, folder))


_MADE = """m AS (SELECT class, 'kb/train/' || class || '/a.PNG' AS rel, 'train' AS split, true AS ok, '.png' AS suffix FROM kb WHERE class IS NOT NULL
UNION ALL SELECT class, 'kb/test/' || class || '/b.png', 'test', contains(class, 'healthy'), '.png' FROM kb WHERE contains(class, 'healthy') OR contains(class, 'rust'))"""


@query(f"""WITH {_MADE} SELECT rel, 'kb' AS dataset, class AS label, split, suffix, CASE WHEN ok THEN 'PNG' END AS format, CASE WHEN ok THEN 'L' END AS mode, CASE WHEN ok THEN 16 ELSE 0 END AS width, CASE WHEN ok THEN 16 ELSE 0 END AS height,
  CASE WHEN ok THEN 'ok' ELSE 'corrupt' END AS status, CASE WHEN NOT ok THEN 'ValueError: damaged PNG chunk' END AS error, CASE WHEN ok THEN md5(class) || md5('x' || class) END AS ahash FROM m""")
def scan_pictures(spark, folder):
    """Every picture with what its path and its bytes tell, and its hash."""
    x = source.scan_images(spark, _tree(spark, folder), hashed=True)
    return x.select("rel", "dataset", "label", "split", "suffix", "format", "mode", "width", "height", "status", "error", F.lower(F.hex("ahash")).alias("ahash"))


@query(f"""WITH {_MADE} SELECT 'kb' AS dataset, count(*) AS n_files, count(*) AS n_images, 0 AS n_skipped FROM m UNION ALL SELECT 'notes', count(*), 0, count(*) FROM kb WHERE class IS NOT NULL""")
def scan_counts(spark, folder):
    return source.scan_summary(source.scan_files(spark, _tree(spark, folder)))


@query(f"""WITH {_MADE} SELECT 'kb' AS dataset, CASE WHEN ok THEN 'tiny_image' ELSE 'decode:ValueError: damaged PNG chunk' END AS error, count(*) AS n FROM m GROUP BY 2""")
def scan_errors(spark, folder):
    return source.error_counts(source.scan_images(spark, _tree(spark, folder)))


@query("SELECT 'gone' AS dataset, 'not present' AS note")
def absent_datasets(spark, folder):
    return source.missing_datasets(source.scan_images(spark, _tree(spark, folder)), "dataset", ["kb", "gone"])


@query("SELECT class, octet_length(encode(class)) AS n_bytes, md5(class) AS md5 FROM kb WHERE class IS NOT NULL")
def file_contents(spark, folder):
    """The bytes of the files that a manifest names."""
    root = _tree(spark, folder)
    m = table(spark, folder, "kb").filter("class IS NOT NULL").select("class", F.concat(F.lit("notes/"), "class", F.lit(".txt")).alias("path"))
    return source.with_content(m, root).select("class", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("md5"))


@query(f"""WITH {_MADE} SELECT substr(rel, length('kb/') + 1) AS target FROM m""")
def archive_files(spark, folder):
    """The files of an archive under a prefix, written as rows and read back; a damaged archive beside it gives none."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for rel, data in _made(spark, folder).items():
            z.writestr(rel, data)
    root = _written(spark, {"a.zip": buf.getvalue(), "b.zip": b"no archive"})
    sinks.write_entries(source.archive_entries(spark, f"{root}/*.zip", "kb"), f"{root}/entries")
    return spark.read.parquet(f"{root}/entries").select("target")


@query("SELECT 'a.zip' AS archive, 'kb' AS target, 'missing' AS status")
def archive_plan(spark, folder):
    """Which archives of a plan are there; the one asked for is not."""
    root = shared_folder(spark)
    p = source.plan_archives(spark, [(f"{root}/none/a.zip", "kb", "kb"), (f"{root}/none/b.zip", "kb", "kb")], ["a.zip"])
    return p.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "target", "status")


@query(f"""WITH {_MADE} SELECT rel AS path, CASE WHEN NOT ok THEN 'corrupt' ELSE 'duplicate' END AS reason FROM m WHERE NOT ok OR (split = 'train' AND contains(class, 'healthy'))""")
def preprocessed_quarantine(spark, folder):
    """What the pipeline from pictures to a split moves away: spoilt files and copies after the first by label and path."""
    return pipeline.preprocess(spark, _tree(spark, folder), "made", "split")[1]


@query(f"""WITH {_MADE} SELECT class AS label, min(rel) AS path, md5(class) || md5('x' || class) AS ahash FROM m WHERE ok GROUP BY class""")
def preprocessed_split(spark, folder):
    """The pictures that the pipeline keeps, with their hashes; every one has a cluster and a split."""
    kept = pipeline.preprocess(spark, f"{_tree(spark, folder)}/kb/", "made", "split")[0]
    return kept.filter("cluster IS NOT NULL AND split IN ('train', 'val', 'test')").select("label", F.concat(F.lit("kb/"), "path").alias("path"), F.lower(F.hex("ahash")).alias("ahash"))


@query(f"WITH {FILES} SELECT dataset, label, path, md5, size_bytes, lower(hex(ahash)) AS ahash, width, height, cluster, split FROM f")
def split_roundtrip(spark, folder):
    """The split written as CSV and read back by its declared schema."""
    at = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    f = files(spark, folder).select("dataset", "label", "path", "md5", "size_bytes", "ahash", "width", "height", "cluster", "split")
    sinks.write_csv(f, at)
    return source.read_split(spark, at).withColumn("ahash", F.nullif("ahash", F.lit("")))


@query(f"WITH {FILES} SELECT split, count(*) AS n FROM f GROUP BY 1")
def manifest_roundtrip(spark, folder):
    """Rows of each split of a split written in one folder for each."""
    at = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    sinks.write_split(files(spark, folder).select("record_id", "label", "split"), at)
    return spark.read.parquet(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT 'ok' AS status, dataset, count(*) AS n_files FROM f GROUP BY 2 UNION ALL SELECT 'not_computed', NULL, NULL")
def report_roundtrip(spark, folder):
    """The report of every dataset written as JSON documents and read back, and one that is not there."""
    at = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(profile.report(files(spark, folder), "dataset", "label", "suffix", "ok", "md5", "size_bytes", "width", "height"), at)
    read: DataFrame = spark.read.text(f"{at}/latest").select(F.when(F.try_parse_json("value").isNotNull(), "ok").otherwise("error").alias("status"), F.try_parse_json("value").alias("v"))
    read = read.select("status", F.try_variant_get("v", "$.dataset", "string").alias("dataset"), F.try_variant_get("v", "$.files.n", "bigint").alias("n_files"))
    gone = source.read_report(spark, f"{at}/none").select("status", F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("bigint").alias("n_files"))
    return read.unionByName(gone)
