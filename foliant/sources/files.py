"""Image files, archives, CSV and JSON as DataFrames."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import archive_target, infer_split, is_image, label_inspect, suffix, under
from foliant.functions.text import error_key
from foliant.plans.workspace import store
from foliant.sources.pixels import hash_of

SPLIT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("dataset", T.StringType()), ("label", T.StringType()), ("path", T.StringType()), ("md5", T.StringType()), ("size_bytes", T.LongType()),
    ("ahash", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("cluster", T.IntegerType()), ("split", T.StringType()),
)])


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, length, modificationTime, is_image of every file under root, hidden ones excepted. Contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return df.withColumn("rel", under("path", root)).withColumn("is_image", is_image("path"))


#: Bytes of a file that Spark can hold in one value.
MOST_BYTES = (1 << 31) - 1 - 16


def scan_images(spark: SparkSession, root: str, probe: Callable[[bytes], dict] | None = None, hashed: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, rel, dataset (first folder), label, split, suffix, size_bytes, md5, format, mode, width, height, status, error of every image under root.

    status is ok, unsupported (another picture format; the probe raised Unsupported) or corrupt, with the decoder's message in error; such a file keeps its
    row, size and md5. A file that cannot be read, or is larger than most_bytes, is corrupt with the error `read:Unreadable` and no md5. probe takes the bytes
    and gives format, width, height and perhaps mode, or raises; the default reads PNG, JPEG and WebP in structure and needs no imaging library.
    hashed adds ahash, the average hash of 256 bits, null for files that the worker cannot decode (see pixels.with_hashes).
    """
    probe = probe or probe_image
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = source.load(root).filter(is_image("path")).select("path", F.col("length").alias("size_bytes"))
    files = source.option("ignoreCorruptFiles", "true").load(root).filter(is_image("path") & (F.col("length") <= most_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    x = probe(bytes(content))
                    rows.append((x["format"], x.get("mode"), x["width"], x["height"], "ok", None, hash_of(bytes(content)) if hashed else None))
                except Exception as e:
                    rows.append((None, None, 0, 0, "unsupported" if isinstance(e, Unsupported) else "corrupt", f"{type(e).__name__}: {e}", None))
            out = pdf.drop(columns=["content"]).reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["format", "mode", "width", "height", "status", "error", "ahash"])], axis=1)

    x = files.select(F.col("path").alias("_path"), F.md5("content").alias("md5"), "content")
    x = x.mapInPandas(run, "_path string, md5 string, format string, mode string, width int, height int, status string, error string, ahash binary")
    # what was listed but not read
    x = listed.join(x, F.col("path") == F.col("_path"), "left").withColumns({
        "error": F.when(F.col("_path").isNull(), "read:Unreadable").otherwise(F.col("error")), "status": F.coalesce("status", F.lit("corrupt")), "width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0)),
    }).drop("_path")
    x = x if hashed else x.drop("ahash")
    x = x.withColumn("rel", under("path", root))
    x = x.withColumns({"dataset": F.split_part("rel", F.lit("/"), F.lit(1)), "inner": F.regexp_replace("rel", "^[^/]*/", "")})
    return x.withColumns({"label": label_inspect("inner"), "split": infer_split("inner"), "suffix": suffix("path")}).drop("inner")


def error_counts(scanned: DataFrame, least: int = 64) -> DataFrame:
    """dataset, error, n of a scan_images result: files by their error (`decode:` and the decoder's message, cut to 200 characters, or `read:` and its kind) and `tiny_image` for valid ones with a side below `least`."""
    failed = F.when(F.startswith("error", F.lit("read:")), F.col("error")).otherwise(error_key("decode", "error"))
    tiny = (F.col("width") < least) | (F.col("height") < least)
    key = F.when(F.col("status") != "ok", failed).when(tiny, "tiny_image")
    return scanned.select("dataset", key.alias("error")).filter("error IS NOT NULL").groupBy("dataset", "error").agg(F.count(F.lit(1)).alias("n"))


class Unsupported(ValueError):
    """A picture of a format that the probe does not read."""


#: The next marker of a JPEG: none of the stuffed bytes and restarts within a scan.
_MARKER = re.compile(rb"\xff+([^\x00\x01\xff\xd0-\xd8])", re.DOTALL)
_OTHERS = ((b"GIF8", "GIF"), (b"BM", "BMP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"\0\0\0\x0cjP  ", "JPEG 2000"), (b"\0\0\1\0", "ICO"))


#: Names of pixel layouts, of PNG by colour type and depth, of JPEG by the number of its components.
_PNG_MODES = {(0, 1): "1", (0, 8): "L", (0, 16): "I;16", (2, 8): "RGB", (3, 8): "P", (4, 8): "LA", (4, 16): "RGBA", (6, 8): "RGBA"}
_JPEG_MODES = {b"\1": "L", b"\3": "RGB", b"\4": "CMYK"}


def _webp_size(data: bytes) -> dict:
    """width, height of a WebP picture: of its canvas, or of its lossy or lossless frame."""
    end = 8 + int.from_bytes(data[4:8], "little")
    if len(data) < end:
        raise ValueError("WebP is cut short")
    at, size, frame, alpha = 12, None, False, False
    while at + 8 <= end:
        kind, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + n]
        if at + 8 + n > end:
            raise ValueError("damaged WebP chunk")
        if kind == b"VP8X" and n >= 10:
            size, alpha = size or (1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")), alpha or body[0] & 16 > 0
        elif kind == b"VP8 " and n >= 10 and body[3:6] == b"\x9d\x01\x2a":
            size, frame = size or tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10])), True
        elif kind == b"VP8L" and n >= 5 and body[0] == 0x2F:
            x = int.from_bytes(body[1:5], "little")
            size, frame, alpha = size or ((x & 0x3FFF) + 1, (x >> 14 & 0x3FFF) + 1), True, alpha or x >> 28 & 1 > 0
        elif kind == b"ANMF":
            frame = True
        at += 8 + n + n % 2
    if not frame or size is None:
        raise ValueError("WebP without a frame")
    return {"mode": "RGBA" if alpha else "RGB", "width": size[0], "height": size[1]}


def probe_image(data: bytes) -> dict:
    """format, mode, width, height of a PNG, JPEG or WebP; raises Unsupported for another known format, ValueError if it is none, cut short or damaged (PNG: also if its pixels do not inflate)."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, size, pixels, ended = 8, None, b"", False
        while at + 12 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            crc = data[at + 8 + n : at + 12 + n]
            if len(body) < n or len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
                raise ValueError("damaged PNG chunk")
            if kind == b"IHDR":
                size = struct.unpack(">II", body[:8])
                mode = _PNG_MODES.get((body[9], body[8]), _PNG_MODES.get((body[9], 8)))
            elif kind == b"IDAT":
                pixels += body
            elif kind == b"IEND":
                ended = True
                break
            at += 12 + n
        if not ended or size is None:
            raise ValueError("PNG is cut short")
        zlib.decompress(pixels)
        return {"format": "PNG", "mode": mode, "width": size[0], "height": size[1]}
    if data[:2] == b"\xff\xd8":
        at, size, mode, scan = 2, None, None, False
        while (m := _MARKER.search(data, at)) is not None:
            kind, body = m[1][0], m.end()
            if size is None and m.start() != at:
                raise ValueError("damaged JPEG segment")
            if kind == 0xD9:
                if size is None or not scan:
                    raise ValueError("JPEG without a frame or a scan")
                return {"format": "JPEG", "mode": mode, "width": size[1], "height": size[0]}  # what follows the end marker does not matter
            n = int.from_bytes(data[body : body + 2])
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and body + 7 <= len(data):
                size, mode = size or struct.unpack(">HH", data[body + 3 : body + 7]), mode or _JPEG_MODES.get(data[body + 7 : body + 8])
            scan = scan or kind == 0xDA
            at = body + n
        raise ValueError("JPEG is cut short")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return {"format": "WEBP"} | _webp_size(data)
    if name := next((name for start, name in _OTHERS if data.startswith(start)), None):
        raise Unsupported(f"{name} is not read here")
    raise ValueError("cannot identify image file")


def _open(path: str):
    """A seekable file on local disk or whatever the worker's Arrow can reach; only the parts asked for are read."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + (rest or path).lstrip("/"), "rb")
    where, at = fs.FileSystem.from_uri(scheme + ":" + quote(rest))
    return where.open_input_file(at)


def archive_entries(spark: SparkSession, glob: str, prefix: str = "", images_only: bool = False) -> DataFrame:
    """archive, entry, target, content of the files in ZIP archives under a prefix, with target relative to it; entries directly under it are left aside.

    A damaged archive or entry gives a row with its error and nulls; a missing archive gives none. Only the list of an
    archive's entries is read in one task; the entries are then dealt out and each is read by its place in the archive,
    so neither an archive of any size nor its number of entries is held in memory.
    """
    archives = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("archive"))

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for pdf in batches:
            for path in pdf["archive"]:
                try:
                    with _open(path) as f, zipfile.ZipFile(f) as z:
                        entries = [i.filename for i in z.infolist()]
                    yield pd.DataFrame({"archive": path, "entry": entries, "error": pd.Series([None] * len(entries), dtype=object)})
                except Exception as e:
                    yield pd.DataFrame({"archive": [path], "entry": pd.Series([None], dtype=object), "error": [f"{type(e).__name__}: {e}"]})

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for pdf in batches:
            for path, group in pdf.groupby("archive"):
                rows = []
                try:
                    with _open(path) as f, zipfile.ZipFile(f) as z:
                        for entry, target in zip(group["entry"], group["target"]):
                            try:
                                rows.append((path, entry, target, z.read(entry), None))
                            except Exception as e:
                                rows.append((path, entry, None, None, f"{type(e).__name__}: {e}"))
                            if len(rows) >= 64:
                                yield pd.DataFrame(rows, columns=list(group_columns))
                                rows = []
                except Exception as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pd.DataFrame(rows, columns=list(group_columns))

    group_columns = ("archive", "entry", "target", "content", "error")
    found = store(archives.mapInPandas(names, "archive string, entry string, error string").withColumn("target", archive_target("entry", prefix)), "entries")
    wanted = found.filter("target IS NOT NULL")
    if images_only:
        wanted = wanted.filter(is_image("target"))
    read = wanted.select("archive", "entry", "target").repartition("archive", "entry").mapInPandas(contents, "archive string, entry string, target string, content binary, error string")
    return read.unionByName(found.filter("error IS NOT NULL").withColumn("content", F.lit(None).cast("binary")))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The split CSV with its declared schema; needs path, label, split, and rows in the wanted split."""
    header = spark.read.option("header", "true").csv(path).columns
    for c in ("path", "label", "split"):
        if c not in header:
            raise ValueError(f"missing columns: ['{c}']")
    schema = T.StructType([next((f for f in SPLIT_SCHEMA.fields if f.name == c), T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(schema).option("header", "true").csv(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
        if df.isEmpty():
            raise ValueError(f"no rows for split {split}")
    return df


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """status, report of a JSON document: ok with its text, error if it does not parse, not_computed if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([("not_computed", None)], "status string, report string")
    text = spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("report"))
    good = F.try_parse_json("report").isNotNull()
    return text.select(F.when(good, "ok").otherwise("error").alias("status"), F.when(good, F.col("report")).alias("report"))


def missing_datasets(found: DataFrame, dataset: str, known: list[str]) -> DataFrame:
    """dataset, note of the known datasets that were not found."""
    names = found.sparkSession.createDataFrame([(k,) for k in known], "dataset string")
    have = found.select(F.col(dataset).alias("_d")).distinct()
    return names.join(have, F.col("dataset") == F.col("_d"), "left_anti").withColumn("note", F.lit("not present"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    """dataset (first folder), n_files, n_images, n_skipped of a scan_files result."""
    d = F.split_part("rel", F.lit("/"), F.lit(1)).alias("dataset")
    return scanned.groupBy(d).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("is_image").alias("n_images"), F.count_if(~F.col("is_image")).alias("n_skipped"))


def with_content(manifest: DataFrame, root: str, path: str = "path") -> DataFrame:
    """manifest with the bytes of its files, null for files that are gone; `path` is relative to root. Only the named files' rows are shuffled."""
    spark = manifest.sparkSession
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    f = f.select(under("path", root).alias("_rel"), "content")
    return manifest.join(f, F.col(path) == F.col("_rel"), "left").drop("_rel")


def plan_archives(spark: SparkSession, plan: list[tuple[str, str, str]], only: list[str] | None = None) -> DataFrame:
    """archive, prefix, target, status (found or missing) of the archives to extract, all or those whose base name is in `only`."""
    rows = [(a, p, t, "found" if exists(spark, a) else "missing") for a, p, t in plan if only is None or a.rsplit("/", 1)[-1] in only]
    return spark.createDataFrame(rows, "archive string, prefix string, target string, status string")
