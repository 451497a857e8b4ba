"""Sources, sinks, settings and streams."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.__main__ import main
from foliant.plans import pipeline
from foliant.sources import files, pixels, sinks
from foliant.sources.config import Config
from foliant.streaming import running


def png(w=3, h=2):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + bytes(3 * w) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xda\x00\x02xy\xff\x00z\xff\xd9"


@pytest.fixture
def tree(tmp_path):
    for name, data in {"plants/train/Fig/a.png": png(), "plants/test/Fig/b.JPG": JPEG, "plants/Validation/Hop/c.png": png()[:-6], "plants/notes.txt": b"x", "other/Hop/d.webp": b"RIFF"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_scans(spark, tree, rows):
    assert rows(files.scan_files(spark, str(tree)), "rel", "is_image") == [("other/Hop/d.webp", True), ("plants/Validation/Hop/c.png", True), ("plants/notes.txt", False), ("plants/test/Fig/b.JPG", True), ("plants/train/Fig/a.png", True)]
    got = files.scan_images(spark, str(tree))
    assert rows(got, "rel", "dataset", "label", "split", "format", "width", "height", "status") == [
        ("other/Hop/d.webp", "other", "Hop", None, None, 0, 0, "corrupt"), ("plants/Validation/Hop/c.png", "plants", "Hop", "val", None, 0, 0, "corrupt"),
        ("plants/test/Fig/b.JPG", "plants", "Fig", "test", "JPEG", 7, 5, "ok"), ("plants/train/Fig/a.png", "plants", "Fig", "train", "PNG", 3, 2, "ok"),
    ]
    assert rows(got.filter("status = 'corrupt'"), "error") == [("ValueError: PNG is cut short",), ("ValueError: cannot identify image file",)]
    assert rows(files.scan_images(spark, f"file://{tree}/"), "rel") == rows(got, "rel")
    assert rows(files.missing_datasets(got, "dataset", ["plants", "gone"])) == [("gone", "not present")]


def test_contents_and_summary(spark, tree, rows):
    assert rows(files.scan_summary(files.scan_files(spark, str(tree)))) == [("other", 1, 1, 0), ("plants", 4, 3, 1)]
    m = spark.createDataFrame([("plants/notes.txt",), ("gone.png",)], "path string")
    assert rows(files.with_content(m, str(tree)), "path", F.col("content").cast("string")) == [("gone.png", None), ("plants/notes.txt", "x")]
    plan = [(str(tree / "plants/notes.txt"), "p/", "t"), (str(tree / "no.zip"), "p/", "t")]
    assert rows(files.plan_archives(spark, plan), "status") == [("found",), ("missing",)] and files.plan_archives(spark, plan, ["no.zip"]).count() == 1


def test_pipeline(spark, tmp_path, rows):
    for i in range(12):
        p = tmp_path / f"in/{'Fig' if i < 9 else 'Hop'}/{i:02}.png"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(png(3, 2 + i % 10) if i != 5 else b"no image")
    base = bytes(range(32))

    def hashes(df):  # the two largest of Fig look alike
        return df.withColumn("ahash", F.when(F.col("path").isin("Fig/07.png", "Fig/08.png"), F.lit(base)).otherwise(F.unhex(F.sha2("path", 256))))

    split, moved = pipeline.preprocess(spark, str(tmp_path / "in"), "d", hashes=hashes)
    assert rows(moved) == [("Fig/05.png", "corrupt"), ("Hop/10.png", "duplicate"), ("Hop/11.png", "duplicate")]
    got = {r.path: r for r in split.collect()}
    assert len(got) == 9 and got["Fig/07.png"].cluster == got["Fig/08.png"].cluster and got["Fig/07.png"].split == "test" and got["Fig/00.png"].cluster == 0
    assert len({r.cluster for r in got.values()}) == 8
    alone, _ = pipeline.preprocess(spark, str(tmp_path / "in"), "d", cluster=False)
    assert alone.select("cluster").distinct().count() == 9
    assert main(["preprocess", str(tmp_path / "in"), "d", str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out/split")).count() == 9
    assert main(["scan", str(tmp_path), str(tmp_path / "rep")]) == 0
    doc = spark.read.json(str(tmp_path / "rep/latest")).filter("dataset = 'in'").first()
    assert (doc.files.n, doc.files.corrupt, doc.classes.Fig, doc.duplicates.files) == (12, 1, 8, 2)


def webp(kind, body, extra=b""):
    chunk = kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(extra + chunk)) + b"WEBP" + extra + chunk


def test_webp_trailing_bytes_and_other_formats(spark, tmp_path, rows):
    lossy, lossless = b"\x30\1\0\x9d\x01\x2a" + struct.pack("<HH", 320 | 1 << 14, 201) + b"x", b"\x2f" + struct.pack("<I", 99 | 44 << 14) + b"x"
    canvas = b"VP8X" + struct.pack("<I", 10) + bytes(4) + (699).to_bytes(3, "little") + (499).to_bytes(3, "little")
    thumb = b"\xff\xd8\xff\xe1\x00\x06\xff\xd8\xff\xd9" + JPEG[2:-2] + b"\xff\xda\x00\x02ab\xff\x00c\xff\xd0d"
    given = {
        "a.webp": webp(b"VP8 ", lossy), "b.webp": webp(b"VP8L", lossless), "c.webp": webp(b"VP8L", lossless, canvas), "d.webp": webp(b"VP8 ", lossy)[:-4], "e.webp": webp(b"EXIF", b"ab", canvas),
        "f.jpg": JPEG + b"trailing", "g.jpg": thumb + b"\xff\xd9more", "h.jpg": thumb, "i.png": b"GIF89a", "j.webp": webp(b"VP8 ", lossy) + b"tail",
    }
    (tmp_path / "in/Fig").mkdir(parents=True)
    for name, data in given.items():
        (tmp_path / "in/Fig" / name).write_bytes(data)
    got = {r.rel[4:]: (r.status, r.format, r.width, r.height) for r in files.scan_images(spark, str(tmp_path / "in")).collect()}
    bad = ("corrupt", None, 0, 0)
    assert got == {
        "a.webp": ("ok", "WEBP", 320, 201), "b.webp": ("ok", "WEBP", 100, 45), "c.webp": ("ok", "WEBP", 700, 500), "d.webp": bad, "e.webp": bad, "f.jpg": ("ok", "JPEG", 7, 5),
        "g.jpg": ("ok", "JPEG", 7, 5), "h.jpg": bad, "i.png": ("unsupported", None, 0, 0), "j.webp": ("ok", "WEBP", 320, 201),
    }
    split, moved = pipeline.preprocess(spark, str(tmp_path / "in"), "d", cluster=False)
    assert rows(moved) == [("Fig/d.webp", "corrupt"), ("Fig/e.webp", "corrupt"), ("Fig/h.jpg", "corrupt"), ("Fig/i.png", "unsupported")] and split.count() == 6
    assert main(["scan", str(tmp_path / "in"), str(tmp_path / "rep")]) == 0
    n = spark.read.json(str(tmp_path / "rep/latest")).first().files
    assert (n.n, n.valid, n.corrupt, n.unsupported) == (10, 6, 3, 1)


def drawn(spark, path, grid, kind="png", scale=8):
    """A grey picture of grid, each value a square, written by the JVM."""
    jvm = spark._jvm
    im = jvm.java.awt.image.BufferedImage(len(grid[0]) * scale, len(grid) * scale, 5)
    paint = im.createGraphics()
    for y, line in enumerate(grid):
        for x, v in enumerate(line):
            paint.setColor(jvm.java.awt.Color(v, v, v))
            paint.fillRect(x * scale, y * scale, scale, scale)
    path.parent.mkdir(parents=True, exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(im, kind, jvm.java.io.File(str(path)))


def test_pipeline_clusters_pictures_by_their_own_hashes(spark, tmp_path):
    rnd = random.Random(3)
    grid = lambda: [[rnd.choice((20, 230)) for _ in range(16)] for _ in range(16)]
    for k in range(3):
        g = grid()
        drawn(spark, tmp_path / f"in/Fig/a{k} +1.png", g)
        g[0][0] += 3  # other bytes, the same picture
        drawn(spark, tmp_path / f"in/Fig/b{k}.png", g)
    g = grid()
    drawn(spark, tmp_path / "in/Hop/j +1.jpg", g, "jpg")
    g[3][3] += 4
    drawn(spark, tmp_path / "in/Hop/j2.jpg", g, "jpg")
    split, _ = pipeline.preprocess(spark, str(tmp_path / "in"), "d")
    got = {r.path: r for r in split.collect()}
    assert len(got) == 8 and all(len(r.ahash) == 32 for r in got.values())
    for a, b in [*((f"Fig/a{k} +1.png", f"Fig/b{k}.png") for k in range(3)), ("Hop/j +1.jpg", "Hop/j2.jpg")]:
        assert got[a].cluster == got[b].cluster and got[a].split == got[b].split
    assert len({r.cluster for r in got.values()}) == 4
    assert got["Hop/j +1.jpg"].ahash == np.packbits(np.array(g).ravel() > 100).tobytes()
    (tmp_path / "in/Hop/stub.jpg").write_bytes(JPEG)
    with pytest.raises(ValueError, match="stub.jpg"):
        pipeline.preprocess(spark, str(tmp_path / "in"), "d")


@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 2), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_pngs_of_all_kinds_and_filters(colour, depth):
    rng = np.random.default_rng(depth + 20 * colour)
    w, h, n = 19, 23, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, line = max(1, n * depth // 8), -(-w * n * depth // 8)
    data = rng.integers(0, 256, (h, line), dtype=np.uint8)
    raw, above = b"", bytes(line)
    for y in range(h):
        cur, kind = bytes(data[y]), y % 5
        raw += bytes([kind])
        for i in range(line):
            a, b, c = cur[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = min((a, b, c), key=lambda v: abs(p - v))
            raw += bytes([(cur[i] - (0, a, b, (a + b) // 2, near)[kind]) & 255])
        above = cur
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    palette = rng.integers(0, 256, (256, 3), dtype=np.uint8)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if colour == 3 else b"")
    got = pixels.png_grey(b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    luma = lambda r, g, b: (int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 32768) >> 16
    for y in range(h):
        bits = "".join(f"{v:08b}" for v in data[y])
        v = [int(bits[i * depth : (i + 1) * depth], 2) for i in range(w * n)]
        for x in range(w):
            px = v[x * n : x * n + n]
            px = px if colour == 3 else [q >> 8 if depth == 16 else q * 255 // (2**depth - 1) for q in px]
            assert got[y, x] == (luma(*palette[px[0]]) if colour == 3 else luma(*px[:3]) if n > 2 else px[0])


def test_archives(spark, tmp_path, rows):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in ("p/color/A/x.jpg", "p/color/y.jpg", "q/A/z.jpg", "p/color/A/n.txt", "p/color/../../out.jpg", "p\\color\\B\\w.png", "p/color/C/"):
            z.writestr(n, n)
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    for prefix in ("p/color", "p/color/"):  # with and without a slash
        got = files.archive_entries(spark, str(tmp_path / "*.zip"), prefix)
        assert rows(got.filter("error IS NULL"), "target") == [("A/n.txt",), ("A/x.jpg",), ("B/w.png",)]
    got = files.archive_entries(spark, str(tmp_path / "*.zip"), "p/color", images_only=True)
    assert rows(got.filter("error IS NULL AND target LIKE 'A%'"), "entry", "target", F.col("content").cast("string")) == [("p/color/A/x.jpg", "A/x.jpg", "p/color/A/x.jpg")]
    assert got.filter("error IS NOT NULL").first().error.startswith("BadZipFile")
    sinks.write_entries(got, str(tmp_path / "e"))
    assert rows(spark.read.parquet(str(tmp_path / "e")), "target") == [("A/x.jpg",), ("B/w.png",)]
    main(["extract", str(tmp_path / "a.zip"), "p", str(tmp_path / "f")])
    assert rows(spark.read.parquet(str(tmp_path / "f")), "target") == [("color/A/n.txt",), ("color/A/x.jpg",), ("color/B/w.png",), ("color/y.jpg",)]


def test_files_that_cannot_be_read_keep_their_row(spark, tree, rows):
    got = files.scan_images(spark, str(tree), most_bytes=50)
    assert rows(got.filter("error LIKE 'read:%'"), "rel", "status", "md5", "width") == [("plants/Validation/Hop/c.png", "corrupt", None, 0), ("plants/train/Fig/a.png", "corrupt", None, 0)]
    assert rows(files.error_counts(got)) == [("other", "decode:ValueError: cannot identify image file", 1), ("plants", "read:Unreadable", 2), ("plants", "tiny_image", 1)]
    assert rows(files.scan_images(spark, str(tree)).filter("status = 'ok'"), "format", "mode") == [("JPEG", "L"), ("PNG", "RGB")]


def test_csv_and_reports(spark, tmp_path, rows):
    df = spark.createDataFrame([("p1", "a", "train", 1, b"\x01"), ("p2", None, "val", 2, None)], "path string, label string, split string, cluster int, ahash binary")
    sinks.write_csv(df, str(tmp_path / "s"), ["label"])
    back = files.read_split(spark, str(tmp_path / "s"))
    assert rows(back, "path", "cluster", "ahash") == [("p1", 1, "01"), ("p2", 2, None)] and files.read_split(spark, str(tmp_path / "s"), "val").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        files.read_split(spark, str(tmp_path / "s"), "test")
    sinks.write_csv(df.drop("label"), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="label"):
        files.read_split(spark, str(tmp_path / "t"))
    sinks.write_split(df, str(tmp_path / "u"))
    plan = spark.read.parquet(str(tmp_path / "u")).filter("split = 'val'")
    assert rows(plan, "path") == [("p2",)] and "PartitionFilters: [isnotnull(split" in plan._jdf.queryExecution().executedPlan().toString()
    sinks.write_report(df.agg(F.count(F.lit(1)).alias("n"), F.max("ahash").alias("x")), str(tmp_path / "r"), "20240101")
    assert rows(files.read_report(spark, str(tmp_path / "r/latest"))) == [("ok", '{"n":2,"x":"AQ=="}')]
    assert rows(files.read_report(spark, str(tmp_path / "none"))) == [("not_computed", None)]
    (tmp_path / "bad.json").write_text("{no")
    assert rows(files.read_report(spark, str(tmp_path / "bad.json"))) == [("error", None)]


def test_config():
    assert Config.from_env({}) == Config() and Config.from_env({"FOLIANT_TOP_K": "5", "FOLIANT_THRESHOLD": " "}) == Config(top_k=5)


def test_streams(spark, tmp_path, rows):
    schema = "id bigint, plant_id bigint, health_status string, created_at timestamp, file string"
    for i, part in enumerate([[(1, 7, "sick", "2024-01-01 00:00:00", "a")], [(2, 7, "healthy", "2024-01-01 05:00:00", "a"), (3, None, "sick", "2024-01-03 00:00:00", "b")]]):
        spark.createDataFrame(part, "id bigint, plant_id bigint, health_status string, created_at string, file string").withColumn("created_at", F.col("created_at").cast("timestamp")).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert rows(run(running.running_overview(stream, "plant_id", "id", "health_status"), "complete", "ov")) == [(7, 2, "healthy")]
    assert rows(run(running.windowed_counts(stream, "created_at", "health_status"), "complete", "wc"), "health_status", "n") == [("healthy", 1), ("sick", 1), ("sick", 1)]
    assert run(running.deduplicated(stream, ["plant_id", "file"], "created_at"), "append", "dd").count() == 2
