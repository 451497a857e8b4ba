from datetime import datetime

from pyspark.sql import functions as F

from foliant.functions import keys, paths, text


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_name_key(spark):
    assert [one(spark, keys.name_key("a"), a=v) for v in ("Fig - Chalk mildew", "__A--b_", "", "Maize_(dent)___X")] == ["fig_chalk_mildew", "a_b", "", "maize_dent_x"]
    assert one(spark, keys.name_key(F.lit(None).cast("string"))) is None


def test_split_key(spark):
    got = [one(spark, keys.split_key("a"), a=v) for v in (" Train\t", "VALIDATION", "val ", "hold", "", " test")]
    assert got == ["train", "val", "val", None, None, "test"]


def test_md5_key(spark):
    assert one(spark, keys.md5_key("a"), a="AB") == "ab" and one(spark, keys.md5_key("a"), a="") is None


def test_hamming(spark):
    a, b = bytes(32), bytes([0x80]) + bytes(30) + bytes([7])
    df = spark.createDataFrame([(a, b), (a, None), (a, b""), (b"\xff" * 32, a)], "a binary, b binary")
    assert [r.h for r in df.select(keys.hamming("a", "b").alias("h")).collect()] == [4, None, None, 256]


def test_label_extractors(spark):
    df = spark.createDataFrame([("train/Apple/a.jpg",), ("TRAIN/Apple/a.jpg",), ("color/Apple/a.jpg",), ("test/x.JPG",), ("Validation/B/c.png",), (None,), ("",)], "p string")
    got = df.select(paths.label_profile("p").alias("a"), paths.label_inspect("p").alias("b"), paths.label_manifest("p").alias("c"), paths.infer_split("p").alias("s")).collect()
    assert [tuple(r) for r in got] == [
        ("Apple", "Apple", "Apple", "train"), ("Apple", "Apple", "TRAIN", "train"), ("Apple", "color", "Apple", None), ("x.JPG", "x.JPG", "x.JPG", "test"),
        ("Validation", "B", "Validation", "val"), (None, None, None, None), (None, "unknown", "unknown", None),
    ]
    assert df.select(paths.label_manifest("p", "flat").alias("x")).first().x == "train"


def test_suffix_and_tail(spark):
    df = spark.createDataFrame([("a/b.JPEG",), ("a/.jpg",), ("a.b/c",), ("c.webp",), ("x\\y\\z.png",)], "p string")
    assert [tuple(r) for r in df.select(paths.suffix("p"), paths.is_image("p"), paths.tail("p")).collect()] == [
        (".jpeg", True, "a/b.JPEG"), ("", False, "a/.jpg"), ("", False, "a.b/c"), (".webp", True, "c.webp"), (".png", True, "y/z.png"),
    ]


def test_archive_target_and_lists(spark):
    df = spark.createDataFrame([("p/color/A/x.jpg",), ("p\\color\\A\\y.jpg",), ("p/color/z.jpg",), ("q/A/x.jpg",), ("p/color/A/",)], "e string")
    assert [r.x for r in df.select(paths.archive_target("e", "p/color/").alias("x")).collect()] == ["A/x.jpg", "A/y.jpg", None, None, None]
    assert one(spark, paths.comma_list("a"), a=" x, ,y ,") == ["x", "y"]
    assert one(spark, paths.relative("a", F.lit("/r/")), a="/r/b/c") == "b/c" and one(spark, paths.relative("a", F.lit("/r")), a="/rb/c") is None


def test_text(spark):
    assert one(spark, text.display_name("a"), a="Maize_(dent)___Tan_blight___x") == "Maize (dent) - Tan blight   x"
    assert one(spark, text.display_name("a"), a="Foo_") == "Foo"
    assert one(spark, text.common_name("a"), a="Foo_x___Bar_y") == "Foo x - Bar y"
    assert one(spark, text.percent("a", 2), a=0.12345) == "12.35%" and one(spark, text.html_escape("a"), a="<&>") == "&lt;&amp;&gt;"
    assert one(spark, text.error_key("decode", F.lit(None).cast("string"))) == "decode:unknown"
    assert one(spark, text.data_uri(F.lit(b"ab"))) == "data:image/png;base64,YWI="
    t = F.lit(datetime(2024, 3, 1, 8, 2, 37, 500)).cast("timestamp_ntz")
    assert one(spark, text.iso(t)) == "2024-03-01T08:02:37.000500" and one(spark, text.iso(F.lit("2024-03-01 08:02:37").cast("timestamp_ntz"))) == "2024-03-01T08:02:37"
    assert one(spark, text.stamp(t)) == "20240301_080237" and one(spark, text.short_label(t)) == "Mar 1 08:02"
    assert [one(spark, text.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5, 2.6)] == [0, 2, 2, 3]
