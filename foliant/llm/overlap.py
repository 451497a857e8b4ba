"""Same or almost the same records across splits: edit-distance segment join.

An evaluation string is cut into k+1 segments. At most k edits leave one segment untouched,
so a training string within k edits holds that segment, moved by no more than the edits allow.
Training strings give their substrings at the allowed positions, both meet in an equi-join on
the segment, and the pairs that meet are verified by dynamic programming within a band of k.

Equal strings form one class, and classes are joined instead of records; so copies add no
pairs. A segment where very many classes of both sides meet is cut again: of two strings that have it in common what
lies left and right of it still differs by at most k edits, so a segment of that rest is common as well, and the
classes meet in (segment, segment of the rest) instead, and so on. Nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.workspace import small, store


def _start(size: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k+1 of a string, the longer ones last."""
    base, long_from = F.floor(size / (k + 1)), (k + 1) - size % (k + 1)
    start = base * i + F.greatest(F.lit(0), F.lit(i) - long_from) + 1
    return start.cast("int"), (base + F.when(F.lit(i) >= long_from, 1).otherwise(0)).cast("int")


def _piece(key: Column, value: Column, i: int, size: Column, start: Column, n: Column, more: str) -> Column:
    """The key of a segment, chained to the key before it; with `room` or `rest` a struct of it and the length or the characters that the string has besides."""
    found = F.xxhash64(key, F.lit(i), size.cast("int"), F.substring(value, start, n)).alias("key")
    if more == "room":
        return F.struct(found, (F.length(value) - n).alias("room"))
    rest = F.concat(F.substring(value, F.lit(1), start - 1), F.substring(value, start + n, F.length(value)))
    return F.struct(found, rest.alias("rest")) if more else found


def eval_segments(key: Column, value: Column, k: int, more: str = "") -> Column:
    """Array of the segments of an evaluation string, each under (key, i, length of the string)."""
    size = F.length(value)
    return F.array(*(_piece(key, value, i, size, *_start(size, i, k), more) for i in range(k + 1)))


def train_segments(key: Column, value: Column, k: int, more: str = "") -> Column:
    """Array of the substrings of a training string under (key, i, length), for every evaluation length within k and every allowed position.

    Of two strings within k edits some segment i is common such that what lies left of it takes at most i edits and what lies
    right of it at most k - i; so it has moved by at most i, and by at most k - i from the end.
    """
    out = []
    for d in range(-k, k + 1):
        size = F.length(value) + d
        for i in range(k + 1):
            start, n = _start(size, i, k)
            for s in range(max(-i, -d - (k - i)), min(i, -d + (k - i)) + 1):
                ok = (size >= 0) & (start + s >= 1) & (start + s + n - 1 <= F.length(value))
                out.append(F.when(ok, _piece(key, value, i, size, start + s, n, more)))
    return F.array_compact(F.array_distinct(F.array(*out)))


def edit_join(left: DataFrame, right: DataFrame, k: int, width: int | None = None, hot: int = 4_096) -> DataFrame:
    """a, b, va, vb, edits: pairs of classes (cid, value) of left (training) and right (evaluation) within k edits.

    value is a string; nulls match nothing, equal cids are not paired. With `width` all values have that
    length and only substitutions count as edits (codes of fixed width), so a segment has one allowed position; else insertions and
    deletions count as well, and strings of k characters or fewer meet by their empty segments.
    hot: a segment where more than this many pairs would meet is cut again, on both sides. Each cut multiplies the rows, so from level to
    level a segment must be (k+1) squared times as crowded, which keeps the work below that of pairing them; what is too short to be cut meets as it is.
    """
    l, r = left.filter("value IS NOT NULL").select("cid", "value"), right.filter("value IS NOT NULL").select("cid", "value")
    train = eval_segments if width else train_segments
    cut = lambda d, how, more="": d.select("cid", F.explode(how(F.col("key"), F.col("rest"), k, more)).alias("x"))
    keys = lambda d, how: cut(d, how).select("cid", F.col("x").alias("key"))
    first = lambda d: d.select("cid", F.lit(0).cast("bigint").alias("key"), F.col("value").alias("rest"))
    fl, fr, met, few = first(l), first(r), None, min(4, hot)
    while True:
        sl, sr = keys(fl, train), keys(fr, eval_segments)
        # segments of few evaluation classes make no more than `few` pairs for each training segment; only the others are counted on both sides
        many = cut(fr, eval_segments, "room").groupBy(F.col("x.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("x.room").alias("room")).filter((F.col("n") > few) & (F.col("room") > 2 * k + 1))
        many = small(many.select("key", "n"), "many")
        both = sl.join(many, "key").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
        many = small(both.filter(F.col("m") * F.col("n") > hot).select("key"), "hot")
        crowded = not many.isEmpty()
        cold = (lambda d: d.join(many, "key", "left_anti")) if crowded else (lambda d: d)
        pairs = cold(sl).withColumnRenamed("cid", "a").join(cold(sr).withColumnRenamed("cid", "b"), "key").select("a", "b")
        met = pairs if met is None else met.unionByName(pairs)
        if not crowded:
            break
        again = lambda d, how: store(cut(d, how, "rest").select("cid", "x.*").join(many, "key", "left_semi"), "again")
        fl, fr = again(fl, train), again(fr, eval_segments)
        hot, few = hot * (k + 1) ** 2, few * (k + 1)
    met = met.filter("a <> b").distinct()
    both = met.join(l.select(F.col("cid").alias("a"), F.col("value").alias("va")), "a").join(r.select(F.col("cid").alias("b"), F.col("value").alias("vb")), "b")
    edits = F.levenshtein("va", "vb", k)  # the threshold makes this the banded form
    return both.withColumn("edits", edits).filter("edits >= 0")


def _digit_bits(a: str, b: str) -> Column:
    """Differing bits of two strings of 64 hexadecimal digits."""
    word = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("bigint")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(4)), F.lit(0))


def picture_classes(rows: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed, classes, near) of rows (row_id, side, ahash, size; other columns stay in packed).

    packed: the rows that can be like another, with ahash as value. classes: value, cid (its smallest row_id), t, e: whether the class has training and evaluation
    rows. near: va, vb: values of training and evaluation that differ in at most max_bits bits, equal ones included.
    """
    blank = [F.unhex(F.lit(x * 64)) for x in "0F"]
    packed = rows.withColumnRenamed("ahash", "value").filter(F.col("side").isin("train", "eval") & (F.octet_length("value") == 32) & F.col("size").isNotNull() & ~F.col("value").isin(*blank))
    classes = packed.groupBy("value").agg(F.min("row_id").alias("cid"), F.bool_or(F.col("side") == "train").alias("t"), F.bool_or(F.col("side") == "eval").alias("e"))
    classes = store(classes, "classes")
    text = lambda flag: classes.filter(flag).select("cid", F.hex("value").alias("value"))
    near = edit_join(text("t"), text("e"), max_bits, width=64)
    near = near.filter(_digit_bits("va", "vb") <= max_bits).select(F.unhex("va").alias("va"), F.unhex("vb").alias("vb"))
    own = classes.filter("t AND e").select(F.col("value").alias("va"), F.col("value").alias("vb"))
    return packed, classes, store(near.unionByName(own), "near")


def cross_split_pairs(rows: DataFrame, max_bits: int = 4, max_size: int = 5_120) -> DataFrame:
    """id_lo, id_hi of pictures in train and in val or test that are the same or almost the same.

    rows: row_id, side ('train' or 'eval'; other rows are left aside), md5, ahash (256 bits), size.
    The same: equal md5 (null matches nothing). Almost: both have an ahash and a size, at most
    max_bits bits differ and sizes are within max_size. An ahash of zeros or ones only is like no
    other; one of another length is none. Bits that differ are at most as many substituted
    hexadecimal digits, so the hashes are joined as 64 digits with max_bits edits, and the bits
    are counted on the pairs that remain. Pairs are distinct; row_id must be unique.
    """
    rows = rows.select("row_id", "side", "md5", "ahash", F.col("size").cast("bigint").alias("size")).filter(F.col("side").isin("train", "eval"))
    packed, _, near = picture_classes(rows.drop("md5"), max_bits)

    # members: sizes within max_size lie in the same or the next bucket
    wide = max_size + 1
    used = near.select(F.explode(F.array("va", "vb")).alias("value")).distinct()
    members = store(packed.join(used, "value", "left_semi").withColumn("bucket", F.floor(F.col("size") / wide)), "members")
    t = members.filter("side = 'train'").select(F.col("value").alias("va"), F.col("row_id").alias("ta"), F.col("size").alias("sa"), "bucket")
    e = members.filter("side = 'eval'").select(F.col("value").alias("vb"), F.col("row_id").alias("tb"), F.col("size").alias("sb"), F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))).alias("bucket"))
    almost = near.select("va", "vb").join(t, "va").join(e, ["vb", "bucket"]).filter(F.abs(F.col("sa") - F.col("sb")) <= max_size).select("ta", "tb")

    sums = rows.filter("md5 IS NOT NULL").select("row_id", "side", "md5")
    same = sums.filter("side = 'train'").select(F.col("row_id").alias("ta"), "md5").join(sums.filter("side = 'eval'").select(F.col("row_id").alias("tb"), "md5"), "md5").select("ta", "tb")
    return almost.unionByName(same).select(F.least("ta", "tb").alias("id_lo"), F.greatest("ta", "tb").alias("id_hi")).distinct()


def overlapping_rows(rows: DataFrame, max_bits: int = 4, max_size: int = 5_120) -> DataFrame:
    """rows of the evaluation side with class_id, same_md5 and near: whether the training side holds such a picture; by the rules of cross_split_pairs, without any pairs of rows.

    class_id is the smallest row_id among the rows of both sides with that hash; null for a row that can be like no other. rows may have further columns.
    A training class tells its smallest and largest size in each bucket of max_size + 1 bytes: sizes in one bucket are near, and in the
    next ones the extreme is the nearest. So the work grows with the classes and the rows, however many copies a class has.
    """
    wide = max_size + 1
    rows = rows.withColumn("size", F.col("size").cast("bigint"))
    packed, classes, near = picture_classes(rows.select("row_id", "side", "ahash", "size"), max_bits)
    packed = packed.withColumn("bucket", F.floor(F.col("size") / wide))
    t = packed.filter("side = 'train'").groupBy(F.col("value").alias("va"), "bucket").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    around = near.join(t, "va").groupBy(F.col("vb").alias("value"), "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = F.explode(F.array(*(F.struct((F.col("bucket") + d).alias("bucket"), F.when(F.lit(d == 1), F.col("hi")).alias("hi"), F.when(F.lit(d == -1), F.col("lo")).alias("lo")) for d in (-1, 0, 1)))).alias("x")
    around = around.select("value", at).select("value", "x.*").withColumn("inside", F.col("hi").isNull() & F.col("lo").isNull())
    # for each evaluation value and bucket: a training size in the bucket, the largest in the one below, the smallest in the one above
    around = around.groupBy("value", "bucket").agg(F.bool_or("inside").alias("inside"), F.max("hi").alias("below"), F.min("lo").alias("above"))
    own = classes.filter("e").select(F.col("value").alias("_own"), F.col("cid").alias("class_id"))
    e = rows.filter("side = 'eval'").withColumn("bucket", F.floor(F.col("size") / wide))
    sized = e.join(own, (F.col("ahash") == F.col("_own")) & F.col("size").isNotNull(), "left")
    around = around.select(F.col("value").alias("_v"), F.col("bucket").alias("_b"), "inside", "below", "above")
    out = sized.join(around, (F.col("ahash") == F.col("_v")) & (F.col("bucket") == F.col("_b")) & F.col("class_id").isNotNull(), "left")
    near_by = F.coalesce(F.col("inside"), F.lit(False)) | F.coalesce(F.col("below") >= F.col("size") - max_size, F.lit(False)) | F.coalesce(F.col("above") <= F.col("size") + max_size, F.lit(False))
    sums = rows.filter("side = 'train' AND md5 IS NOT NULL").select(F.col("md5").alias("_m")).distinct().withColumn("_same", F.lit(True))
    out = out.withColumn("near", near_by).join(sums, F.col("md5") == F.col("_m"), "left").withColumn("same_md5", F.coalesce("_same", F.lit(False)))
    return out.select(*rows.columns, "class_id", "same_md5", "near")
