"""Perceptual hashes and clusters of nearly identical items within a label.

Two items are linked if they have the same label, agree in all but the low `low_bits` of their
hashes, differ in at most `max_bits` of those, and their sizes are at most `max_size` apart. Items of one
hash whose sizes fall into one bucket of that width are all linked to each other, so they form a
cell; cells, not items, are paired, and a picture copied a million times adds one cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.ranking import null_safe
from foliant.plans.workspace import discard, small, store


def vector_hash(v: Column | str) -> Column:
    """Average hash of a vector of up to 64 numbers as bigint: a bit for each value, the first the highest, set where it is at least the mean.

    Null for a null or empty vector, a longer one, or one with a null in it.
    """
    x = F.transform(F.col(v) if isinstance(v, str) else v, lambda a: a.cast("double"))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, a: s + a) / F.greatest(n, F.lit(1))
    bits = F.aggregate(x, F.lit(0).cast("bigint"), lambda s, a: F.shiftleft(s, 1).bitwiseOR(F.when(a >= mean, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
    return F.when((n > 0) & (n <= 64) & ~F.exists(x, lambda a: a.isNull()), bits)


def grid_hash(grid: Column | str) -> Column:
    """256-bit average hash (binary, first pixel in the highest bit) of 256 grey values; null for any other number of values."""

    @F.pandas_udf("binary")
    def hashed(s: pd.Series) -> pd.Series:
        out = []
        for g in s:
            if g is None or len(g) != 256:
                out.append(None)
                continue
            a = np.asarray(g, dtype=np.float64)
            out.append(None if np.isnan(a).any() else np.packbits(a >= a.sum() / 256).tobytes())
        return pd.Series(out, dtype=object)

    return hashed(F.col(grid) if isinstance(grid, str) else grid)


def byte_bits(a: Column, b: Column) -> Column:
    """Differing bits of two binaries of one byte."""
    n = lambda x: F.conv(F.hex(x), 16, 10).cast("int")
    return F.bit_count(n(a).bitwiseXOR(n(b)))


def cells(df: DataFrame, row_id: str, label: str, ahash: str, size: str, max_size: int = 5_120) -> DataFrame:
    """label, ahash, bucket, lo, hi, cell (smallest row_id), n of items with a 256-bit hash and a size; labels may be null."""
    return (
        df.filter((F.octet_length(ahash) == 32) & F.col(size).isNotNull())
        .groupBy(F.col(label).alias("label"), F.col(ahash).alias("ahash"), F.floor(F.col(size) / (max_size + 1)).alias("bucket"))
        .agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.min(row_id).alias("cell"), F.count(F.lit(1)).alias("n"))
    )


def cell_links(c: DataFrame, max_bits: int = 4, max_size: int = 5_120) -> DataFrame:
    """a, b, bits: linked cells, a < b. Blocked by label and the upper 248 bits; the last byte and the sizes are compared."""
    lead, last = F.substring("ahash", 1, 31), F.substring("ahash", 32, 1)
    left = c.select(F.col("label").alias("l1"), lead.alias("k1"), last.alias("x1"), F.col("bucket").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("cell").alias("a"))
    right = c.select(F.col("label").alias("l2"), lead.alias("k2"), last.alias("x2"), F.col("bucket").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("cell").alias("b"))
    # the upper neighbour of a cell is in the same or the next bucket
    left = left.withColumn("to", F.explode(F.array(F.col("b1"), F.col("b1") + 1)))
    near = left.join(right, null_safe(left, right, {"l1": "l2"}) & (F.col("k1") == F.col("k2")) & (F.col("to") == F.col("b2")))
    near = near.filter("a <> b").filter((F.col("b1") < F.col("b2")) | (F.col("a") < F.col("b")))
    near = near.withColumn("bits", byte_bits(F.col("x1"), F.col("x2"))).filter((F.col("bits") <= max_bits) & ((F.col("b1") == F.col("b2")) | (F.col("lo2") - F.col("hi1") <= max_size)))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node can reach, by alternating star contraction.

    Large stars hang a node's larger neighbours on its smallest neighbour, small stars its smaller ones and
    itself; the links settle into stars around the roots after about log(n) rounds. Stored each round. Every step
    hangs a link lower or leaves it, and repeats are dropped, so if a round changes neither the number of links nor the exact
    sum of their ends, it changed none.
    """
    e = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    before = None
    while before != (now := e.agg(F.count(F.lit(1)), F.sum(wide("u") + wide("v"))).first()):
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = store(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(large, e)
        e = new
    up = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return up.unionByName(up.select(F.col("root").alias("node"), "root").distinct())


def clusters(df: DataFrame, row_id: str, label: str, ahash: str, size: str, max_bits: int = 4, max_size: int = 5_120) -> DataFrame:
    """row_id, root of every row: the smallest row_id of its cluster. Rows without a hash or size are clusters of their own; row_id must be unique."""
    c = store(cells(df, row_id, label, ahash, size, max_size), "cells")
    of = smallest_reachable(cell_links(c, max_bits, max_size))
    c = c.join(of, F.col("cell") == F.col("node"), "left").select(F.col("label").alias("_l"), F.col("ahash").alias("_h"), F.col("bucket").alias("_b"), F.coalesce("root", "cell").alias("root"))
    rows = df.select(row_id, F.col(label).alias("_x"), F.when(F.octet_length(ahash) == 32, F.col(ahash)).alias("_y"), F.floor(F.col(size) / (max_size + 1)).alias("_z"))
    out = rows.join(c, null_safe(rows, c, {"_x": "_l"}) & (F.col("_y") == F.col("_h")) & (F.col("_z") == F.col("_b")), "left")
    return out.select(row_id, F.coalesce("root", row_id).alias("root"))


def vector_code(v: Column | str) -> Column:
    """Average hash of a vector of any length as a string of 0 and 1; null for a null or empty vector or one with a null in it.

    The vector and its mean are bound by arrays of one element: a lambda computes whatever it refers to again for each value.
    """
    x = F.transform(F.col(v) if isinstance(v, str) else v, lambda a: a.cast("double"))
    mean = lambda y: F.aggregate(y, F.lit(0.0), lambda s, a: s + a) / F.greatest(F.size(y), F.lit(1))
    bound = F.transform(F.array(x), lambda y: F.struct(y.alias("y"), mean(y).alias("mean")))
    bits = lambda b: F.array_join(F.transform(b["y"], lambda a: F.when(a >= b["mean"], "1").otherwise("0")), "")
    return F.get(F.transform(bound, lambda b: F.when((F.size(b["y"]) > 0) & ~F.exists(b["y"], lambda a: a.isNull()), bits(b))), F.lit(0))


def cell_code(ahash: Column | str) -> Column:
    """`vector_code` of a binary hash reduced to cells of four pixels, whose values are the numbers of their set bits, without the vector; null for null or no bytes."""
    cells = F.translate(F.hex(F.col(ahash) if isinstance(ahash, str) else ahash), "0123456789ABCDEF", "0112122312232334")  # set bits of each digit
    total = lambda c: sum((d * (F.length(c) - F.length(F.replace(c, F.lit(str(d)), F.lit("")))) for d in range(1, 5)), F.lit(0))
    # arrays of one element bind the cells and the smallest value that reaches the mean, else each branch would make them again
    bound = F.transform(F.array(cells), lambda c: F.struct(c.alias("c"), F.ceil(F.try_divide(total(c), F.length(c))).cast("int").alias("least")))

    def code(b: Column) -> Column:
        of = lambda least: F.translate(b["c"], "01234", "0" * least + "1" * (5 - least))
        return F.when(b["least"] == 2, of(2)).when(b["least"] == 3, of(3)).when(b["least"] == 1, of(1)).when(b["least"] == 4, of(4)).when(b["least"] == 0, of(0))

    return F.get(F.transform(F.filter(bound, lambda b: F.length(b["c"]) > 0), code), F.lit(0))


def code_bits(a: Column, b: Column) -> Column:
    """Differing places of two strings of 0 and 1 of one length."""
    words = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / 64)), lambda j: F.conv(F.substring(c, (j * 64 + 1).cast("int"), F.lit(64)), 2, -10).cast("bigint"))
    return F.aggregate(F.zip_with(words(a), words(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _cut(rows: DataFrame, parts: int) -> DataFrame:
    """rows (id, word, key, rest) with start and size: each rest is cut into parts, and each part (from start, of that size) joins the key in turn."""
    n = F.length("rest")
    base, long_from = F.floor(n / parts), parts - n % parts
    out = []
    for i in range(parts):
        start = (base * i + F.greatest(F.lit(0), F.lit(i) - long_from) + 1).cast("int")
        size = (base + F.when(F.lit(i) >= long_from, 1).otherwise(0)).cast("int")
        out.append(F.struct(F.xxhash64("key", F.lit(i), F.substring("rest", start, size)).alias("key"), start.alias("start"), size.alias("size")))
    return rows.select("id", "word", "rest", F.explode(F.array(*out)).alias("x")).select("id", "word", "rest", "x.*")


def _others(cut: DataFrame) -> DataFrame:
    """id, word, key, rest of `_cut` rows, without the part that joined the key."""
    left, right = F.substring("rest", F.lit(1), F.col("start") - 1), F.substring("rest", F.col("start") + F.col("size"), F.length("rest"))
    return cut.select("id", "word", "key", F.concat(left, right).alias("rest"))


def vector_pairs(df: DataFrame, row_id: str, label: str, vector: str, max_bits: int, hot: int = 64) -> DataFrame:
    """`code_pairs` of the average hashes of vectors; vectors without a hash are not paired."""
    return code_pairs(df.select(row_id, F.col(label).alias("label"), vector_code(vector).alias("code")), row_id, "label", "code", max_bits, hot)


def code_pairs(df: DataFrame, row_id: str, label: str, code: str, max_bits: int, hot: int = 64) -> DataFrame:
    """a, b, bits: classes of equal code, a string of 0 and 1, with the same label within max_bits of each other's code; codes of different length are never near.

    a and b are the smallest row_ids of two classes. Codes are cut into max_bits + 1 parts, of which two near ones share
    at least one, so candidates come from an equi-join on (label, part) and none is lost. Where more than `hot` classes share a
    part, what they have besides it still differs in at most max_bits places, so it is cut again, and again; nothing is
    dropped. Each cut multiplies the rows, so from level to level a part must be as many times more crowded to be cut, which
    keeps the work below that of pairing the group. The first 64 places travel with the parts as a number, so pairs that differ too much in
    them never leave the join; the others are compared in full. Null labels and codes are not paired.
    """
    c = df.groupBy(F.col(label).alias("label"), F.col(code).alias("code")).agg(F.min(row_id).alias("id"))
    c = store(c.withColumn("word", F.conv(F.substring("code", 1, 64), 2, -10).cast("bigint")), "codes")
    c = c.filter("code IS NOT NULL AND label IS NOT NULL")  # a filter before would compute the codes twice
    rows, met, many = c.select("id", "word", F.xxhash64("label", F.length("code")).alias("key"), F.col("code").alias("rest")), None, None
    while many is None or not many.isEmpty():
        if many is not None:
            rows = store(_others(cut.join(many, "key", "left_semi")), "cut")
        cut = _cut(rows, max_bits + 1)
        crowded = cut.filter(F.length("rest") - F.col("size") >= 2 * (max_bits + 1)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
        hot *= max_bits + 1
        many = small(crowded.select("key"), "crowded")
        cold = cut.join(many, "key", "left_anti").select("id", "word", "key")
        both = cold.select("key", F.col("id").alias("a"), F.col("word").alias("wa")).join(cold.select("key", F.col("id").alias("b"), F.col("word").alias("wb")), "key")
        pairs = both.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= max_bits)).select("a", "b")
        met = pairs if met is None else met.unionByName(pairs)
    # codes of up to 64 places are their length and their number
    of = lambda x: c.select(F.col("id").alias(x), F.col("label").alias(f"_l{x}"), F.col("word").alias(f"_w{x}"), F.length("code").alias(f"_n{x}"), F.when(F.length("code") > 64, F.col("code")).alias(f"_{x}"))
    near = met.distinct().join(of("a"), "a").join(of("b"), "b").filter("_la = _lb AND _na = _nb")
    near = near.withColumn("bits", F.when(F.col("_na") > 64, code_bits(F.col("_a"), F.col("_b"))).otherwise(F.bit_count(F.col("_wa").bitwiseXOR(F.col("_wb")))))
    return near.filter(F.col("bits") <= max_bits).select("a", "b", "bits")
