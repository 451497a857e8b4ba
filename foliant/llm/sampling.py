"""Samples that match target proportions of categories: systematic unequal-probability sampling.

Rows stand in random order within sorted categories. Every row of a category has the same
inclusion probability, expected rows / available rows (at most 1); the probabilities are
prefix-summed over the whole order, across partitions, and a row is selected where the sum,
shifted by one random start, passes an integer. So every category gets its expected
number, rounded up or down. Categories that come out below their floor are then drawn again
with the floor as the expected number.

What a category lacks goes to the others in proportion to their targets: all wanted numbers of a stratum are
multiplied by the one factor, at least 1, at which the sample is as large as it should be, with categories that have
too few rows giving all of them and those below their floor counting that. Met targets so keep their proportions to each other.
Which targets are unmet is then read off the sample.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranking import ranked
from foliant.plans.workspace import small, store


def _start(seed: int) -> float:
    """The random start, 0 <= u < 1."""
    return int.from_bytes(hashlib.sha256(f"start|{seed}".encode()).digest()[:6], "big") / 2**48


def _factor(plan: DataFrame) -> DataFrame:
    """of, factor: by what the wanted numbers of each stratum are multiplied; infinite if all rows together are too few.

    The size of the sample grows piecewise linearly with the factor: a category counts its floor up to floor / wanted, then factor x wanted,
    and from available / wanted on all it has. One window over the targets of a stratum, a table of parameters.
    """
    w, a, least = F.col("wanted"), F.col("available").cast("double"), F.col("floor").cast("double")
    turns = F.array(F.struct((least / w).alias("at"), w.alias("slope"), (-least).alias("base")), F.struct((a / w).alias("at"), (-w).alias("slope"), a.alias("base")))
    events = plan.filter("wanted > 0").select(F.col("stratum").alias("of"), F.explode(turns).alias("x")).select("of", "x.*")
    line = W.partitionBy("of").orderBy("at")
    sums = plan.groupBy(F.col("stratum").alias("s")).agg(F.sum("wanted").alias("size"), F.sum(least).alias("floors"))
    events = events.select("of", "at", F.lead("at").over(line).alias("until"), F.sum("slope").over(line).alias("slope"), F.sum("base").over(line).alias("base")).join(sums, F.col("of") == F.col("s"))
    fills = F.try_divide(F.col("size") - F.col("floors") - F.col("base"), F.col("slope"))
    here = (F.col("slope") > 1e-9) & (fills >= F.col("at") - 1e-9) & (fills <= F.coalesce("until", F.lit(float("inf"))) + 1e-9)
    most = events.groupBy("of", "size").agg(F.min(F.when(here, fills)).alias("fills"), F.max(F.col("floors")).alias("floors"))
    # without a place where it fills: floors alone are too many, or all rows too few
    fills = F.coalesce("fills", F.when(F.col("floors") >= F.col("size"), F.lit(1.0)).otherwise(F.lit(float("inf"))))
    return most.select("of", F.when(fills < 1 + 1e-9, 1.0).otherwise(fills).alias("factor"))


def allocation(rows: DataFrame, targets: DataFrame, fraction: tuple[int, int] = (1, 5)) -> DataFrame:
    """One row for each target (stratum, category, target_bp, min_rows): what it wants and what there is.

    available: rows of that stratum and category. stratum_rows: all rows of the stratum, those
    without a category included. The sample of a stratum is `fraction` of its rows, unrounded.
    wanted: the target's share of that sample. expected: the wanted number with what others lack, cut to what is
    available; upto is its running sum in category order.
    """
    num, den = fraction
    counts = rows.groupBy("stratum", "category").agg(F.count(F.lit(1)).alias("available"))
    counts = counts.withColumn("stratum_rows", F.sum("available").over(W.partitionBy("stratum")))
    per_stratum = counts.groupBy("stratum").agg(F.max("stratum_rows").alias("all_rows"))
    out = (
        targets.select("stratum", "category", F.col("target_bp").cast("bigint"), F.col("min_rows").cast("bigint"))
        .join(counts.filter("category IS NOT NULL").select("stratum", "category", "available"), ["stratum", "category"], "left")
        .join(per_stratum, "stratum", "left")
        .select("stratum", "category", "target_bp", "min_rows", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("all_rows", F.lit(0)).alias("stratum_rows"))
    )
    out = out.withColumn("wanted", F.col("target_bp") * F.col("stratum_rows") * num / F.lit(10_000 * den)).withColumn("floor", F.least("min_rows", "available"))
    run = W.partitionBy("stratum").orderBy("category")
    return (
        out.join(_factor(out), F.col("stratum") == F.col("of"), "left").drop("of")
        .withColumn("expected", F.when(F.col("wanted") > 0, F.least(F.col("wanted") * F.coalesce("factor", F.lit(1.0)), F.col("available").cast("double"))).otherwise(F.lit(0.0)))
        .withColumn("upto", F.sum("expected").over(run))
        .withColumn("ahead", F.col("upto") - F.col("expected"))
    )


def seeded(seed: int, row_id: str) -> Column:
    """A number of 60 random bits, fixed for a seed and a row_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))), 1, 15), 16, 10).cast("bigint")


def draw(rows: DataFrame, targets: DataFrame, fraction: tuple[int, int] = (1, 5), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of rows (row_id, stratum, category) by targets (stratum, category, target_bp, min_rows).

    sample: row_id, stratum, category of the selected rows. Rows whose category is null or has no
    target are never selected but count among the rows of their stratum; rows without a stratum are left aside.
    Repeated rows are rows. Targets must be unique in (stratum, category). Floors are repaired after the draw: a category below
    min(min_rows, available) is drawn again with exactly that many rows; where no category lacks rows, a sample grows by those.

    report: one row for each target, also one without rows, with available, wanted, drawn, share_wanted and share_drawn of its stratum's sample,
    unmet and missing. A target is unmet if the sample, having taken all its rows, still has fewer than min_rows or than wanted, which
    is compared in integers; missing is how many it lacks.
    """
    num, den = fraction
    u = _start(seed)
    kept = store(rows.select("row_id", "stratum", "category").filter("stratum IS NOT NULL"), "rows")  # names are made canonical once
    plan = small(allocation(kept, targets, fraction), "allocation")
    keyed = kept.filter("category IS NOT NULL").withColumn("shuffled", seeded(seed, "row_id"))
    wanted = keyed.join(plan.select("stratum", "category"), ["stratum", "category"], "left_semi")
    placed = ranked(wanted, ["stratum", "category"], ["shuffled", "row_id"]).join(plan.select("stratum", "category", "ahead", "expected", "floor"), ["stratum", "category"])
    ratio = F.col("rank") / F.col("group_rows")
    prior = (F.col("rank") - 1) / F.col("group_rows")
    crossed = lambda base, e: F.floor(base + e * ratio + u) > F.floor(base + e * prior + u)
    drawn_first = F.floor(F.col("ahead") + F.col("expected") + u) - F.floor(F.col("ahead") + u)
    floor = F.col("floor").cast("double")
    # a category that gives all its rows needs no draw: sums of doubles must not cost it one
    whole = F.col("expected") >= F.col("group_rows")
    sample = placed.filter(F.when(whole, True).when(drawn_first < floor, crossed(F.lit(0.0), floor)).otherwise(crossed(F.col("ahead"), F.col("expected")))).select("row_id", "stratum", "category")
    sample = store(sample, "sample")
    drawn = sample.groupBy("stratum", "category").agg(F.count(F.lit(1)).alias("n"))
    report = plan.join(drawn, ["stratum", "category"], "left").withColumn("drawn", F.coalesce("n", F.lit(0)))
    enough = F.col("drawn") * (10_000 * den) >= F.col("target_bp") * F.col("stratum_rows") * num
    unmet = (F.col("drawn") == F.col("available")) & ((F.col("drawn") < F.col("min_rows")) | ~enough)
    share = lambda c: F.round(F.col(c) / F.nullif(F.sum(c).over(W.partitionBy("stratum")), F.lit(0)), 6)
    report = report.select("stratum", "category", "target_bp", "min_rows", "available", "stratum_rows", "wanted", "drawn", share("wanted").alias("share_wanted"), share("drawn").alias("share_drawn"), unmet.alias("unmet"))
    return sample, report.withColumn("missing", F.when(F.col("unmet"), F.greatest(F.ceil("wanted"), "min_rows") - F.col("drawn")).otherwise(F.lit(0)))
