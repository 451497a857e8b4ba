"""Splits that keep related records together: largest-differencing balance.

Related records form units (components). The units of a stratum are to be put into many bins
of equal weight, whole bins then go to the splits by target proportion. Largest differencing
(Karmarkar and Karp) starts with one partial partition for each unit and repeatedly combines
the two with the widest spread, the heaviest bin of one with the lightest of the other.

A stratum may have billions of units, so its units are first counted by weight: units of one weight are alike. Of m units of
one weight, as many as fill all bins equally change no spread, so differencing would deal them out evenly; that is done at
once, but for the last KEPT rounds, which take part in differencing one by one so that light units can even out the heavy
ones. Every unit is placed; less than (KEPT + 1) * bins units of each weight are differenced. There are at most
sqrt(2 * rows) different weights, so this runs on a few items whatever the size of the stratum.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.operators.ranking import null_safe, ranked
from foliant.plans.workspace import small, store

#: Rounds of each weight that are left to differencing.
KEPT = 4


def differencing(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight by largest differencing; ties by position, so the result is fixed."""
    if not weights:
        return []
    heap = []
    for i, w in enumerate(weights):
        sums = np.zeros(bins, dtype=np.int64)
        sums[0] = w
        heap.append((-int(w), i, sums, [[i]] + [[] for _ in range(bins - 1)]))
    heapq.heapify(heap)
    at = len(weights)
    while len(heap) > 1:
        _, _, sa, pa = heapq.heappop(heap)
        _, _, sb, pb = heapq.heappop(heap)
        s = sa + sb[::-1]
        parts = [x + y if len(x) >= len(y) else y + x for x, y in zip(pa, pb[::-1])]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), at, s, [parts[j] for j in order]))
        at += 1
    out = [0] * len(weights)
    for b, members in enumerate(heap[0][3]):
        for i in members:
            out[i] = b
    return out


def allocate(sums: list[int], shares: dict[str, float]) -> list[str]:
    """A split for each bin: the heaviest bin first, to the split that lacks most of its share; then bins are swapped while that brings the splits closer to their shares."""
    total, names, have = sum(sums) or 1, list(shares), dict.fromkeys(shares, 0)
    out = [names[0]] * len(sums)
    for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        out[i] = max(names, key=lambda n: (shares[n] * total - have[n], -names.index(n)))
        have[out[i]] += sums[i]
    over = {n: have[n] - shares[n] * total for n in names}
    moved = True
    while moved:
        moved = False
        for i in range(len(sums)):
            for j in range(i):
                a, b, d = out[i], out[j], sums[i] - sums[j]
                # moving d from a to b; each swap lowers the squared deviation, so this ends
                if a != b and 2 * d * (over[b] - over[a] + d) < -1e-9 * total:
                    out[i], out[j] = b, a
                    over[a] -= d
                    over[b] += d
                    moved = True
    return out


def balance(units: DataFrame, shares: dict[str, float], bins: int = 20) -> DataFrame:
    """units (unit columns, stratum, weight) with new_split.

    stratum may be null (a stratum of its own); weight is a positive bigint. `order_key` must be a bigint column that orders
    units of equal weight, fixed for a unit. Units of one stratum and weight are alike, so differencing gives how many of them go
    to each split, and the units follow in that order. An empty table stays empty.
    """
    units = store(units, "units")
    placed = ranked(units, ["stratum", "weight"], ["order_key"])
    hist = units.groupBy("stratum", "weight").agg(F.count(F.lit(1)).alias("m"))
    names = list(shares)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("weight", ascending=False)
        weights, counts = [int(w) for w in pdf["weight"]], [int(m) for m in pdf["m"]]
        dealt = [max(0, m // bins - KEPT) for m in counts]
        left = [(i, w) for i, (w, m, d) in enumerate(zip(weights, counts, dealt)) for _ in range(m - d * bins)]
        put = differencing([w for _, w in left], bins)
        sums = [sum(w * d for w, d in zip(weights, dealt))] * bins
        for (_, w), b in zip(left, put):
            sums[b] += w
        split = [names.index(n) for n in allocate(sums, shares)]
        per = np.array([[d * split.count(k) for k in range(len(names))] for d in dealt], dtype=np.int64)
        for (i, _), b in zip(left, put):
            per[i, split[b]] += 1
        return pd.DataFrame({"p_stratum": pdf["stratum"].iloc[0], "p_weight": weights, "upto": list(per.cumsum(1))})

    plans = small(hist.groupBy("stratum").applyInPandas(plan, "p_stratum string, p_weight bigint, upto array<bigint>"), "plans")
    placed = placed.join(plans, placed["stratum"].eqNullSafe(plans["p_stratum"]) & (placed["weight"] == plans["p_weight"]))
    split = F.lit(names[-1])
    for k in reversed(range(len(names) - 1)):
        split = F.when(F.col("rank") <= F.get("upto", F.lit(k)), names[k]).otherwise(split)
    return placed.withColumn("new_split", split).drop("p_stratum", "p_weight", "upto", "rank", "group_rows")


def linked_rows(rows: DataFrame, row_id: str, keys: list[list[str]]) -> DataFrame:
    """rows with `unit`, the smallest row_id of those that share the values of any of several keys, directly or through further rows.

    Each key is a list of columns; a null in its last column links nothing, one in another column is a value. A key value's rows are linked to the
    smallest row_id that has it, a star and not all pairs, and the stars are joined to components. With one key the stars
    are the components already. Rows without a link are units of their own; row_id must be unique.
    """
    def hubs(i: int, cols: list[str]) -> tuple[DataFrame, Column]:
        hub = rows.filter(F.col(cols[-1]).isNotNull()).groupBy(*(F.col(c).alias(f"_k{i}_{j}") for j, c in enumerate(cols))).agg(F.min(row_id).alias(f"_hub{i}"))
        return hub, null_safe(rows, hub, {c: f"_k{i}_{j}" for j, c in enumerate(cols)}) & rows[cols[-1]].isNotNull()

    if len(keys) == 1:
        hub, on = hubs(0, keys[0])
        return rows.join(hub, on, "left").select(*rows.columns, F.coalesce("_hub0", row_id).alias("unit"))
    links = None
    for i, cols in enumerate(keys):
        hub, on = hubs(i, cols)
        x = rows.join(hub, on).select(F.col(row_id).alias("a"), F.col(f"_hub{i}").alias("b"))
        links = x if links is None else links.unionByName(x)
    of = components(links).select(F.col("node").alias("_node"), F.col("group_id").alias("_group"))
    return rows.join(of, F.col(row_id) == F.col("_node"), "left").select(*rows.columns, F.coalesce("_group", row_id).alias("unit"))


#: Bits of the splits in masks.
BITS = {"train": 1, "val": 2, "test": 4}


def units_of(rows: DataFrame) -> DataFrame:
    """Units of rows (unit, stratum, present): unit, stratum, weight, mask.

    The stratum of a unit is that of most of its rows, ties by the smaller, null last. mask has bit 1, 2 or 4 for rows that
    now stand in train, val or test. Strata are numbered in order first, so that all states are numbers and each task
    combines its own rows in a hash table.
    """
    names = rows.select("stratum").filter("stratum IS NOT NULL").distinct()
    numbered = small(ranked(names, [], ["stratum"]).select(F.col("stratum").alias("name"), F.col("rank").alias("at")), "strata")
    flag = F.coalesce(*(F.when(F.col("present") == s, b) for s, b in BITS.items()), F.lit(0))
    coded = rows.select("unit", "stratum", flag.alias("flag")).join(numbered, F.col("stratum") == F.col("name"), "left").select("unit", F.coalesce("at", F.lit(0)).alias("at"), "flag")
    per = coded.groupBy("unit", "at").agg(F.count(F.lit(1)).alias("n"), F.bit_or("flag").alias("mask"))
    # the largest number: most rows first, then a stratum before none, then the smaller stratum
    rank = F.shiftleft("n", 31) + F.when(F.col("at") > 0, F.lit((1 << 31) - 1) - F.col("at")).otherwise(F.lit(0))
    per = per.groupBy("unit").agg(F.sum("n").alias("weight"), F.bit_or("mask").alias("mask"), F.max(rank).alias("top"))
    low = F.col("top").bitwiseAND(F.lit((1 << 31) - 1))
    per = per.withColumn("_at", F.when(low > 0, F.lit((1 << 31) - 1) - low))
    return per.join(numbered, F.col("_at") == F.col("at"), "left").select("unit", F.col("name").alias("stratum"), "weight", "mask")


def torn(mask: Column, new_split: Column) -> Column:
    """Whether the rows of a unit stand in more than one split: those in the new split of the unit stay, and some others would have to move, or others come from two splits."""
    own = F.coalesce(*(F.when(new_split == s, b) for s, b in BITS.items()), F.lit(0))
    stay, move = mask.bitwiseAND(own) != 0, mask.bitwiseAND(F.bitwise_not(own))
    return (stay & (move != 0)) | (F.bit_count(move) > 1)
