"""Lookups in small reference tables: texts of a class and its care plan.

The tables are broadcast if they are small, which is checked by counting them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import common_name, is_healthy
from foliant.plans.workspace import BROADCAST_ROWS

PLAN = ("actions", "products", "nutrition", "prevention")


def dimension(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lookup(df: DataFrame, cls: str, kb: DataFrame, description: str, treatment: str) -> DataFrame:
    """df with common_name, description, treatment and known of its class by kb (class, common_name, description, treatment).

    A class that is not in kb gets its spaced name and the two default texts; a null class gets nulls. kb.class must be unique.
    """
    k = dimension(kb.select(F.col("class").alias("_k"), F.col("common_name").alias("_n"), F.col("description").alias("_d"), F.col("treatment").alias("_t")))
    out = df.join(k, F.col(cls) == F.col("_k"), "left")
    known = F.col("_k").isNotNull()
    pick = lambda a, b: F.when(known, F.col(a)).when(F.col(cls).isNotNull(), b)
    return out.withColumns({"common_name": pick("_n", common_name(cls)), "description": pick("_d", F.lit(description)), "treatment": pick("_t", F.lit(treatment)), "known": known}).drop("_k", "_n", "_d", "_t")


def care_plans(df: DataFrame, cls: str, class_base: DataFrame, plans: DataFrame, nuances: DataFrame, generic: str, healthy: str) -> DataFrame:
    """df with the arrays actions, products, nutrition, prevention of its class, in two hops.

    class_base (class, base) leads to plans (base and the four arrays). A class that holds `healthy` takes the plan named
    `healthy`, one without a base the plan `generic`. nuances (prefix, nutrition): a prefix of the class, the longest that fits,
    replaces the nutrition of a plan that was found through a base. A null class gets nulls. Keys must be unique.
    """
    base = dimension(class_base.select(F.col("class").alias("_c"), F.col("base").alias("_base")))
    x = df.join(base, F.col(cls) == F.col("_c"), "left")
    own = F.col("_base").isNotNull() & ~is_healthy(cls)
    x = x.withColumn("_own", own).withColumn("_plan", F.when(F.col(cls).isNull(), None).when(is_healthy(cls), F.lit(healthy)).otherwise(F.coalesce("_base", F.lit(generic))))
    p = dimension(plans.select(F.col("base").alias("_b"), *(F.col(c).alias(f"_{c}") for c in PLAN)))
    x = x.join(p, F.col("_plan") == F.col("_b"), "left")
    # every beginning of a class that has a base meets the prefixes in an equi-join; the longest stays
    starts = class_base.select(F.col("class").alias("_s")).distinct().select("_s", F.explode(F.sequence(F.lit(0), F.length("_s"))).alias("_len"))
    starts = starts.select("_s", "_len", F.expr("left(_s, _len)").alias("_start"))
    own_nutrition = starts.join(dimension(nuances.select("prefix", F.col("nutrition").alias("_texts"))), F.col("_start") == F.col("prefix"))
    own_nutrition = own_nutrition.groupBy("_s").agg(F.max_by("_texts", "_len").alias("_texts"), F.lit(True).alias("_has"))
    x = x.join(dimension(own_nutrition), F.col(cls) == F.col("_s"), "left")
    nutrition = F.when(F.col("_own") & F.col("_has"), F.col("_texts")).otherwise(F.col("_nutrition"))
    return x.withColumns({c: (nutrition if c == "nutrition" else F.col(f"_{c}")) for c in PLAN}).drop("_c", "_base", "_own", "_plan", "_b", "_s", "_texts", "_has", *(f"_{c}" for c in PLAN))
