"""Entities observed over time: overview, numbering, timelines, comparison, trend.

Latest and first values are algebraic aggregates and numbers come from the distributed
ranking, so an entity may hold any share of the observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import iso
from foliant.operators.ranking import ranked


def overview(entities: DataFrame, observations: DataFrame, key: str, fk: str, order: str, status: str) -> DataFrame:
    """entities with n_observations (0 without) and latest_status, the status at the largest `order` (null without). Null keys match nothing."""
    agg = observations.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(order, status)).alias("_last"))
    out = entities.join(agg, F.col(key) == F.col("_fk"), "left")
    return out.withColumns({"n_observations": F.coalesce("_n", F.lit(0)), "latest_status": F.col(f"_last.{status}")}).drop("_fk", "_n", "_last")


def numbered(observations: DataFrame, fk: str, time: str, row_id: str) -> DataFrame:
    """observations with number_newest (1 is the newest by time, then row_id) and number_oldest (1 is the oldest); null times are oldest."""
    x = ranked(observations, [fk], [time, row_id])  # nulls first
    return x.withColumns({"number_oldest": F.col("rank"), "number_newest": F.col("group_rows") - F.col("rank") + 1}).drop("rank", "group_rows")


def with_images(observations: DataFrame, images: DataFrame, image_id: str) -> DataFrame:
    """observations with image_path and image_name, null where there is no such image; images.id must be unique."""
    im = images.select(F.col("id").alias("_im"), F.col("file_path").alias("image_path"), F.col("file_name").alias("image_name"))
    return observations.join(im, F.col(image_id) == F.col("_im"), "left").drop("_im")


def timeline(observations: DataFrame, images: DataFrame, fk: str, time: str, row_id: str) -> DataFrame:
    """fk, position (1 is the oldest), at (0 for the oldest to 1 for the newest), date, the prediction and the image path of every observation."""
    x = with_images(observations, images, "image_id")
    x = ranked(x, [fk], [time, row_id])
    at = F.when(F.col("group_rows") > 1, (F.col("rank") - 1) / (F.col("group_rows") - 1)).otherwise(F.lit(0.0))
    return x.select(fk, F.col(row_id), F.col("rank").alias("position"), at.alias("at"), iso(time).alias("date"), "predicted_disease", "health_status", "confidence", "image_path")


def timeline_summary(entities: DataFrame, observations: DataFrame, key: str, fk: str) -> DataFrame:
    """key, n_observations, trend, improvement_percentage: no_data without observations, else insufficient_data, as severity is not observed; improvement is null."""
    n = observations.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    out = entities.select(key).join(n, F.col(key) == F.col("_fk"), "left")
    return out.select(key, F.coalesce("_n", F.lit(0)).alias("n_observations"), F.when(F.col("_n").isNull(), "no_data").otherwise("insufficient_data").alias("trend"), F.lit(None).cast("double").alias("improvement_percentage"))


def compare(observations: DataFrame, requests: DataFrame, fk: str, row_id: str, columns: list[str]) -> DataFrame:
    """The two observations of each request (entity, id_1, id_2) side by side; a request whose ids are not both of the entity gives no row."""
    side = lambda i: observations.select(F.col(fk).alias(f"_e{i}"), F.col(row_id).alias(f"_i{i}"), *(F.col(c).alias(f"{c}_{i}") for c in columns))
    r = requests.select("entity", "id_1", "id_2")
    out = r.join(side(1), (F.col("entity") == F.col("_e1")) & (F.col("id_1") == F.col("_i1"))).join(side(2), (F.col("entity") == F.col("_e2")) & (F.col("id_2") == F.col("_i2")))
    return out.drop("_e1", "_i1", "_e2", "_i2")


def first_and_last(observations: DataFrame, fk: str, time: str, row_id: str) -> DataFrame:
    """entity, id_1, id_2: the oldest and the newest observation of entities with two or more."""
    s = F.struct(time, row_id)
    x = observations.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("entity")).agg(F.min(s).alias("a"), F.max(s).alias("b"), F.count(F.lit(1)).alias("n"))
    return x.filter("n > 1").select("entity", F.col(f"a.{row_id}").alias("id_1"), F.col(f"b.{row_id}").alias("id_2"))


def progress(observations: DataFrame, fk: str, time: str, row_id: str, confidence: str, status: str) -> DataFrame:
    """fk, n, n_healthy, mean_confidence, trend, axis_low, axis_high.

    healthy: the status holds `healthy` in any case. trend is up if the newest confidence is at least the oldest, else down, and
    null with fewer than two confidences. The axis spans the confidences, at least 0.2 wide about their middle, with a margin of
    0.08, within 0..1; it is null without confidences.
    """
    c, s = F.col(confidence), F.struct(F.col(time), F.col(row_id), F.col(confidence).alias("c"))
    x = observations.groupBy(fk).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.rlike(F.col(status), F.lit("(?i)healthy")), F.lit(False))).alias("n_healthy"), F.avg(c).alias("mean_confidence"),
        F.count(c).alias("_k"), F.min(F.when(c.isNotNull(), s)).alias("_a"), F.max(F.when(c.isNotNull(), s)).alias("_b"), F.min(c).alias("_lo"), F.max(c).alias("_hi"),
    )
    narrow, mid = F.col("_hi") - F.col("_lo") < 0.2, (F.col("_hi") + F.col("_lo")) / 2
    low, high = F.when(narrow, mid - 0.1).otherwise(F.col("_lo")) - 0.08, F.when(narrow, mid + 0.1).otherwise(F.col("_hi")) + 0.08
    trend = F.when(F.col("_k") < 2, None).when(F.col("_b.c") >= F.col("_a.c"), "up").otherwise("down")
    return x.select(fk, "n", "n_healthy", "mean_confidence", trend.alias("trend"), F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))).alias("axis_low"), F.when(high.isNotNull(), F.least(high, F.lit(1.0))).alias("axis_high"))


def latest_treatment(treatments: DataFrame, fk: str, row_id: str) -> DataFrame:
    """fk, treatment, treatment_date of the treatment entered last; null keys are left aside."""
    x = treatments.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.max(F.struct(row_id, "treatment_name", "applied_date")).alias("t"))
    return x.select(fk, F.col("t.treatment_name").alias("treatment"), F.col("t.applied_date").alias("treatment_date"))


def first_diagnosis(observations: DataFrame, fk: str, row_id: str) -> DataFrame:
    """fk, disease, health_status, confidence, model_version, date of the observation entered first: the initial diagnosis of an entity that has none."""
    cols = ["predicted_disease", "health_status", "confidence", "model_version", "created_at"]
    x = observations.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.min(F.struct(row_id, *cols)).alias("o"))
    return x.select(fk, F.col("o.predicted_disease").alias("disease"), "o.health_status", "o.confidence", "o.model_version", iso("o.created_at").alias("date"))


def sorted_map(m: Column | str) -> Column:
    """Entries of map<string,double> by value, largest first, ties by key."""
    e = F.map_entries(F.col(m) if isinstance(m, str) else m)
    return F.transform(F.array_sort(F.transform(e, lambda x: F.struct((-x["value"]).alias("n"), x["key"].alias("key")))), lambda s: F.struct(s["key"].alias("key"), (-s["n"]).alias("value")))


def as_of(observations: DataFrame, time: str, moment: str | None = None) -> DataFrame:
    """The observations made up to a moment (text of a timestamp, included), or up to now by the clock of the run. Null times are left aside."""
    now = F.lit(moment).cast("timestamp_ntz") if moment is not None else F.localtimestamp()
    return observations.filter(F.col(time) <= now)


def find(requests: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """requests (key) with `found` and the columns of df; a key that df does not have keeps its row with found false and nulls. df must be unique by key, null finds nothing."""
    other = df.withColumnRenamed(key, "_key")
    out = requests.join(other, F.col(key) == F.col("_key"), "left")
    return out.withColumn("found", F.col("_key").isNotNull()).drop("_key")
