"""From scores to predictions: softmax, top-k, the confidence gate and the payload.

All of it is array expressions on one row; no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import display_name, is_healthy, percent

THRESHOLD, TOP_K = 0.55, 3


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(logits: Column | str) -> Column:
    """Stable softmax of an array; null for a null, empty or partly null array."""
    x = F.transform(_c(logits), lambda a: a.cast("double"))
    e = F.transform(x, lambda a: F.exp(a - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda s, a: s + a)
    return F.when((F.size(x) > 0) & ~F.exists(x, lambda a: a.isNull()), F.transform(e, lambda a: a / total))


def argmax(a: Column | str) -> Column:
    """Index from 0 of the first largest value; null for an empty array."""
    x = _c(a)
    return F.when(F.size(x) > 0, F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_k(probs: Column | str, k: int = TOP_K) -> Column:
    """The k largest as array<struct<idx, prob>>, ties by the smaller index."""
    p = _c(probs)
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"]).alias("prob")))


def others(ranked: Column | str) -> Column:
    """The candidates after the first."""
    x = _c(ranked)
    return F.slice(x, 2, F.size(x))


def gate(confidence: Column | str, threshold: float = THRESHOLD) -> Column:
    """Whether a prediction is accepted: at the threshold it is; a null confidence is not."""
    return F.coalesce(_c(confidence) >= threshold, F.lit(False))


def reason(confidence: Column | str, threshold: float = THRESHOLD) -> Column:
    """Why a prediction is not accepted; null if it is."""
    text = F.concat(F.lit("confidence "), F.coalesce(percent(confidence, 2), F.lit("unknown")), F.lit(" is below "), F.lit(f"{threshold * 100:.0f}%"))
    return F.when(~gate(confidence, threshold), text)


def health_status(cls: Column | str, accepted: Column) -> Column:
    """healthy for a healthy class even if it is not accepted, else sick if accepted, else unknown."""
    return F.when(is_healthy(cls), "healthy").when(accepted, "sick").otherwise("unknown")


def service_status(accepted: Column, confidence: Column | str) -> Column:
    return F.when(accepted, "active").when(_c(confidence).isNotNull(), "insufficient_confidence").otherwise("unavailable")


def predictions(df: DataFrame, row_id: str, logits: str, classes: list[str], threshold: float = THRESHOLD, k: int = TOP_K) -> DataFrame:
    """row_id, cls, confidence, accepted, reason, status, matches, probabilities for each row of logits.

    classes are the names by index; a logit beyond them has a null name. Rows without logits have nulls and are not accepted.
    Severity and deficiency are not in the scores and stay null, never imputed.
    """
    names = F.array(*(F.lit(c) for c in classes))
    base = df.select(row_id, softmax(logits).alias("p")).withColumn("t", top_k("p", k))
    match = F.transform("t", lambda s: F.struct(F.get(names, s["idx"]).alias("class"), display_name(F.get(names, s["idx"])).alias("name"), s["prob"].alias("confidence")))
    out = base.withColumn("matches", match).withColumn("first", F.get("matches", F.lit(0)))
    ok = gate("confidence", threshold)
    return out.select(row_id, F.col("first.class").alias("cls"), F.col("first.confidence").alias("confidence"), "matches").select(
        "*", ok.alias("accepted"), reason("confidence", threshold).alias("reason"), health_status("cls", ok).alias("status"),
        service_status(ok, "confidence").alias("service"), F.map_from_entries(F.transform("matches", lambda m: F.struct(m["class"], m["confidence"]))).alias("probabilities"),
        F.lit(None).cast("double").alias("severity"), F.lit(None).cast("string").alias("severity_category"), F.lit(None).cast("string").alias("deficiency"),
    )


def quality_warnings(width: Column | str, height: Column | str, values: Column | str) -> Column:
    """array of aspect, black or white, uniform: warnings on an image by its size and its pixel values in 0..1.

    aspect: a side is zero or more than four times the other. black: mean below 0.05; white: above 0.95. uniform:
    population deviation below 0.03. Null values give no warning.
    """
    w, h, v = _c(width), _c(height), F.transform(_c(values), lambda a: a.cast("double"))
    n = F.greatest(F.size(v), F.lit(1))
    mean = F.aggregate(v, F.lit(0.0), lambda s, a: s + a) / n
    var = F.aggregate(v, F.lit(0.0), lambda s, a: s + (a - mean) * (a - mean)) / n
    some = F.size(v) > 0
    odd = (w == 0) | (h == 0) | (w / F.greatest(h, F.lit(1)) > 4) | (h / F.greatest(w, F.lit(1)) > 4)
    return F.array_compact(F.array(F.when(odd, "aspect"), F.when(some & (mean < 0.05), "black").when(some & (mean > 0.95), "white"), F.when(some & (F.sqrt(var) < 0.03), "uniform")))


def too_small(width: Column | str, height: Column | str, least: int = 32) -> Column:
    return F.least(_c(width), _c(height)) < least


def upload_problem(name: Column | str, size: Column | str, most: int = 10 * 1024 * 1024) -> Column:
    """no_file, type, too_large or empty; null for a file that may be uploaded. Exactly `most` bytes are allowed."""
    from foliant.functions.paths import is_image

    n, s = _c(name), _c(size)
    return F.when(n.isNull() | (n == ""), "no_file").when(~is_image(n), "type").when(s > most, "too_large").when(s.isNull() | (s == 0), "empty")


def attention_share(heat: Column | str, above: float = 0.4) -> Column:
    """Share of the values above a limit, to four digits; null for an empty array."""
    h = _c(heat)
    return F.when(F.size(h) > 0, F.round(F.size(F.filter(h, lambda x: x > above)) / F.size(h), 4))


def payload(df: DataFrame, row_id: str, logits: str, classes: list[str], kb: DataFrame, plans: DataFrame, threshold: float = THRESHOLD, k: int = TOP_K, model_version: str = "0.1.0") -> DataFrame:
    """row_id and the nested prediction document: accepted, reason, diagnosis{}, matches[], confidence_threshold{}, disease_health_status,
    treatment_recommendations[], care_plan{}, severity, deficiency, quality_warnings[], model_version.

    kb: class, common_name, description, treatment. plans: class, actions, products, nutrition, prevention. Recommendations are given for a class that is not
    healthy even if it is not accepted; the care plan only if it is accepted.
    """
    from foliant.functions.text import common_name
    from foliant.operators.reference import PLAN, dimension

    p = predictions(df, row_id, logits, classes, threshold, k)
    p = p.join(dimension(kb.select(F.col("class").alias("_k"), F.col("common_name").alias("_n"), "description", "treatment")), F.col("cls") == F.col("_k"), "left")
    p = p.join(dimension(plans.select(F.col("class").alias("_p"), F.struct(*PLAN).alias("_plan"))), F.col("cls") == F.col("_p"), "left")
    advice = F.struct(F.coalesce("_n", common_name("cls")).alias("disease"), "description", F.col("treatment").alias("guidance"))
    sick = F.col("cls").isNotNull() & ~is_healthy("cls")
    warnings = F.col("quality_warnings") if "quality_warnings" in p.columns else F.array().cast("array<string>")
    return p.select(
        row_id, "accepted", "reason", F.struct(F.col("cls").alias("disease"), display_name("cls").alias("name"), "confidence", F.col("status").alias("health_status")).alias("diagnosis"), "matches",
        F.struct(F.lit(threshold).alias("value"), F.col("accepted").alias("met")).alias("confidence_threshold"), F.col("status").alias("disease_health_status"),
        F.when(sick, F.array(advice)).otherwise(F.array().cast("array<struct<disease:string,description:string,guidance:string>>")).alias("treatment_recommendations"),
        F.when(F.col("accepted"), F.col("_plan")).alias("care_plan"), "severity", "deficiency", warnings.alias("quality_warnings"), F.lit(model_version).alias("model_version"),
    )
