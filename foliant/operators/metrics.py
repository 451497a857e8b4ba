"""Quality of predictions: accuracy, per-class figures, confusion, coverage, calibration.

Rows whose true or predicted class is null are left aside by every operator here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import to_digits


def _pairs(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """y, pred, n of the combinations that occur."""
    return _pairs(df, y, pred).groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str, pred: str, labels: DataFrame | None = None) -> DataFrame:
    """label, precision, recall, f1, support of every class among y and pred, or of the column label of `labels`; 0 where a figure is undefined."""
    c = confusion(df, y, pred)
    x = c.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.col("n"), (F.col("y") == F.col("pred")).alias("hit")),
                                   F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.col("n"), F.lit(False).alias("hit")))).alias("x")).select("x.*")
    s = x.groupBy("label").agg(F.sum(F.col("t") * F.col("n")).alias("support"), F.sum(F.col("p") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    if labels is not None:
        s = labels.select("label").distinct().join(s, "label", "left").fillna(0, ["support", "predicted", "tp"])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("label", zero(F.col("tp"), F.col("predicted")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"),
                    zero(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support")


def macro_f1(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: macro_f1, classes. Unweighted mean over the classes that occur in y or pred; null without any."""
    return per_class(df, y, pred).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def worst(df: DataFrame, y: str, pred: str, n: int = 8) -> DataFrame:
    """The n classes of smallest recall among those with support, ties by label."""
    return per_class(df, y, pred).filter("support > 0").orderBy("recall", "label").limit(n)


def coverage(df: DataFrame, y: str, pred: str, confidence: str, threshold: float = 0.55) -> DataFrame:
    """One row: n, accuracy, mean_confidence, coverage, accepted_accuracy, rejected_accuracy (null if there are none)."""
    ok, hit = F.coalesce(F.col(confidence) >= threshold, F.lit(False)), (F.col(y) == F.col(pred)).cast("double")
    return _pairs(df, y, pred).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(confidence).alias("mean_confidence"), F.avg(ok.cast("double")).alias("coverage"),
                                   F.avg(F.when(ok, hit)).alias("accepted_accuracy"), F.avg(F.when(~ok, hit)).alias("rejected_accuracy"))


def confidence_bin(confidence: Column | str, bins: int = 10) -> Column:
    """Bin from 0 of a confidence clipped to 0..1; 1 falls into the last."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.least(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int")


def calibration(df: DataFrame, y: str, pred: str, confidence: str, bins: int = 10) -> DataFrame:
    """bin, n, accuracy, confidence of the bins that are not empty; also the confidence histogram. Null confidences are left aside."""
    x = _pairs(df, y, pred).filter(F.col(confidence).isNotNull())
    clipped = F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    return x.groupBy(confidence_bin(confidence, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"), F.avg(clipped).alias("confidence"))


def ece(df: DataFrame, y: str, pred: str, confidence: str, bins: int = 10) -> DataFrame:
    """One row: ece, ece_ref. Expected calibration error; null without rows.

    ece weighs each non-empty bin by its own rows. ece_ref keeps a known misalignment: the i-th non-empty bin is weighed
    by the rows of bin i, so it differs wherever a lower bin is empty.
    """
    b = calibration(df, y, pred, confidence, bins)  # at most `bins` rows
    b = b.withColumn("i", F.row_number().over(W.orderBy("bin")) - 1)
    other = b.select(F.col("bin").alias("at"), F.col("n").alias("n_ref"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return b.join(F.broadcast(other), F.col("i") == F.col("at"), "left").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), (F.sum(gap * F.coalesce("n_ref", F.lit(0))) / F.sum("n")).alias("ece_ref"))


def epochs(df: DataFrame, epoch: list[str], loss: str, correct: str, rows: str, seconds: str) -> DataFrame:
    """epoch columns, loss and accuracy weighted by rows, and rows per second of batches."""
    w = F.greatest(F.sum(rows), F.lit(1))
    return df.groupBy(*epoch).agg((F.sum(F.col(loss) * F.col(rows)) / w).alias("loss"), (F.sum(correct) / w).alias("accuracy"), F.try_divide(F.sum(rows), F.sum(seconds)).alias("rows_per_second"))


def patience(df: DataFrame, phase: str, epoch: str, score: str, patience: int = 2) -> DataFrame:
    """df with best_before (0 at first), improved, and stopped: whether `patience` epochs without a better score came before. A phase has few epochs."""
    w = W.partitionBy(phase).orderBy(epoch)
    x = df.withColumn("best_before", F.coalesce(F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("improved", F.coalesce(F.col(score) > F.col("best_before"), F.lit(False)))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.min(epoch).over(W.partitionBy(phase))
    gone = F.col(epoch) - 1 - F.coalesce(last, first - 1)
    return x.withColumn("stopped", F.max((gone >= patience).cast("int")).over(w) == 1)


def best_of(df: DataFrame, score: str) -> DataFrame:
    """One row: best, 0 without rows."""
    return df.agg(F.coalesce(F.max(score), F.lit(0.0)).alias("best"))


def evaluation(df: DataFrame, y: str, pred: str, confidence: str, threshold: float = 0.55, bins: int = 10, n_worst: int = 8) -> DataFrame:
    """One row with all figures of an evaluation: those of `coverage`, macro_f1, classes, ece, threshold, per_class (label -> struct) and worst_classes ([label, recall])."""
    per = per_class(df, y, pred)
    low = F.slice(F.array_sort(F.collect_list(F.when(F.col("support") > 0, F.struct("recall", "label")))), 1, n_worst)
    figures = per.agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"), F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("string"), F.struct("precision", "recall", "f1", "support")))).alias("per_class"),
        F.transform(low, lambda x: F.struct(x["label"].alias("label"), x["recall"].alias("recall"))).alias("worst_classes"),
    )
    one = coverage(df, y, pred, confidence, threshold).withColumn("at", F.lit(1))
    for part in (figures, ece(df, y, pred, confidence, bins)):  # one row each
        one = one.join(part.withColumn("on", F.lit(1)), F.col("at") == F.col("on")).drop("on")
    return one.withColumn("threshold", F.lit(threshold)).drop("at")


def text_report(per: DataFrame) -> DataFrame:
    """label, line: precision, recall, F1 to two digits and support of each class of `per_class`, aligned for reading."""
    figures = (to_digits(c, 2) for c in ("precision", "recall", "f1"))
    return per.select("label", F.format_string("%-12s %9.2f %9.2f %9.2f %9d", F.col("label").cast("string"), *figures, "support").alias("line"))
