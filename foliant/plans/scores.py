"""Queries on model scores, with their SQL.

The first ten values of each embedding, times 20, stand for logits, and its label for the true class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import display_name
from foliant.operators import metrics, scoring
from foliant.plans.etl import query
from foliant.plans.tables import table

N = 10
#: Names of the ten classes, in the order of the indices.
CLASSES = ["Fig___healthy", "Fig___Chalk_mildew", "Hop___healthy", "Hop___Velvet_mold", "Leek___healthy", "Leek___Silver_fleck", "Okra___Mosaic_fade", "Beet_(sugar)___Ember_rust", "Guava___Tin_scab", "Olive___Sooty_rim"]
_NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_SCORES = f"""z AS (SELECT vec_id, label AS y, list_transform(embedding[1:{N}], lambda x: x::DOUBLE * 20) AS l FROM embeddings),
e AS (SELECT vec_id, y, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM z), p AS (SELECT vec_id, y, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
s AS (SELECT vec_id, y, p, (list_position(p, list_max(p)) - 1)::INT AS pred, list_max(p) AS conf FROM p)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, N), lambda x: x.cast("double") * 20)
    p = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("y"), logits.alias("logits")).withColumn("p", scoring.softmax("logits"))
    return p.withColumns({"pred": scoring.argmax("p"), "conf": F.array_max("p")})


@query(f"""WITH {_SCORES}, u AS (SELECT vec_id, unnest(p) AS prob, unnest(range({N})) AS idx FROM s) SELECT vec_id, rank::INT AS rank, idx::INT AS idx, ({_NAMES})[idx + 1] AS cls, round(prob, 6) AS prob
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, idx) AS rank FROM u) WHERE rank <= 3""")
def softmax_topk(spark, folder):
    top = scores(spark, folder).select("vec_id", F.posexplode(scoring.top_k("p")).alias("at", "t"))
    names = F.array(*(F.lit(c) for c in CLASSES))
    return top.select("vec_id", (F.col("at") + 1).alias("rank"), "t.idx", F.get(names, F.col("t.idx")).alias("cls"), F.round("t.prob", 6).alias("prob"))


@query(f"""WITH {_SCORES}, g AS (SELECT vec_id, ({_NAMES})[pred + 1] AS cls, conf, conf >= 0.55 AS accepted FROM s)
SELECT vec_id, cls, round(conf, 6) AS confidence, accepted, CASE WHEN NOT accepted THEN 'confidence ' || printf('%.2f', conf * 100) || '% is below 55%' END AS reason,
  CASE WHEN contains(cls, 'healthy') THEN 'healthy' WHEN accepted THEN 'sick' ELSE 'unknown' END AS status, CASE WHEN accepted THEN 'active' ELSE 'insufficient_confidence' END AS service,
  trim(replace(split_part(cls, '___', 1), '_', ' ')) || ' - ' || trim(replace(split_part(cls, '___', 2), '_', ' ')) AS name, NULL::DOUBLE AS severity FROM g""")
def predict_gate(spark, folder):
    p = scoring.predictions(scores(spark, folder), "vec_id", "logits", CLASSES)
    return p.select("vec_id", "cls", F.round("confidence", 6).alias("confidence"), "accepted", "reason", "status", "service", display_name("cls").alias("name"), "severity")


@query(f"""WITH {_SCORES}, u AS (SELECT vec_id, unnest(p) AS prob, unnest(range({N})) AS idx FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, idx) AS rank FROM u)
SELECT vec_id, string_agg(({_NAMES})[idx + 1], '|' ORDER BY rank) AS others FROM r WHERE rank BETWEEN 2 AND 3 GROUP BY 1""")
def other_candidates(spark, folder):
    p = scoring.predictions(scores(spark, folder), "vec_id", "logits", CLASSES)
    return p.select("vec_id", F.array_join(F.transform(scoring.others("matches"), lambda m: m["class"]), "|").alias("others"))


@query(f"""WITH {_SCORES} SELECT count(*) AS n, round(avg((y = pred)::INT), 6) AS accuracy, round(avg(conf), 6) AS mean_confidence, round(avg((conf >= 0.55)::INT), 6) AS coverage,
  round(avg((y = pred)::INT) FILTER (conf >= 0.55), 6) AS accepted_accuracy, round(avg((y = pred)::INT) FILTER (conf < 0.55), 6) AS rejected_accuracy FROM s""")
def accuracy_coverage(spark, folder):
    c = metrics.coverage(scores(spark, folder), "y", "pred", "conf")
    return c.select("n", *(F.round(x, 6).alias(x) for x in c.columns[1:]))


_REPORT = f"""{_SCORES}, l AS (SELECT y AS label FROM s UNION SELECT pred FROM s), q AS (SELECT label, (SELECT count(*) FROM s WHERE y = label) AS support, (SELECT count(*) FROM s WHERE pred = label) AS predicted,
  (SELECT count(*) FROM s WHERE y = label AND pred = label) AS tp FROM l),
m AS (SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall, 2 * tp / (support + predicted)::DOUBLE AS f1, support FROM q)"""


@query(f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m")
def per_class_report(spark, folder):
    return metrics.per_class(scores(spark, folder), "y", "pred").select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@query(f"WITH {_REPORT} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM m")
def macro_f1(spark, folder):
    return metrics.macro_f1(scores(spark, folder), "y", "pred").select(F.round("macro_f1", 6).alias("macro_f1"), "classes")


@query(f"WITH {_REPORT} SELECT label, round(recall, 6) AS recall, support FROM m WHERE support > 0 ORDER BY m.recall, label LIMIT 8")
def worst_classes(spark, folder):
    return metrics.worst(scores(spark, folder), "y", "pred").select("label", F.round("recall", 6).alias("recall"), "support")


@query(f"WITH {_SCORES} SELECT y, pred, count(*) AS n FROM s GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(scores(spark, folder), "y", "pred")


_BINS = f"{_SCORES}, b AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg((y = pred)::INT) AS acc, avg(conf) AS conf FROM s GROUP BY 1)"


@query(f"WITH {_BINS} SELECT bin, n, round(acc, 6) AS accuracy, round(conf, 6) AS confidence FROM b")
def confidence_histogram(spark, folder):
    """Extension: rows, accuracy and mean confidence of each tenth of confidence."""
    return metrics.calibration(scores(spark, folder), "y", "pred", "conf").select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_BINS}, i AS (SELECT *, row_number() OVER (ORDER BY bin) - 1 AS i FROM b) SELECT round(sum(abs(i.acc - i.conf) * i.n) / sum(i.n), 6) AS ece,
  round(sum(abs(i.acc - i.conf) * coalesce(o.n, 0)) / sum(i.n), 6) AS ece_ref FROM i LEFT JOIN b o ON o.bin = i.i""")
def calibration_error(spark, folder):
    e = metrics.ece(scores(spark, folder), "y", "pred", "conf")
    return e.select(F.round("ece", 6).alias("ece"), F.round("ece_ref", 6).alias("ece_ref"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE + 0.5)) AS v FROM embeddings), m AS (SELECT vec_id, label, v, list_sum(v) / 64 AS m FROM v),
d AS (SELECT vec_id, m, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / 64) AS s, label * 40 AS w, (9 - label) * 30 AS h FROM m)
SELECT vec_id, array_to_string(list_filter([CASE WHEN w = 0 OR h = 0 OR w / greatest(h, 1)::DOUBLE > 4 OR h / greatest(w, 1)::DOUBLE > 4 THEN 'aspect' END, CASE WHEN m < 0.05 THEN 'black' WHEN m > 0.95 THEN 'white' END,
  CASE WHEN s < 0.03 THEN 'uniform' END], lambda x: x IS NOT NULL), ',') AS warnings, least(w, h) < 32 AS too_small FROM d""")
def quality_flags(spark, folder):
    """Warnings by size and pixel values; the embeddings, moved by a half, stand for pixels and the label for sizes."""
    v = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.5).alias("v"), (F.col("label") * 40).alias("w"), ((9 - F.col("label")) * 30).alias("h"))
    return v.select("vec_id", F.array_join(scoring.quality_warnings("w", "h", "v"), ",").alias("warnings"), scoring.too_small("w", "h").alias("too_small"))


@query("""SELECT record_id, CASE WHEN path IS NULL OR path = '' THEN 'no_file' WHEN lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) NOT IN ('.jpg', '.jpeg', '.png', '.webp') THEN 'type'
  WHEN size_bytes > 300000 THEN 'too_large' WHEN coalesce(size_bytes, 0) = 0 THEN 'empty' END AS problem FROM split_csv""")
def validate_upload(spark, folder):
    """Why each file could not be uploaded; the limit is set to 300,000 bytes here, so that some exceed it."""
    return table(spark, folder, "split_csv").select("record_id", scoring.upload_problem("path", "size_bytes", 300_000).alias("problem"))


@query(f"""WITH {_REPORT}, a AS (SELECT count(*) AS n, avg((y = pred)::INT) AS accuracy, avg(conf) AS mean_confidence, avg((conf >= 0.55)::INT) AS coverage, avg((y = pred)::INT) FILTER (conf >= 0.55) AS accepted, avg((y = pred)::INT) FILTER (conf < 0.55) AS rejected FROM s),
w AS (SELECT label FROM m WHERE support > 0 ORDER BY recall, label LIMIT 8), b AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg((y = pred)::INT) AS acc, avg(conf) AS conf FROM s GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY bin) - 1 AS i FROM b)
SELECT a.n, round(a.accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence, round(coverage, 6) AS coverage, round(accepted, 6) AS accepted_accuracy, round(rejected, 6) AS rejected_accuracy, (SELECT round(avg(f1), 6) FROM m) AS macro_f1, (SELECT count(*) FROM m) AS classes,
  (SELECT round(sum(abs(acc - conf) * n) / sum(n), 6) FROM b) AS ece, (SELECT round(sum(abs(i.acc - i.conf) * coalesce(o.n, 0)) / sum(i.n), 6) FROM i LEFT JOIN b o ON o.bin = i.i) AS ece_ref, 0.55::DOUBLE AS threshold,
  (SELECT string_agg(printf('%d=%.4f/%.4f/%.4f/%d', label, precision, recall, f1, support), ';' ORDER BY label) FROM m) AS per_class, (SELECT string_agg(label, ',' ORDER BY label) FROM w) AS worst FROM a""")
def evaluation(spark, folder):
    """Every part of the one-row evaluation document, its lists as text."""
    e = metrics.evaluation(scores(spark, folder), "y", "pred", "conf")
    worst = F.array_join(F.array_sort(F.transform("worst_classes", lambda x: x["label"])), ",")
    entries = F.array_sort(F.transform(F.map_entries("per_class"), lambda x: F.struct(x["key"].cast("int").alias("k"), x["value"].alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    line = lambda x: F.format_string("%d=%.4f/%.4f/%.4f/%d", x["k"], x["v"]["precision"], x["v"]["recall"], x["v"]["f1"], x["v"]["support"])
    rounded = ("accuracy", "mean_confidence", "coverage", "accepted_accuracy", "rejected_accuracy", "macro_f1", "ece", "ece_ref")
    return e.select("n", *(F.round(c, 6).alias(c) for c in rounded), "classes", "threshold", F.array_join(F.transform(entries, line), ";").alias("per_class"), worst.alias("worst"))
