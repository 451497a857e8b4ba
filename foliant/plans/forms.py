"""Queries of stored forms: schemas, lookups, texts, uploads, training logs and prediction documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import paths, text
from foliant.operators import changes, metrics, monitor, neardup, profile, scoring
from foliant.plans.etl import FILES, files, query
from foliant.plans.monitoring import _ISO, first_diagnosis
from foliant.plans.scores import _NAMES, _REPORT, _SCORES, CLASSES, scores
from foliant.plans.schemas import conform, declared, violations
from foliant.plans.tables import table

_STORED = ("plants", "images", "observations", "treatments")


@query(f"SELECT table_name, column_name, ordinal_position::INT AS position FROM information_schema.columns WHERE table_name IN {_STORED}")
def table_schemas(spark, folder):
    """The declared columns of the stored tables, in order, which are those of the files."""
    rows = [(n, f.name, i + 1) for n in _STORED for i, f in enumerate(declared(n).fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


@query("""SELECT 'plants' AS name, 'id' AS "column", count(*) FILTER (id IS NULL) AS n FROM plants UNION ALL SELECT 'plants', 'plant_id', count(*) FILTER (plant_id IS NULL) FROM plants UNION ALL SELECT 'plants', 'crop', count(*) FILTER (crop IS NULL) FROM plants
UNION ALL SELECT 'images', 'id', count(*) FILTER (id IS NULL) FROM images UNION ALL SELECT 'images', 'file_path', count(*) FILTER (file_path IS NULL) FROM images UNION ALL SELECT 'images', 'file_name', count(*) FILTER (file_name IS NULL) FROM images
UNION ALL SELECT 'observations', 'id', count(*) FILTER (id IS NULL) FROM observations UNION ALL SELECT 'observations', 'plant_id', count(*) FILTER (plant_id IS NULL) FROM observations
UNION ALL SELECT 'treatments', 'id', count(*) FILTER (id IS NULL) FROM treatments UNION ALL SELECT 'treatments', 'plant_id', count(*) FILTER (plant_id IS NULL) FROM treatments UNION ALL SELECT 'treatments', 'treatment_name', count(*) FILTER (treatment_name IS NULL) FROM treatments""")
def schema_violations(spark, folder):
    """Rows of the stored tables, brought to their declared types, that lack a value that must be given."""
    out = None
    for n in _STORED:
        v = violations(conform(table(spark, folder, n), n), n).select(F.lit(n).alias("name"), "column", "n")
        out = v if out is None else out.unionByName(v)
    return out


@query("""WITH r AS (SELECT DISTINCT printf('PG-%06d', id) AS plant_id FROM observations) SELECT r.plant_id, p.id, p.crop, p.plant_id IS NOT NULL AS found FROM r LEFT JOIN plants p ON p.plant_id = r.plant_id""")
def find_plants(spark, folder):
    """Plants looked up by their codes, of which some do not exist."""
    codes = table(spark, folder, "observations").select(F.concat(F.lit("PG-"), changes.padded(F.col("id"), 6)).alias("plant_id")).distinct()
    return monitor.find(codes, table(spark, folder, "plants").select("plant_id", "id", "crop"), "plant_id")


@query("""SELECT p.id, coalesce(n, 0) AS n_observations, s AS latest_status FROM plants p LEFT JOIN (SELECT plant_id, count(*) AS n, nullif(arg_max(coalesce(health_status, '~'), id), '~') AS s FROM observations
WHERE created_at <= TIMESTAMP '2024-07-26 00:00:00' AND plant_id IS NOT NULL GROUP BY 1) o ON o.plant_id = p.id""")
def overview_as_of(spark, folder):
    """The overview of the plants as it stood at a moment."""
    o = monitor.as_of(table(spark, folder, "observations"), "created_at", "2024-07-26 00:00:00")
    return monitor.overview(table(spark, folder, "plants").select("id"), o, "id", "plant_id", "id", "health_status")


@query(f"""WITH f AS (SELECT o.plant_id, o.predicted_disease AS disease, o.health_status, o.confidence, o.model_version, {_ISO.format("o.created_at")} AS date FROM observations o JOIN (SELECT min(id) AS id FROM observations WHERE plant_id IS NOT NULL GROUP BY plant_id) USING (id))
SELECT p.id, CASE WHEN e THEN f.disease ELSE d.disease END AS disease, CASE WHEN e THEN f.health_status ELSE d.health_status END AS health_status, CASE WHEN e THEN f.confidence ELSE d.confidence END AS confidence, CASE WHEN e THEN f.date ELSE d.timestamp END AS date
FROM (SELECT id, d, d IS NULL OR coalesce(d.disease, d.health_status, d.confidence::VARCHAR, d.model_version, d.timestamp) IS NULL AS e FROM (SELECT id, initial_diagnosis AS d FROM plants)) p LEFT JOIN f ON f.plant_id = p.id""")
def initial_diagnoses(spark, folder):
    """Plants whose initial diagnosis, where it is empty, is that of the observation entered first."""
    p = changes.fill_diagnosis(table(spark, folder, "plants").select("id", "initial_diagnosis"), first_diagnosis(spark, folder), "id", "plant_id")
    return p.select("id", "initial_diagnosis.disease", "initial_diagnosis.health_status", "initial_diagnosis.confidence", F.col("initial_diagnosis.timestamp").alias("date"))


@query("""WITH u AS (SELECT plant_id, applied_date AS created_at, treatment_name AS file_name FROM treatments WHERE plant_id IS NOT NULL), h AS (SELECT plant_id, count(*) AS n FROM observations GROUP BY 1),
x AS (SELECT u.*, row_number() OVER (ORDER BY created_at NULLS FIRST, u.plant_id, file_name NULLS FIRST) AS k, row_number() OVER (PARTITION BY u.plant_id ORDER BY created_at NULLS FIRST, file_name NULLS FIRST) + coalesce(h.n, 0) AS nth FROM u LEFT JOIN h USING (plant_id))
SELECT (SELECT max(id) FROM observations) + k AS id, (SELECT max(id) FROM images) + k AS image_id, plant_id, printf('data/plants/PG-%06d/observation_%03d.jpg', plant_id, nth) AS file_path FROM x""")
def append_uploads(spark, folder):
    """The observations and images that treatments, taken as uploads, append."""
    o, i = table(spark, folder, "observations"), table(spark, folder, "images")
    new = table(spark, folder, "treatments").filter("plant_id IS NOT NULL").select("plant_id", F.col("applied_date").alias("created_at"), F.col("treatment_name").alias("file_name"))
    more, pictures = changes.append_observations(o, i, new)
    top = lambda df: df.agg(F.max("id")).scalar()
    x = more.filter(F.col("id") > top(o)).select("id", "image_id", "plant_id")
    return x.join(pictures.filter(F.col("id") > top(i)).select(F.col("id").alias("im"), "file_path"), F.col("image_id") == F.col("im")).select("id", "image_id", "plant_id", "file_path")


@query("""SELECT i.id, CASE WHEN p.plant_id IS NOT NULL THEN p.plant_id || '/' || printf('observation_%03d', i.id) ELSE left(md5(i.id::VARCHAR), 8) END || '.jpg' AS file FROM images i LEFT JOIN plants p ON p.id = i.plant_id""")
def stored_files(spark, folder):
    """Where each image would be stored: by plant and number, or by eight digits, here of a hash instead of a random number."""
    x = table(spark, folder, "images").select("id", F.col("plant_id").alias("fk"))
    x = x.join(table(spark, folder, "plants").select(F.col("id").alias("pk"), "plant_id"), F.col("fk") == F.col("pk"), "left")
    return x.select("id", changes.stored_path("plant_id", "id", F.md5(F.col("id").cast("string"))).alias("file"))


@query("""SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, md5(array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|')) AS entries,
  'decode:' || left(coalesce(nullif(text, ''), 'unknown'), 200) AS error FROM documents""")
def text_forms(spark, folder):
    """Texts escaped for HTML, as lists of their parts between commas, and as keys of errors."""
    t = table(spark, folder, "documents").select("doc_id", "text")
    return t.select("doc_id", F.md5(text.html_escape("text")).alias("escaped"), F.md5(F.array_join(paths.comma_list("text"), "|")).alias("entries"), text.error_key("decode", F.nullif("text", F.lit(""))).alias("error"))


@query("""SELECT id, strftime(applied_date, '%Y%m%d_%H%M%S') AS stamp, strftime(applied_date, '%b %-d %H:%M') AS label FROM treatments""")
def time_forms(spark, folder):
    return table(spark, folder, "treatments").select("id", text.stamp("applied_date").alias("stamp"), text.short_label("applied_date").alias("label"))


@query("SELECT record_id, 'data:image/png;base64,' || base64(ahash) AS uri FROM split_csv")
def data_uris(spark, folder):
    return table(spark, folder, "split_csv").select("record_id", text.data_uri("ahash").alias("uri"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), g AS (SELECT vec_id, list_concat(list_concat(e, list_transform(e, lambda x: x * 2)), list_concat(list_transform(e, lambda x: -x), list_transform(e, lambda x: x - 0.01))) AS g FROM v),
m AS (SELECT vec_id, g, list_sum(g) / 256 AS m FROM g), b AS (SELECT vec_id, list_transform(g, lambda x: CASE WHEN x >= m THEN 1 ELSE 0 END) AS b FROM m)
SELECT vec_id, array_to_string(list_transform(range(64), lambda i: printf('%X', 8 * b[4 * i + 1] + 4 * b[4 * i + 2] + 2 * b[4 * i + 3] + b[4 * i + 4])), '') AS ahash FROM b""")
def grid_hashes(spark, folder):
    """Average hashes of 256 values made of each embedding."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    g = F.concat(e, F.transform(e, lambda x: x * 2), F.transform(e, lambda x: -x), F.transform(e, lambda x: x - 0.01))
    return table(spark, folder, "embeddings").select("vec_id", F.hex(neardup.grid_hash(g)).alias("ahash"))


@query("SELECT vec_id, round(len(list_filter(embedding, lambda x: x::DOUBLE > 0.1)) / 64::DOUBLE, 4) AS share FROM embeddings")
def attention(spark, folder):
    """The share of the values above a limit."""
    return table(spark, folder, "embeddings").select("vec_id", scoring.attention_share(F.transform("embedding", lambda x: x.cast("double")), 0.1).alias("share"))


@query("""SELECT event_type AS phase, ts::DATE::VARCHAR AS epoch, round(sum(value * (1 + event_id % 7)) / sum(1 + event_id % 7), 6) AS loss, round(count(*) FILTER (value > 50) / sum(1 + event_id % 7)::DOUBLE, 6) AS accuracy, round(sum(1 + event_id % 7) / sum(value), 6) AS rows_per_second FROM events GROUP BY 1, 2""")
def epoch_means(spark, folder):
    """Losses and shares weighted by rows; events stand for batches, their days for epochs and their values for losses and seconds."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("phase"), F.col("ts").cast("date").cast("string").alias("epoch"), "value", (1 + F.col("event_id") % 7).alias("n"), (F.col("value") > 50).cast("int").alias("correct"))
    m = metrics.epochs(e, ["phase", "epoch"], "value", "correct", "n", "value")
    return m.select("phase", "epoch", *(F.round(c, 6).alias(c) for c in ("loss", "accuracy", "rows_per_second")))


_DAYS = "d AS (SELECT event_type AS phase, ts::DATE AS day, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), e AS (SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY day) AS epoch, score FROM d)"


def _days(spark, folder):
    d = table(spark, folder, "events").groupBy(F.col("event_type").alias("phase"), F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("score"))
    return d.select("phase", F.row_number().over(W.partitionBy("phase").orderBy("day")).alias("epoch"), "score")


@query(f"""WITH {_DAYS}, b AS (SELECT *, coalesce(max(score) OVER (PARTITION BY phase ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM e),
i AS (SELECT *, score > best_before AS improved FROM b), g AS (SELECT *, (SELECT count(*) FROM i j WHERE j.phase = i.phase AND j.epoch < i.epoch AND j.epoch > coalesce((SELECT max(k.epoch) FROM i k WHERE k.phase = i.phase AND k.epoch < i.epoch AND k.improved), 0)) AS gone FROM i)
SELECT phase, epoch, score, best_before, improved, (SELECT bool_or(h.gone >= 2) FROM g h WHERE h.phase = g.phase AND h.epoch <= g.epoch) AS stopped FROM g""")
def early_stopping(spark, folder):
    """Whether training would have stopped, with the mean of each day as the score of an epoch."""
    return metrics.patience(_days(spark, folder), "phase", "epoch", "score")


@query(f"WITH {_DAYS} SELECT coalesce(max(score), 0) AS best FROM e")
def best_epoch(spark, folder):
    return metrics.best_of(_days(spark, folder), "score")


@query(f"WITH {_REPORT} SELECT label, printf('%-12s %9.2f %9.2f %9.2f %9d', label::VARCHAR, precision, recall, f1, support) AS line FROM m")
def classification_text(spark, folder):
    return metrics.text_report(metrics.per_class(scores(spark, folder), "y", "pred"))


@query(f"WITH {FILES} SELECT count(DISTINCT coalesce(dataset, '~')) AS datasets, count(*) FILTER (ok) AS total_valid, count(*) FILTER (NOT ok) AS total_corrupt FROM f")
def report_summary(spark, folder):
    """The totals of the nested report of all datasets."""
    return profile.summary(profile.report(files(spark, folder), "dataset", "label", "suffix", "ok", "md5", "size_bytes", "width", "height"))


@query(f"""WITH {_SCORES}, g AS (SELECT vec_id, ({_NAMES})[pred + 1] AS cls, conf, conf >= 0.55 AS ok FROM s), u AS (SELECT vec_id, unnest(p) AS prob, unnest(range(10)) AS idx FROM s),
t AS (SELECT vec_id, string_agg(({_NAMES})[idx + 1] || '=' || printf('%.4f', prob), ';' ORDER BY prob DESC, idx) AS matches FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, idx) AS r FROM u) WHERE r <= 3 GROUP BY 1)
SELECT g.vec_id, g.ok AS accepted, g.cls AS disease, t.matches, g.ok AS met, CASE WHEN contains(g.cls, 'healthy') THEN 0 ELSE 1 END AS n_recommendations, CASE WHEN NOT contains(g.cls, 'healthy') THEN coalesce(k.common_name, replace(replace(g.cls, '___', ' - '), '_', ' ')) END AS advice,
  g.ok AND k.class IS NOT NULL AS has_plan FROM g JOIN t USING (vec_id) LEFT JOIN kb k ON k.class = g.cls""")
def prediction_payload(spark, folder):
    """Parts of the nested prediction document of every row of scores, its map of probabilities as text."""
    kb = table(spark, folder, "kb")
    empty = F.array().cast("array<string>")
    plans = kb.select("class", *(empty.alias(c) for c in ("actions", "products", "nutrition", "prevention")))
    p = scoring.payload(scores(spark, folder), "vec_id", "logits", CLASSES, kb, plans)
    said = F.array_join(F.transform("matches", lambda m: F.concat(m["class"], F.lit("="), F.format_string("%.4f", m["confidence"]))), ";")
    return p.select("vec_id", "accepted", "diagnosis.disease", said.alias("matches"), F.col("confidence_threshold.met").alias("met"), F.size("treatment_recommendations").alias("n_recommendations"), F.get("treatment_recommendations", F.lit(0))["disease"].alias("advice"), F.col("care_plan").isNotNull().alias("has_plan"))


@query(f"""WITH {_SCORES}, u AS (SELECT vec_id, unnest(p) AS prob, unnest(range(10)) AS idx FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, idx) AS r FROM u) SELECT vec_id, ({_NAMES})[idx + 1] AS cls, round(prob, 6) AS probability FROM r WHERE r <= 3""")
def probability_map(spark, folder):
    """The entries of the map of probabilities of every prediction."""
    p = scoring.predictions(scores(spark, folder), "vec_id", "logits", CLASSES)
    return p.select("vec_id", F.explode("probabilities").alias("cls", "probability")).withColumn("probability", F.round("probability", 6))
