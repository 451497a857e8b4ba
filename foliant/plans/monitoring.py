"""Queries on plants, images, observations and treatments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.keys import name_key
from foliant.functions.text import iso
from foliant.operators import changes, monitor, reference
from foliant.plans.etl import KEY, query
from foliant.plans.tables import table

_ISO = "(CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END)"


def _obs(spark, folder):
    return table(spark, folder, "observations")


@query(f"""SELECT p.id, p.plant_id, p.crop, p.species, p.common_name, {_ISO.format("p.date_created")} AS date_created, coalesce(o.n, 0) AS n_observations, o.s AS latest_status
FROM plants p LEFT JOIN (SELECT plant_id, count(*) AS n, arg_max(coalesce(health_status, '~'), id) AS s0, nullif(arg_max(coalesce(health_status, '~'), id), '~') AS s FROM observations WHERE plant_id IS NOT NULL GROUP BY 1) o ON o.plant_id = p.id""")
def plants_overview(spark, folder):
    p = table(spark, folder, "plants").select("id", "plant_id", "crop", "species", "common_name", "date_created")
    return monitor.overview(p, _obs(spark, folder), "id", "plant_id", "id", "health_status").orderBy(F.desc("date_created")).withColumn("date_created", iso("date_created"))


@query("SELECT p.plant_id, o.id AS observation_id, o.predicted_disease, o.health_status, o.confidence FROM plants p JOIN observations o ON o.plant_id = p.id")
def plant_observations(spark, folder):
    o = _obs(spark, folder).select(F.col("id").alias("observation_id"), F.col("plant_id").alias("fk"), "predicted_disease", "health_status", "confidence")
    return table(spark, folder, "plants").select("id", "plant_id").join(o, F.col("id") == F.col("fk")).drop("id", "fk")


@query(f"""SELECT o.id, o.plant_id, row_number() OVER (PARTITION BY o.plant_id ORDER BY o.created_at DESC NULLS LAST, o.id DESC) AS observation_number, {_ISO.format("o.created_at")} AS created_at, i.file_path AS image_path,
  i.file_name AS image_name, o.predicted_disease, o.health_status, o.confidence, o.severity, o.metadata.notes AS notes FROM observations o LEFT JOIN images i ON i.id = o.image_id""")
def observation_list(spark, folder):
    x = monitor.with_images(monitor.numbered(_obs(spark, folder), "plant_id", "created_at", "id"), table(spark, folder, "images"), "image_id")
    return x.select("id", "plant_id", F.col("number_newest").alias("observation_number"), iso("created_at").alias("created_at"), "image_path", "image_name", "predicted_disease", "health_status", "confidence", "severity", F.col("metadata.notes").alias("notes"))


@query("""SELECT id, plant_id, n AS insert_number, printf('observation_%03d.jpg', n) AS file_name FROM (SELECT id, plant_id, row_number() OVER (PARTITION BY plant_id ORDER BY id) AS n FROM observations)""")
def insert_numbers(spark, folder):
    """The number an observation had when it was entered, and the name of its file."""
    x = monitor.numbered(_obs(spark, folder).select("id", "plant_id"), "plant_id", "id", "id")
    return x.select("id", "plant_id", F.col("number_oldest").alias("insert_number"), F.format_string("observation_%03d.jpg", F.col("number_oldest")).alias("file_name"))


@query(f"""SELECT o.plant_id, o.id, row_number() OVER w AS position, round(percent_rank() OVER (PARTITION BY o.plant_id ORDER BY o.created_at NULLS FIRST, o.id), 9) AS at, {_ISO.format("o.created_at")} AS date, o.predicted_disease, o.health_status, o.confidence, i.file_path AS image_path
FROM observations o LEFT JOIN images i ON i.id = o.image_id WINDOW w AS (PARTITION BY o.plant_id ORDER BY o.created_at NULLS FIRST, o.id)""")
def timeline(spark, folder):
    return monitor.timeline(_obs(spark, folder), table(spark, folder, "images"), "plant_id", "created_at", "id").withColumn("at", F.round("at", 9))


@query("""SELECT p.id, coalesce(n, 0) AS n_observations, CASE WHEN n IS NULL THEN 'no_data' ELSE 'insufficient_data' END AS trend, NULL::DOUBLE AS improvement_percentage
FROM plants p LEFT JOIN (SELECT plant_id, count(*) AS n FROM observations WHERE plant_id IS NOT NULL GROUP BY 1) o ON o.plant_id = p.id""")
def timeline_summary(spark, folder):
    return monitor.timeline_summary(table(spark, folder, "plants"), _obs(spark, folder), "id", "plant_id")


@query("""WITH r AS (SELECT plant_id AS entity, arg_min(id, (created_at, id)) AS id_1, arg_max(id, (created_at, id)) AS id_2, count(*) AS n FROM observations WHERE plant_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT entity, id_1, id_2, a.predicted_disease AS predicted_disease_1, a.health_status AS health_status_1, a.confidence AS confidence_1, b.predicted_disease AS predicted_disease_2, b.health_status AS health_status_2, b.confidence AS confidence_2
FROM r JOIN observations a ON a.id = r.id_1 AND a.plant_id = r.entity JOIN observations b ON b.id = r.id_2 AND b.plant_id = r.entity""")
def compare_first_last(spark, folder):
    o = _obs(spark, folder)
    return monitor.compare(o, monitor.first_and_last(o, "plant_id", "created_at", "id"), "plant_id", "id", ["predicted_disease", "health_status", "confidence"])


@query("""WITH a AS (SELECT plant_id, count(*) AS n, count(*) FILTER (regexp_matches(health_status, '(?i)healthy')) AS n_healthy, avg(confidence) AS m, count(confidence) AS k, min(confidence) AS lo, max(confidence) AS hi,
  arg_min(confidence, (created_at, id)) FILTER (confidence IS NOT NULL) AS c0, arg_max(confidence, (created_at, id)) FILTER (confidence IS NOT NULL) AS c1 FROM observations GROUP BY 1)
SELECT plant_id, n, n_healthy, round(m, 6) AS mean_confidence, CASE WHEN k < 2 THEN NULL WHEN c1 >= c0 THEN 'up' ELSE 'down' END AS trend,
  CASE WHEN lo IS NOT NULL THEN round(greatest(CASE WHEN hi - lo < 0.2 THEN (hi + lo) / 2 - 0.1 ELSE lo END - 0.08, 0), 6) END AS axis_low,
  CASE WHEN lo IS NOT NULL THEN round(least(CASE WHEN hi - lo < 0.2 THEN (hi + lo) / 2 + 0.1 ELSE hi END + 0.08, 1), 6) END AS axis_high FROM a""")
def progress_summary(spark, folder):
    x = monitor.progress(_obs(spark, folder), "plant_id", "created_at", "id", "confidence", "health_status")
    return x.select("plant_id", "n", "n_healthy", F.round("mean_confidence", 6).alias("mean_confidence"), "trend", F.round("axis_low", 6).alias("axis_low"), F.round("axis_high", 6).alias("axis_high"))


@query("""SELECT o.id, e.key AS cls, round(e.value, 6) AS probability, rank::INT AS rank FROM (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY e.value DESC, e.key) AS rank
FROM (SELECT id, unnest(map_entries(disease_probabilities)) AS e FROM observations)) o""")
def probabilities_ranked(spark, folder):
    """The entries of every probability map, largest first."""
    x = _obs(spark, folder).select("id", F.posexplode(monitor.sorted_map("disease_probabilities")).alias("at", "e"))
    return x.select("id", F.col("e.key").alias("cls"), F.round("e.value", 6).alias("probability"), (F.col("at") + 1).alias("rank"))


@query(f"""SELECT t.id, p.plant_id, t.treatment_name, {_ISO.format("t.applied_date")} AS applied_date, row_number() OVER (PARTITION BY t.plant_id ORDER BY t.applied_date DESC NULLS LAST, t.id DESC) AS position
FROM treatments t JOIN plants p ON p.id = t.plant_id""")
def treatment_list(spark, folder):
    t = monitor.numbered(table(spark, folder, "treatments").filter("plant_id IS NOT NULL"), "plant_id", "applied_date", "id").select("id", F.col("plant_id").alias("fk"), "treatment_name", "applied_date", F.col("number_newest").alias("position"))
    p = table(spark, folder, "plants").select(F.col("id").alias("pk"), "plant_id")
    return t.join(p, F.col("fk") == F.col("pk")).select("id", "plant_id", "treatment_name", iso("applied_date").alias("applied_date"), "position")


@query("""SELECT t.plant_id, t.treatment_name AS treatment, t.applied_date AS treatment_date FROM treatments t JOIN (SELECT max(id) AS id FROM treatments WHERE plant_id IS NOT NULL GROUP BY plant_id) USING (id)""")
def latest_treatment(spark, folder):
    return monitor.latest_treatment(table(spark, folder, "treatments"), "plant_id", "id")


@query(f"""SELECT o.plant_id, o.predicted_disease AS disease, o.health_status, o.confidence, o.model_version, {_ISO.format("o.created_at")} AS date FROM observations o JOIN (SELECT min(id) AS id FROM observations WHERE plant_id IS NOT NULL GROUP BY plant_id) USING (id)""")
def first_diagnosis(spark, folder):
    return monitor.first_diagnosis(_obs(spark, folder), "plant_id", "id")


@query("""SELECT i.id, printf('PG-%06d', m + row_number() OVER (ORDER BY i.upload_date NULLS FIRST, i.id)) AS plant_id FROM images i, (SELECT max(regexp_extract(plant_id, '^PG-([0-9]+)$', 1)::BIGINT) AS m FROM plants) WHERE i.plant_id IS NULL""")
def next_plant_ids(spark, folder):
    """New plants for the images without one, numbered on from the largest plant."""
    new = table(spark, folder, "images").filter("plant_id IS NULL").select("id", "upload_date")
    return changes.next_ids(new.withColumn("plant_id", F.lit(None).cast("string")), table(spark, folder, "plants"), "plant_id", ["upload_date", "id"]).select("id", "plant_id")


@query(f"""WITH o AS (SELECT {KEY.format("model_version")} AS version, min(created_at) AS created_at FROM observations WHERE model_version IS NOT NULL GROUP BY 1), known AS (SELECT '0_1_0' AS version)
SELECT version FROM known UNION ALL SELECT version FROM o WHERE version NOT IN (SELECT version FROM known)""")
def insert_model_versions(spark, folder):
    known = spark.createDataFrame([("0_1_0",)], "version string")
    return changes.insert_if_absent(known, _obs(spark, folder).select(name_key("model_version").alias("version")), "version")


@query("""SELECT p.id, CASE WHEN t.plant_id IS NOT NULL THEN t.treatment_name ELSE p.treatment END AS treatment, CASE WHEN t.plant_id IS NOT NULL THEN NULL ELSE p.notes END AS notes
FROM plants p LEFT JOIN (SELECT t.plant_id, t.treatment_name FROM treatments t JOIN (SELECT max(id) AS id FROM treatments WHERE plant_id IS NOT NULL GROUP BY plant_id) USING (id)) t ON t.plant_id = p.id""")
def partial_update(spark, folder):
    """Plants with the treatment entered last, and their notes cleared where there is one: a supplied null overwrites."""
    t = latest_treatment(spark, folder).select(F.col("plant_id").alias("id"), "treatment", F.lit(True).alias("has_treatment"), F.lit(None).cast("string").alias("notes"), F.lit(True).alias("has_notes"))
    return changes.patch(table(spark, folder, "plants").select("id", "treatment", "notes"), t, "id", ["treatment", "notes"])


@query("""WITH d AS (SELECT id FROM plants WHERE user_id IS NULL) SELECT 'entities' AS name, count(*) AS n FROM plants WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'images', count(*) FROM images WHERE plant_id IS NULL OR plant_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'observations', count(*) FROM observations WHERE plant_id IS NULL OR plant_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'treatments', count(*) FROM treatments WHERE plant_id IS NULL OR plant_id NOT IN (SELECT id FROM d)""")
def cascade_delete(spark, folder):
    """What is left of the tables when the plants without a user are deleted with all that belongs to them."""
    plants = table(spark, folder, "plants")
    left = changes.delete_cascade(plants.filter("user_id IS NULL"), "id", plants, {n: (table(spark, folder, n), "plant_id") for n in ("images", "observations", "treatments")})
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


_UNKNOWN, _ADVICE = "A class without an entry.", "Ask a specialist."


@query(f"""WITH o AS (SELECT id, replace(replace(replace(trim(predicted_disease), ' - ', '___'), '---', '___'), '-', '_') AS cls FROM observations)
SELECT o.id, o.cls, CASE WHEN k.class IS NOT NULL THEN k.common_name ELSE replace(replace(o.cls, '___', ' - '), '_', ' ') END AS common_name,
  CASE WHEN k.class IS NOT NULL THEN k.description WHEN o.cls IS NOT NULL THEN '{_UNKNOWN}' END AS description, CASE WHEN k.class IS NOT NULL THEN k.treatment WHEN o.cls IS NOT NULL THEN '{_ADVICE}' END AS treatment,
  k.class IS NOT NULL AS known FROM o LEFT JOIN kb k ON k.class = o.cls""")
def kb_lookup(spark, folder):
    """The texts of every observation's class, with defaults for classes that kb does not have."""
    c = F.trim("predicted_disease")
    for a, b in ((" - ", "___"), ("---", "___"), ("-", "_")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return reference.lookup(_obs(spark, folder).select("id", c.alias("cls")), "cls", table(spark, folder, "kb"), _UNKNOWN, _ADVICE)


@query(r"""WITH b AS (SELECT class, CASE WHEN regexp_matches(class, '(mildew|rust|scab|mold)$') THEN 'fungus' WHEN regexp_matches(class, '(canker|rot)$') THEN 'decay' END AS base FROM kb)
SELECT class, CASE WHEN contains(class, 'healthy') THEN 'keep watching' WHEN base = 'fungus' THEN 'remove leaves;spray' WHEN base = 'decay' THEN 'cut back' ELSE 'confirm' END AS actions,
  CASE WHEN contains(class, 'healthy') THEN 'as before' WHEN base IS NOT NULL AND class LIKE 'Fig%' THEN 'feed in spring' WHEN base = 'fungus' THEN 'less nitrogen' WHEN base = 'decay' THEN 'more potash' ELSE 'by soil test' END AS nutrition FROM b""")
def care_plan(spark, folder):
    """The care plan of every class of kb, through its base, with a nuance for one crop; the plans are invented."""
    kb = table(spark, folder, "kb").select("class")
    base = F.when(F.rlike("class", F.lit("(mildew|rust|scab|mold)$")), "fungus").when(F.rlike("class", F.lit("(canker|rot)$")), "decay")
    plans = spark.createDataFrame([
        ("fungus", ["remove leaves", "spray"], ["copper"], ["less nitrogen"], ["space plants"]), ("decay", ["cut back"], [], ["more potash"], ["clean tools"]),
        ("generic", ["confirm"], [], ["by soil test"], ["rotate"]), ("healthy", ["keep watching"], [], ["as before"], ["look weekly"]),
    ], "base string, actions array<string>, products array<string>, nutrition array<string>, prevention array<string>")
    nuances = spark.createDataFrame([("Fig", ["feed in spring"])], "prefix string, nutrition array<string>")
    out = reference.care_plans(kb, "class", kb.withColumn("base", base).filter("base IS NOT NULL"), plans, nuances, "generic", "healthy")
    return out.select("class", F.array_join("actions", ";").alias("actions"), F.array_join("nutrition", ";").alias("nutrition"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, json_valid(props) AS valid FROM events")
def json_extract(spark, folder):
    return table(spark, folder, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))
