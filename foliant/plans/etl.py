"""Queries of the file-collection profile, deduplication, clustering and split, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import paths
from foliant.functions.keys import md5_key, name_key, split_key
from foliant.operators import manifest, neardup, profile, split
from foliant.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
SPLIT = "CASE lower(trim(split)) WHEN 'validation' THEN 'val' WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'test' THEN 'test' END"
#: split_csv with canonical names; a record without a checksum could not be read.
FILES = f"""f AS (SELECT record_id, {KEY.format("dataset")} AS dataset, {KEY.format("label")} AS label, path, nullif(lower(md5), '') AS md5, size_bytes, ahash, width, height,
  cluster, {SPLIT} AS split, nullif(lower(md5), '') IS NOT NULL AS ok, lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) AS suffix FROM split_csv)"""


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, folder: str) -> DataFrame:
    m = md5_key("md5")
    return table(spark, folder, "split_csv").select(
        "record_id", name_key("dataset").alias("dataset"), name_key("label").alias("label"), "path", m.alias("md5"), "size_bytes", "ahash", "width", "height", "cluster",
        split_key("split").alias("split"), m.isNotNull().alias("ok"), paths.suffix("path").alias("suffix"),
    )


@query(f"""WITH {FILES}, r AS (SELECT record_id, substr(path, length('raw/') + 1) AS rel, suffix FROM f),
p AS (SELECT record_id, rel, suffix, list_filter(string_split(rel, '/'), lambda x: x <> '') AS ps FROM r)
SELECT record_id, rel, suffix, suffix IN ('.jpg', '.jpeg', '.png', '.webp') AS is_image,
  coalesce(list_filter(ps, lambda x: lower(x) NOT IN ('train', 'test', 'color', 'grayscale', 'segmented'))[1], ps[1]) AS label_profile,
  coalesce(list_filter(ps, lambda x: lower(x) NOT IN ('train', 'test', 'val', 'validation'))[1], 'unknown') AS label_inspect,
  coalesce(list_filter(ps[2:], lambda x: x NOT IN ('train', 'test', 'color', 'grayscale', 'segmented'))[1], 'unknown') AS label_manifest,
  CASE lower(list_filter(ps, lambda x: lower(x) IN ('train', 'test', 'val', 'validation'))[1]) WHEN 'validation' THEN 'val' ELSE lower(list_filter(ps, lambda x: lower(x) IN ('train', 'test', 'val', 'validation'))[1]) END AS path_split,
  array_to_string(ps[-2:], '/') AS tail FROM p""")
def path_labels(spark, folder):
    """The three label extractors, the split and the parts of every path (STR-01..05, STR-16, STR-21)."""
    f = files(spark, folder).withColumn("rel", paths.relative("path", F.lit("raw")))
    inner = F.array_join(F.slice(paths.parts("rel"), 2, F.size(paths.parts("rel"))), "/")
    return f.select("record_id", "rel", "suffix", paths.is_image("path").alias("is_image"), paths.label_profile("rel").alias("label_profile"), paths.label_inspect("rel").alias("label_inspect"),
                    paths.label_manifest(inner).alias("label_manifest"), paths.infer_split("rel").alias("path_split"), paths.tail("rel").alias("tail"))


@query(f"WITH {FILES} SELECT dataset, label, count(*) AS n FROM f GROUP BY ALL")
def class_counts(spark, folder):
    return profile.class_counts(files(spark, folder), ["dataset", "label"])


@query(f"""WITH {FILES}, c AS (SELECT dataset, label, count(*) AS c FROM f WHERE ok GROUP BY ALL)
SELECT dataset, count(*) AS classes, sum(c)::BIGINT AS n, min(c) AS min_n, max(c) AS max_n, round(avg(c), 1) AS mean_n, round(max(c) / greatest(min(c), 1)::DOUBLE, 2) AS imbalance FROM c GROUP BY 1""")
def class_distribution(spark, folder):
    return profile.imbalance(files(spark, folder).filter("ok"), "dataset", "label")


@query(f"""WITH {FILES} SELECT dataset, count(*) AS n_files, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_corrupt, 0::BIGINT AS n_unsupported FROM f GROUP BY 1""")
def integrity(spark, folder):
    return profile.integrity(files(spark, folder), "dataset", "ok")


@query(f"""WITH {FILES} SELECT dataset, field, value, count(*) AS n FROM (SELECT dataset, 'suffix' AS field, suffix AS value FROM f UNION ALL SELECT dataset, 'split', split FROM f) GROUP BY ALL""")
def format_counts(spark, folder):
    return profile.value_counts(files(spark, folder), ["suffix", "split"], "dataset")


@query(f"""WITH {FILES} SELECT md5, count(*) AS n_files, (sum(size_bytes) - min(size_bytes))::BIGINT AS wasted_size, count(*) - 1 AS extra_files FROM f WHERE md5 IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_groups(spark, folder):
    return profile.duplicate_groups(files(spark, folder), "md5", "size_bytes")


@query(f"""WITH {FILES}, c AS (SELECT dataset, ahash, count(*) AS c FROM f GROUP BY ALL) SELECT dataset, sum(CASE WHEN ahash IS NULL THEN 0 ELSE c - 1 END)::BIGINT AS near_duplicates FROM c GROUP BY 1""")
def near_dup_estimate(spark, folder):
    return profile.near_estimate(files(spark, folder), "ahash", "dataset")


@query(f"""WITH {FILES} SELECT dataset, count(size_bytes) AS n_sized, round(sum(size_bytes) / 1048576.0::DOUBLE, 1) AS total_mb, round(sum(size_bytes) / 1e9::DOUBLE, 3) AS total_gb, round(avg(size_bytes) / 1024, 1) AS mean_kb,
  min(size_bytes) AS min_size, median(size_bytes) AS median_size, max(size_bytes) AS max_size, min(width) AS min_width, min(height) AS min_height, max(width) AS max_width, max(height) AS max_height,
  median(width) AS median_width, median(height) AS median_height, count(*) FILTER (width < 64 OR height < 64) AS n_tiny FROM f GROUP BY 1""")
def size_profile(spark, folder):
    return profile.size_profile(files(spark, folder), "dataset", "size_bytes", "width", "height")


@query(f"""WITH {FILES}, g AS (SELECT dataset, CASE WHEN ok THEN md5 END AS k, count(*) AS c, count(*) FILTER (ok) AS g, sum(size_bytes) AS s, min(size_bytes) AS m FROM f GROUP BY ALL)
SELECT dataset, grouping(dataset) = 1 AS is_total, sum(c)::BIGINT AS n_files, sum(g)::BIGINT AS n_ok, sum(c - g)::BIGINT AS n_corrupt, count(*) FILTER (k IS NOT NULL AND c > 1) AS dup_groups,
  sum(CASE WHEN k IS NOT NULL AND c > 1 THEN c - 1 ELSE 0 END)::BIGINT AS dup_files, sum(CASE WHEN k IS NOT NULL AND c > 1 THEN s - m ELSE 0 END)::BIGINT AS wasted_bytes FROM g GROUP BY ROLLUP (dataset)""")
def report_totals(spark, folder):
    return profile.totals(files(spark, folder), "dataset", "ok", "md5", "size_bytes")


@query(f"""WITH {FILES} SELECT dataset, record_id, path, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY path, record_id) AS rank FROM f WHERE NOT ok) WHERE rank <= 10""")
def corrupt_examples(spark, folder):
    return profile.first_examples(files(spark, folder).filter("NOT ok").select("dataset", "record_id", "path"), "dataset", ["path", "record_id"])


@query(f"""WITH {FILES}, l AS (SELECT DISTINCT dataset, label FROM f WHERE label IS NOT NULL), c AS (SELECT dataset, count(*) AS classes, count(*) FILTER (contains(lower(label), 'healthy')) AS healthy_classes FROM l GROUP BY 1)
SELECT dataset, classes, healthy_classes, dataset IN ('leafbank', 'fieldwalk') AS plant_identification, healthy_classes > 0 AND classes > healthy_classes AS health_classification,
  classes > healthy_classes AS disease_classification, dataset IN ('nutriplots') AS deficiency_classification, false AS severity_estimation FROM c""")
def tasks_supported(spark, folder):
    return profile.tasks_supported(files(spark, folder), "dataset", "label", ("leafbank", "fieldwalk"), ("nutriplots",))


_DEDUP = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY label NULLS LAST, path, record_id) AS rn FROM f WHERE ok) WHERE rn = 1)"


def _deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.keep_first(files(spark, folder).filter("ok"), "md5", ["label", "path", "record_id"])


@query(f"WITH {FILES}, {_DEDUP} SELECT record_id, dataset, label, path, md5, size_bytes FROM d")
def dedup_manifest(spark, folder):
    """One file for each checksum, the first by label and path, whatever the label of its copies."""
    return _deduplicated(spark, folder).select("record_id", "dataset", "label", "path", "md5", "size_bytes")


@query(f"""WITH {FILES}, {_DEDUP} SELECT record_id, path, 'corrupt' AS reason FROM f WHERE NOT ok UNION ALL SELECT record_id, path, 'duplicate' FROM f WHERE ok AND record_id NOT IN (SELECT record_id FROM d)""")
def quarantine(spark, folder):
    return manifest.quarantine(files(spark, folder), "record_id", "path", "ok", "md5", ["label", "path", "record_id"])


@query(f"""WITH {FILES}, m AS (SELECT dataset, cluster, min((path, record_id)) AS o FROM f GROUP BY ALL), n AS (SELECT dataset, cluster, row_number() OVER (ORDER BY o) - 1 AS cluster_no FROM m)
SELECT record_id, cluster_no FROM f JOIN n ON f.dataset IS NOT DISTINCT FROM n.dataset AND f.cluster IS NOT DISTINCT FROM n.cluster""")
def dense_cluster_ids(spark, folder):
    """Cluster numbers over all datasets, in the order in which clusters first appear by path."""
    f = files(spark, folder).select("record_id", "path", F.struct("dataset", "cluster").alias("g"))
    return manifest.dense_ids(f, "g", ["path", "record_id"], "cluster_no").select("record_id", "cluster_no")


@query(f"WITH {FILES} SELECT record_id, row_number() OVER (ORDER BY label NULLS FIRST, path, record_id) - 1 AS cluster FROM f")
def trivial_cluster_ids(spark, folder):
    return manifest.row_ids(files(spark, folder).select("record_id", "label", "path"), ["label", "path", "record_id"]).select("record_id", "cluster")


@query(f"WITH {FILES} SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM f WHERE label IS NOT NULL AND split = 'train')")
def label_index(spark, folder):
    return manifest.label_index(files(spark, folder).filter("split = 'train'"), "label")


_CLUSTERS = """c AS (SELECT dataset, cluster, min(label) AS label, count(*) AS size FROM f WHERE cluster IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY label) AS n FROM c WINDOW w AS (PARTITION BY label ORDER BY size, md5('42|' || coalesce(dataset, '') || '|' || cluster))),
s AS (SELECT dataset, cluster, label, size, CASE WHEN rank <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN rank <= round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM o)"""


def _cluster_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.assign(split.cluster_rollup(files(spark, folder).filter("cluster IS NOT NULL"), ["dataset", "cluster"], "label"), ["dataset", "cluster"])


@query(f"WITH {FILES}, {_CLUSTERS} SELECT dataset, cluster, label, size, split FROM s")
def stratified_split(spark, folder):
    """Every cluster's split at 70/15/15 of the clusters of its label."""
    return _cluster_split(spark, folder)


@query(f"""WITH {FILES}, {_CLUSTERS} SELECT f.label, count(*) FILTER (s.split = 'train') AS train, count(*) FILTER (s.split = 'val') AS val, count(*) FILTER (s.split = 'test') AS test
FROM f JOIN s ON f.dataset IS NOT DISTINCT FROM s.dataset AND f.cluster = s.cluster GROUP BY 1""")
def split_counts(spark, folder):
    s = _cluster_split(spark, folder).select(F.col("dataset").alias("d"), F.col("cluster").alias("c"), F.col("split").alias("new_split"))
    f = files(spark, folder).select("dataset", "cluster", "label")
    return split.split_counts(f.join(s, F.col("dataset").eqNullSafe(F.col("d")) & (F.col("cluster") == F.col("c"))), "label", "new_split")


@query(f"""WITH {FILES} SELECT record_id, label FROM (SELECT record_id, label, row_number() OVER (PARTITION BY label ORDER BY path, record_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM f WHERE split = 'train')
WHERE rank <= greatest(1, round_even(n * 0.25::DOUBLE, 0))""")
def train_subset(spark, folder):
    """The first quarter of every label's training rows by path, at least one."""
    f = files(spark, folder).filter("split = 'train'").select("record_id", "label", "path")
    return manifest.fraction_per_label(f, "label", ["path", "record_id"], 0.25).select("record_id", "label")


@query(f"WITH {FILES} SELECT record_id, path FROM f ORDER BY md5('2026|' || record_id) LIMIT 200")
def uniform_sample(spark, folder):
    """200 rows, uniformly at random and the same on every run."""
    return manifest.hash_sample(files(spark, folder).select("record_id", "path"), "record_id", 200, 2026)


@query(f"""WITH {FILES}, c AS (SELECT label, count(*) AS n FROM f WHERE label IS NOT NULL AND split = 'train' GROUP BY 1)
SELECT label, n, round((1.0::DOUBLE / n) * (SELECT count(*) FROM c) / (SELECT sum(1.0::DOUBLE / n) FROM c), 8) AS weight_inverse, round((1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM c), 8) AS weight_balanced FROM c""")
def class_weights(spark, folder):
    w = split.class_weights(files(spark, folder).filter("split = 'train'"), "label")
    return w.select("label", "n", F.round("weight_inverse", 8).alias("weight_inverse"), F.round("weight_balanced", 8).alias("weight_balanced"))


@query(f"""WITH {FILES}, l AS (SELECT DISTINCT label FROM f WHERE label IS NOT NULL), c AS (SELECT label, count(*) AS n FROM f WHERE split = 'test' GROUP BY 1),
x AS (SELECT label, greatest(coalesce(n, 0), 1) AS n FROM l LEFT JOIN c USING (label)) SELECT label, n, round((SELECT count(*) FROM x) / n::DOUBLE / (SELECT sum(1.0::DOUBLE / n) FROM x), 8) AS weight FROM x""")
def label_weights(spark, folder):
    """Weights by the test rows of all labels, also of those that the test split lacks."""
    f = files(spark, folder)
    names = f.filter("label IS NOT NULL").select("label").distinct()
    return split.label_weights(f.filter("split = 'test'"), names, "label").withColumn("weight", F.round("weight", 8))


_NEAR = """g AS (SELECT record_id, label, ahash, size_bytes FROM f WHERE octet_length(ahash) = 32 AND size_bytes IS NOT NULL),
e AS (SELECT x.record_id AS a, y.record_id AS b FROM g x JOIN g y ON x.label IS NOT DISTINCT FROM y.label AND substr(hex(x.ahash), 1, 62) = substr(hex(y.ahash), 1, 62)
  WHERE x.record_id <> y.record_id AND abs(x.size_bytes - y.size_bytes) <= 5120 AND bit_count(xor(x.ahash::BIT, y.ahash::BIT)) <= 4)"""


@query(f"""WITH RECURSIVE {FILES}, {_NEAR}, c(node, r) AS (SELECT record_id, record_id FROM f UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.node WHERE e.b > c.r)
SELECT node AS record_id, min(r) AS root FROM c GROUP BY 1""")
def neardup_clusters(spark, folder):
    """Every record's cluster of nearly identical pictures of one label: upper 248 bits equal, at most 4 of the last 8 differing, sizes within 5,120 bytes."""
    return neardup.clusters(files(spark, folder).select("record_id", "label", "ahash", "size_bytes"), "record_id", "label", "ahash", "size_bytes")


@query(f"""WITH RECURSIVE {FILES}, {_NEAR}, c(node, r) AS (SELECT record_id, record_id FROM f UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.node WHERE e.b > c.r),
m AS (SELECT node AS record_id, min(r) AS root FROM c GROUP BY 1) SELECT n AS size, count(*) AS n_clusters FROM (SELECT root, count(*) AS n FROM m GROUP BY 1) GROUP BY 1""")
def neardup_sizes(spark, folder):
    return neardup_clusters(spark, folder).groupBy("root").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


_VECTOR = """b AS (SELECT id, label, list_transform(v, lambda x: CASE WHEN x >= list_sum(v) / 64 THEN '1' ELSE '0' END) AS bs FROM h),
k AS (SELECT label, array_to_string(bs, '')::BIT AS bits, min(id) AS id FROM b GROUP BY ALL)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.bits, y.bits))::INT AS bits FROM k x JOIN k y ON x.label = y.label AND x.id < y.id WHERE bit_count(xor(x.bits, y.bits)) <= {}"""


@query(f"""WITH h AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), {_VECTOR.format(7)}""")
def vector_neardups(spark, folder):
    """Pairs of embeddings of one label whose 64-bit average hashes differ in at most 7 bits, a radius that eight parts of eight bits can index."""
    return neardup.vector_pairs(table(spark, folder, "embeddings"), "vec_id", "label", "embedding", 7)


@query(f"""WITH {FILES}, h AS (SELECT record_id AS id, label, list_transform(string_split(hex(ahash), ''), lambda x: bit_count(('0x' || x)::INT)::DOUBLE) AS v FROM f WHERE octet_length(ahash) = 32 AND label IS NOT NULL), {_VECTOR.format(3)}""")
def cell_neardups(spark, folder):
    """Pairs of pictures of one label, reduced to 64 cells of four pixels, whose average hashes differ in at most 3 bits."""
    f = files(spark, folder).filter(F.octet_length("ahash") == 32).select("record_id", "label", neardup.cell_code("ahash").alias("code"))
    return neardup.code_pairs(f, "record_id", "label", "code", 3)


@query(f"""WITH {FILES}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('2026|' || record_id), record_id) AS rn FROM f) WHERE rn <= 200),
c AS (SELECT dataset, ahash, count(*) AS c FROM s GROUP BY ALL) SELECT dataset, sum(CASE WHEN ahash IS NULL THEN 0 ELSE c - 1 END)::BIGINT AS near_duplicates FROM c GROUP BY 1""")
def near_dup_sampled(spark, folder):
    """The estimate on 200 sampled files of each dataset."""
    f = files(spark, folder).select("dataset", "record_id", "ahash")
    return profile.near_estimate(manifest.hash_sample_per(f, "dataset", "record_id", 200, 2026), "ahash", "dataset")


@query(f"""WITH {FILES}, cs AS (SELECT dataset, string_agg(k || '=' || n, ';' ORDER BY k) AS classes FROM (SELECT dataset, coalesce(label, 'unknown') AS k, count(*) AS n FROM f WHERE ok GROUP BY ALL) GROUP BY 1),
fs AS (SELECT dataset, string_agg(k || '=' || n, ';' ORDER BY k) AS formats FROM (SELECT dataset, coalesce(suffix, 'unknown') AS k, count(*) AS n FROM f GROUP BY ALL) GROUP BY 1),
s AS (SELECT dataset, count(*) AS n_files, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_corrupt, round(sum(size_bytes) / 1048576.0::DOUBLE, 1) AS total_mb, round(avg(size_bytes) / 1024, 1) AS mean_kb, min(size_bytes) AS min_size,
  median(size_bytes) AS median_size, max(size_bytes) AS max_size, min(width) || 'x' || min(height) AS smallest, (median(width)::DOUBLE)::VARCHAR || 'x' || (median(height)::DOUBLE)::VARCHAR AS middle, max(width) || 'x' || max(height) AS largest FROM f GROUP BY 1),
g AS (SELECT dataset, CASE WHEN ok THEN md5 END AS k, count(*) AS c, sum(size_bytes) AS z, min(size_bytes) AS m FROM f GROUP BY ALL),
d AS (SELECT dataset, count(*) AS dup_groups, sum(c - 1)::BIGINT AS dup_files, sum(z - m)::BIGINT AS wasted_bytes FROM g WHERE k IS NOT NULL AND c > 1 GROUP BY 1)
SELECT s.*, classes, formats, coalesce(dup_groups, 0) AS dup_groups, coalesce(dup_files, 0) AS dup_files, coalesce(wasted_bytes, 0) AS wasted_bytes FROM s
LEFT JOIN cs ON cs.dataset IS NOT DISTINCT FROM s.dataset LEFT JOIN fs ON fs.dataset IS NOT DISTINCT FROM s.dataset LEFT JOIN d ON d.dataset IS NOT DISTINCT FROM s.dataset""")
def dataset_report(spark, folder):
    """Every part of the nested report of every dataset, the maps and pairs as text."""
    r = profile.report(files(spark, folder), "dataset", "label", "suffix", "ok", "md5", "size_bytes", "width", "height")
    entries = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    pair = lambda c: F.concat(F.get(c, F.lit(0)).cast("string"), F.lit("x"), F.get(c, F.lit(1)).cast("string"))
    return r.select(
        "dataset", F.col("files.n").alias("n_files"), F.col("files.valid").alias("n_valid"), F.col("files.corrupt").alias("n_corrupt"), "sizes.total_mb", "sizes.mean_kb", F.col("sizes.min").alias("min_size"),
        F.col("sizes.median").alias("median_size"), F.col("sizes.max").alias("max_size"), pair("dimensions.min").alias("smallest"), pair("dimensions.median").alias("middle"), pair("dimensions.max").alias("largest"),
        entries("classes").alias("classes"), entries("formats").alias("formats"), F.col("duplicates.groups").alias("dup_groups"), F.col("duplicates.files").alias("dup_files"), "duplicates.wasted_bytes",
    )
