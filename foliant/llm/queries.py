"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.keys import hamming, md5_key, name_key, split_key
from foliant.llm import components, grouping, leakage, mixing, overlap, sampling, subjects
from foliant.llm.words import token_count
from foliant.plans.tables import table
from foliant.plans.workspace import store

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


# 1. Sample matching target category proportions


def _p1(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "split_csv").select(F.col("record_id").alias("row_id"), split_key("split").alias("stratum"), name_key("label").alias("category"))
    targets = table(spark, folder, "sample_targets").select(F.col("split").alias("stratum"), F.col("label").alias("category"), "target_bp", "min_rows")
    return sampling.draw(rows, targets)


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _p1(spark, folder)[0].select(F.col("row_id").alias("record_id"), F.col("stratum").alias("split"), F.col("category").alias("label"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with the rows and the share of its split's sample that it wants and that were drawn."""
    return _p1(spark, folder)[1].withColumn("wanted", F.round("wanted", 4)).withColumnsRenamed({"stratum": "split", "category": "label"})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of which the sample has too few rows although it took all there are."""
    return p1_report(spark, folder).filter("unmet").select("split", "label")


# 2. Consolidating pairwise matches into groups


def picture_links(pairs: DataFrame, records: DataFrame, max_bits: int = 4, max_size: int = 5_120) -> DataFrame:
    """a, b: the pairs that link two different records of split_csv.

    A null hamming or size_delta is computed from the two records; if one lacks the value, the pair links nothing.
    """
    p = pairs.filter("id_a <> id_b AND coalesce(hamming, 0) <= %d AND coalesce(abs(size_delta), 0) <= %d" % (max_bits, max_size))
    p = p.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), F.col("hamming").isNull().alias("h"), F.col("size_delta").isNull().alias("s")).distinct()
    r = records.select("record_id", "ahash", "size_bytes")
    end = lambda x: r.select(F.col("record_id").alias(x), F.col("ahash").alias(f"h{x}"), F.col("size_bytes").alias(f"s{x}"))
    p = p.join(end("a"), "a").join(end("b"), "b")
    near = (~F.col("h") | (hamming("ha", "hb") <= max_bits)) & (~F.col("s") | (F.abs(F.col("sa") - F.col("sb")) <= max_size))
    return p.filter(near).select("a", "b")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    links = picture_links(table(spark, folder, "match_pairs"), table(spark, folder, "split_csv"))
    return components.components(links).select(F.col("node").alias("record_id"), "group_id")


# 3. Same or near-same records across splits


def _p3_rows(spark: SparkSession, folder: str, *more) -> DataFrame:
    s = split_key("split")
    return table(spark, folder, "split_csv").select(
        F.col("record_id").alias("row_id"), F.when(s == "train", "train").when(s.isNotNull(), "eval").alias("side"), md5_key("md5").alias("md5"), "ahash", F.col("size_bytes").alias("size"), *more
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(_p3_rows(spark, folder))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every picture of val and test that train holds too, exactly or almost, with the class of its hash."""
    x = overlap.overlapping_rows(_p3_rows(spark, folder, split_key("split").alias("split"), name_key("dataset").alias("dataset")))
    return x.filter("same_md5 OR near").select(F.col("row_id").alias("record_id"), "split", "dataset", "class_id", "same_md5", "near")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each split and dataset of the evaluation pictures: n_rows, n_overlapping, n_same_md5, share."""
    x = overlap.overlapping_rows(_p3_rows(spark, folder, split_key("split").alias("split"), name_key("dataset").alias("dataset")))
    per = x.groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("same_md5") | F.col("near")).alias("n_overlapping"), F.count_if("same_md5").alias("n_same_md5"))
    return per.withColumn("share", F.round(F.col("n_overlapping") / F.col("n_rows"), 6))


# 5. Splits that keep related records together


def _p5(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records with their units, units with their new splits), both stored."""
    rows = table(spark, folder, "split_csv").select(
        F.col("record_id").alias("row_id"), name_key("dataset").alias("dataset"), F.col("cluster").cast("bigint").alias("cluster"), name_key("label").alias("stratum"), split_key("split").alias("present")
    )
    linked = store(grouping.linked_rows(rows, "row_id", [["dataset", "cluster"]]), "linked")
    units = grouping.balance(grouping.units_of(linked).withColumn("order_key", F.xxhash64(F.lit(42), "unit")), SHARES)
    return linked, units.withColumn("torn", grouping.torn(F.col("mask"), F.col("new_split")))


def p5_units(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each cluster (or record without one): its rows, its label, the split it is given, whether the present split tears it."""
    linked, units = _p5(spark, folder)
    names = linked.filter("row_id = unit").select("row_id", "dataset", "cluster")  # a unit is named after its smallest record
    x = units.join(names, F.col("unit") == F.col("row_id"))
    return x.select("dataset", "cluster", F.when(F.col("cluster").isNull(), F.col("unit")).alias("record_id"), F.col("stratum").alias("label"), F.col("weight").alias("n_rows"), "new_split", "torn")


def _p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, label, split of the records with their own labels."""
    linked, units = _p5(spark, folder)
    given = units.select(F.col("unit").alias("u"), F.col("new_split").alias("split"))
    return linked.join(given, F.col("unit") == F.col("u")).select(F.col("row_id").alias("record_id"), F.col("stratum").alias("label"), "split")


def p5_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, split of every record."""
    return _p5_rows(spark, folder).select("record_id", "split")


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and share of each split within each label, by the records' own labels and not by those of their clusters."""
    per = _p5_rows(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SHARES))
    return per.select("*", *(F.round(F.col(f"n_{s}") / F.col("n_rows"), 4).alias(f"share_{s}") for s in SHARES))


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the assignment, counted: records, those without a split, clusters, clusters in more than one new split,
    torn clusters, and labels of clusters whose splits miss 70/15/15 by more than a hundredth and the rows of their largest cluster."""
    linked, units = _p5(spark, folder)
    names = linked.filter("row_id = unit AND cluster IS NOT NULL").select("row_id")
    whole = units.join(names, F.col("unit") == F.col("row_id"))
    per = units.groupBy("stratum").agg(F.sum("weight").alias("n"), F.max("weight").alias("most"), *(F.sum(F.when(F.col("new_split") == s, F.col("weight")).otherwise(0)).alias(s) for s in SHARES))
    off = sum(((F.abs(F.col(s) - share * F.col("n")) > 0.01 * F.col("n") + F.col("most")).cast("int") for s, share in SHARES.items()), F.lit(0)) > 0
    given = linked.join(units.select(F.col("unit").alias("u"), "new_split"), F.col("unit") == F.col("u"), "left")
    split = given.filter("cluster IS NOT NULL").groupBy("dataset", "cluster").agg(F.max("new_split").alias("hi"), F.min("new_split").alias("lo"))
    one = lambda df, *aggs: df.agg(F.struct(*aggs)).scalar()
    a, b, c, d = (
        one(given, F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("new_split").isNull()).alias("n_without")), one(whole, F.count(F.lit(1)).alias("n_clusters"), F.count_if("torn").alias("n_torn")),
        one(split, F.count_if(F.col("hi") != F.col("lo")).alias("n_parted")), one(per, F.count_if(off).alias("n_labels_off")),
    )
    return spark.range(1).select(a["n_records"].alias("n_records"), a["n_without"].alias("n_without"), b["n_clusters"].alias("n_clusters"), b["n_torn"].alias("n_torn"), c["n_parted"].alias("n_parted"), d["n_labels_off"].alias("n_labels_off"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters whose rows cannot all stay where they are when every cluster gets its one split."""
    return p5_units(spark, folder).filter("torn AND cluster IS NOT NULL").select("dataset", "cluster")


# 6. Evaluation texts leaking into training text


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item or a passage of it, exactly or at a similarity of 0.8 or more."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).withColumn("similarity", F.round("similarity", 6))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that leaked: in how many documents exactly, in how many at all."""
    per = p6_leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("exact").alias("n_exact"), F.max("similarity").alias("similarity"))
    return table(spark, folder, "eval_items").select("item_id", "suite").join(per, "item_id").select("item_id", "suite", "n_documents", "n_exact", "similarity")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).filter("exact").select("doc_id", "item_id")


# 7. Mixing sources to target weights


def _p7(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", F.array(name_key("source")).alias("sources"), token_count("text").alias("tokens"))
    return mixing.mix(docs, table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents chosen and how often each is used."""
    return _p7(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Quota, tokens chosen and shares reached of every source: of the tokens chosen and of all, to which the targets refer."""
    return _p7(spark, folder)[1].withColumns({"share": F.round("share", 6), "share_of_all": F.round("share_of_all", 6)})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources whose quota the flow could not fill."""
    return p7_report(spark, folder).filter("is_short").select("source")


# 8. Subject area of each document


def _p8(spark: SparkSession, folder: str) -> tuple[DataFrame, subjects.Model]:
    labels = table(spark, folder, "subject_labels").select("doc_id", name_key("subject").alias("subject"))
    return subjects.subjects_of(table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "subjects"), labels)


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every document, the sentences about them and their share of its words."""
    return _p8(spark, folder)[0].withColumn("share", F.round("share", 6))


def p8_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The top terms of the fitted topics, for inspection."""
    return subjects.topic_terms(_p8(spark, folder)[1], spark)


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences of each subject by source."""
    found = _p8(spark, folder)[0]
    source = table(spark, folder, "documents").select("doc_id", name_key("source").alias("source"))
    return found.join(source, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the subjects, counted: documents, and rows of unknown documents or subjects, repeats, too few sentences or no share."""
    found = store(p8_subjects(spark, folder), "found")
    docs, names = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "subjects").select("subject")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        count(docs).alias("n_documents"), count(found.join(docs, "doc_id", "left_anti")).alias("n_unknown_documents"), count(found.join(names, "subject", "left_anti")).alias("n_unknown_subjects"),
        (count(found) - count(found.select("doc_id", "subject").distinct())).alias("n_repeats"), count(found.filter("n_sentences < 2 OR share <= 0 OR share > 1")).alias("n_too_few"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p8(spark, folder)[0].select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_sample, p1_report, p1_found, p2_found, p3_found, p3_records, p3_report, p5_units, p5_assignment, p5_shares, p5_checks, p5_found, p6_leaks, p6_items, p6_found, p7_mix, p7_report, p7_found, p8_subjects, p8_topics, p8_composition, p8_checks, p8_found)
}

_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
_SPLIT = "CASE lower(trim(split)) WHEN 'validation' THEN 'val' WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'test' THEN 'test' END"
_HAMMING = "bit_count(xor({0}.ahash::BIT, {1}.ahash::BIT))"

SQL: dict[str, str] = {
    "p1_found": f"""
WITH r AS (SELECT {_SPLIT} AS split, {_KEY.format("label")} AS label FROM split_csv),
     n AS (SELECT split, count(*) AS n_all FROM r WHERE split IS NOT NULL GROUP BY 1),
     a AS (SELECT split, label, count(*) AS n FROM r WHERE split IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)
SELECT t.split, t.label FROM sample_targets t LEFT JOIN a USING (split, label) LEFT JOIN n USING (split)
WHERE coalesce(a.n, 0) < t.min_rows OR coalesce(a.n, 0) * 50000 < t.target_bp * coalesce(n.n_all, 0)""",
    "p2_found": f"""
WITH RECURSIVE e AS (
  SELECT p.id_a AS a, p.id_b AS b FROM match_pairs p
  JOIN split_csv x ON x.record_id = p.id_a JOIN split_csv y ON y.record_id = p.id_b
  WHERE p.id_a <> p.id_b AND coalesce(p.hamming, {_HAMMING.format("x", "y")}) <= 4 AND abs(coalesce(p.size_delta, x.size_bytes - y.size_bytes)) <= 5120),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, r) AS (SELECT a, a FROM u UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.node WHERE u.b <> c.r)
SELECT node AS record_id, min(r) AS group_id FROM (SELECT node, r FROM c UNION ALL SELECT a, b FROM u) GROUP BY 1""",
    "p3_found": f"""
WITH r AS (SELECT record_id, nullif(lower(md5), '') AS md5, ahash, size_bytes, {_SPLIT} AS sp FROM split_csv),
g AS (SELECT * FROM r WHERE octet_length(ahash) = 32 AND size_bytes IS NOT NULL AND hex(ahash) NOT IN (repeat('0', 64), repeat('F', 64))),
p AS (SELECT t.record_id AS a, e.record_id AS b FROM r t JOIN r e ON t.md5 = e.md5 WHERE t.sp = 'train' AND e.sp IN ('val', 'test')
  UNION SELECT t.record_id, e.record_id FROM g t JOIN g e ON t.size_bytes BETWEEN e.size_bytes - 5120 AND e.size_bytes + 5120
  WHERE t.sp = 'train' AND e.sp IN ('val', 'test') AND {_HAMMING.format("t", "e")} <= 4)
SELECT DISTINCT least(a, b) AS id_lo, greatest(a, b) AS id_hi FROM p""",
    "p5_found": f"""
SELECT {_KEY.format("dataset")} AS dataset, cluster::BIGINT AS cluster FROM split_csv
WHERE cluster IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT {_SPLIT}) > 1""",
    "p5_checks": f"""
WITH r AS (SELECT {_KEY.format("dataset")} AS dataset, cluster, count(DISTINCT {_SPLIT}) AS n FROM split_csv WHERE cluster IS NOT NULL GROUP BY 1, 2)
SELECT (SELECT count(*) FROM split_csv) AS n_records, 0 AS n_without, count(*) AS n_clusters, count(*) FILTER (n > 1) AS n_torn, 0 AS n_parted, 0 AS n_labels_off FROM r""",
    "p8_checks": "SELECT count(*) AS n_documents, 0 AS n_unknown_documents, 0 AS n_unknown_subjects, 0 AS n_repeats, 0 AS n_too_few FROM documents",
    "p7_found": f"""
WITH d AS (SELECT {_KEY.format("source")} AS source, coalesce(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+')), 0) AS n FROM documents)
SELECT m.source FROM mix_targets m LEFT JOIN (SELECT source, sum(n) AS n FROM d GROUP BY 1) s USING (source)
WHERE m.max_repeats * coalesce(s.n, 0) * 10000 < m.target_bp * (SELECT sum(n) FROM d)""",
}
_P3 = f"""
WITH r AS (SELECT record_id, nullif(lower(md5), '') AS md5, ahash, size_bytes, {_SPLIT} AS split, {_KEY.format("dataset")} AS dataset FROM split_csv),
g AS (SELECT * FROM r WHERE octet_length(ahash) = 32 AND size_bytes IS NOT NULL AND hex(ahash) NOT IN (repeat('0', 64), repeat('F', 64)) AND split IS NOT NULL),
near AS (SELECT DISTINCT e.record_id FROM g t JOIN g e ON t.size_bytes BETWEEN e.size_bytes - 5120 AND e.size_bytes + 5120 WHERE t.split = 'train' AND e.split IN ('val', 'test') AND {_HAMMING.format("t", "e")} <= 4),
x AS (SELECT r.record_id, r.split, r.dataset, c.class_id, coalesce(r.md5 IN (SELECT md5 FROM r WHERE split = 'train' AND md5 IS NOT NULL), false) AS same_md5, n.record_id IS NOT NULL AS near
  FROM r LEFT JOIN near n USING (record_id) LEFT JOIN g ON g.record_id = r.record_id LEFT JOIN (SELECT ahash, min(record_id) AS class_id FROM g GROUP BY 1) c ON c.ahash = g.ahash WHERE r.split IN ('val', 'test'))"""
SQL["p3_records"] = f"{_P3} SELECT * FROM x WHERE same_md5 OR near"
SQL["p3_report"] = f"{_P3} SELECT split, dataset, count(*) AS n_rows, count(*) FILTER (same_md5 OR near) AS n_overlapping, count(*) FILTER (same_md5) AS n_same_md5, round(count(*) FILTER (same_md5 OR near) / count(*)::DOUBLE, 6) AS share FROM x GROUP BY 1, 2"

#: Full-width letters and digits and what they stand for, by rule.
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_PLAIN = f"translate(text, '{_WIDE}', '{''.join(chr(ord(c) - 0xFEE0) for c in _WIDE)}')"
for _c in [*map(chr, range(0xFB00, 0xFB07)), "ß"]:  # the Latin ligatures
    _PLAIN = f"replace({_PLAIN}, '{_c}', '{unicodedata.normalize('NFKD', _c).replace('ß', 'ss')}')"
_WORDS = f"regexp_extract_all(lower(strip_accents(regexp_replace({_PLAIN}, '[\\p{{M}}\\p{{Cf}}]', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')"
SQL["p6_found"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT item_id, ws, len(ws) AS n, least(12, len(ws)) AS k FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') AS w FROM (SELECT item_id, k, ws, unnest(range(1, n - k + 2)) AS j FROM p)),
dk AS (SELECT doc_id, ws, k FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k),
dw AS (SELECT DISTINCT doc_id, array_to_string(ws[j:j + k - 1], ' ') AS w FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS j FROM dk))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)"""
# all windows that share a shingle with a passage, and their exact weighted similarity
SQL["p6_leaks"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items WHERE text IS NOT NULL),
parts AS (SELECT item_id, 0 AS part, ws FROM i WHERE len(ws) > 0 UNION ALL SELECT item_id, j, ws[j:j + 11] FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS j FROM i WHERE len(ws) > 12)),
p AS (SELECT item_id, part, len(ws) AS size, least(5, len(ws)) AS n, ws FROM parts),
ps AS (SELECT item_id, part, size, n, ws[j:j + n - 1] AS sh, count(*) AS c FROM (SELECT *, unnest(range(1, size - n + 2)) AS j FROM p) GROUP BY ALL),
weighed AS (SELECT *, length(array_to_string(sh, '')) AS w FROM ps),
own AS (SELECT item_id, part, sum(c * w) AS total FROM weighed GROUP BY ALL),
ds AS (SELECT doc_id, n, j, ws[j:j + n - 1] AS sh FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM p))),
known AS (SELECT doc_id, n, j, sh FROM ds SEMI JOIN weighed USING (n, sh)),
starts AS (SELECT DISTINCT doc_id, size, n, s FROM (SELECT doc_id, size, n, unnest(range(greatest(1, j - (size - n)), least(j, len(ws) - size + 1) + 1)) AS s FROM known JOIN (SELECT DISTINCT size, n FROM p) USING (n) JOIN d USING (doc_id))),
ww AS (SELECT doc_id, size, n, s, sum(length(array_to_string(sh, ''))) AS total FROM starts JOIN ds USING (doc_id, n) WHERE j BETWEEN s AND s + size - n GROUP BY ALL),
wk AS (SELECT doc_id, size, n, s, sh, count(*) AS c FROM starts JOIN known USING (doc_id, n) WHERE j BETWEEN s AND s + size - n GROUP BY ALL),
met AS (SELECT doc_id, item_id, part, size, n, s, sum(least(wk.c, weighed.c) * w) AS shared FROM wk JOIN weighed USING (size, n, sh) GROUP BY ALL),
sim AS (SELECT met.doc_id, item_id, part, size, s, shared / (ww.total + own.total - shared)::DOUBLE AS similarity FROM met JOIN ww USING (doc_id, size, n, s) JOIN own USING (item_id, part))
SELECT doc_id, item_id, count(*) AS n_windows, round(max(similarity), 6) AS similarity, bool_or(d.ws[s:s + size - 1] = p.ws) AS exact
FROM sim JOIN p USING (item_id, part, size) JOIN d USING (doc_id) WHERE similarity >= 0.8 GROUP BY ALL"""
SQL["p6_items"] = f"""
SELECT item_id, suite, count(*) AS n_documents, count(*) FILTER (exact) AS n_exact, max(similarity) AS similarity FROM ({SQL["p6_leaks"]}) JOIN eval_items USING (item_id) GROUP BY ALL"""

# the factor of each split by the sizes of its sample at all places where a category turns; then the same crossings
_P1 = f"""
WITH r AS (SELECT record_id, {_SPLIT} AS split, {_KEY.format("label")} AS label FROM split_csv),
n AS (SELECT split, count(*) AS stratum_rows FROM r WHERE split IS NOT NULL GROUP BY 1),
a AS (SELECT split, label, count(*) AS n FROM r WHERE split IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
t AS (SELECT split, label, target_bp::BIGINT AS target_bp, min_rows::BIGINT AS min_rows, coalesce(a.n, 0) AS available, coalesce(stratum_rows, 0) AS stratum_rows, target_bp * coalesce(stratum_rows, 0) / 50000::DOUBLE AS wanted,
  least(min_rows, coalesce(a.n, 0)) AS floor FROM sample_targets LEFT JOIN a USING (split, label) LEFT JOIN n USING (split)),
f AS (SELECT split, turn, sum(least(t.available, greatest(t.floor, turn * t.wanted))) AS size FROM t JOIN (SELECT DISTINCT split, unnest([floor / wanted, available / wanted]) AS turn FROM t WHERE wanted > 0 UNION SELECT split, 1 FROM t) USING (split) GROUP BY ALL),
g AS (SELECT *, lead(turn) OVER w AS turn2, lead(size) OVER w AS size2 FROM f WINDOW w AS (PARTITION BY split ORDER BY turn)),
k AS (SELECT split, min(turn + CASE WHEN size2 > size THEN (s - size) * (turn2 - turn) / (size2 - size) ELSE 0 END) AS factor FROM g JOIN (SELECT split, sum(wanted) AS s FROM t GROUP BY 1) USING (split) WHERE turn >= 1 AND size <= s AND size2 >= s GROUP BY 1),
m AS (SELECT split, CASE WHEN max(size) FILTER (turn = 1) >= sum(DISTINCT s) THEN 1 ELSE 'Infinity'::DOUBLE END AS other FROM f JOIN (SELECT split, sum(wanted) AS s FROM t GROUP BY 1) USING (split) GROUP BY 1),
e AS (SELECT t.*, CASE WHEN wanted > 0 THEN least(wanted * CASE WHEN coalesce(k.factor, other) < 1 + 1e-9 THEN 1 ELSE coalesce(k.factor, other) END, available::DOUBLE) ELSE 0 END AS expected FROM t LEFT JOIN k USING (split) LEFT JOIN m USING (split)),
o AS (SELECT *, sum(expected) OVER (PARTITION BY split ORDER BY label) - expected AS ahead FROM e),
p AS (SELECT record_id, split, label, row_number() OVER (PARTITION BY split, label ORDER BY ('0x' || md5('42|' || record_id)[1:15])::BIGINT, record_id) AS rank FROM r SEMI JOIN t USING (split, label)),
q AS (SELECT p.*, o.* EXCLUDE (split, label), rank / available::DOUBLE AS upto, (rank - 1) / available::DOUBLE AS before, floor(ahead + expected + {{u}}) - floor(ahead + {{u}}) AS first FROM p JOIN o USING (split, label)),
s AS (SELECT record_id, split, label FROM q WHERE CASE WHEN expected >= available THEN true WHEN first < floor THEN floor(floor * upto + {{u}}) > floor(floor * before + {{u}}) ELSE floor(ahead + expected * upto + {{u}}) > floor(ahead + expected * before + {{u}}) END),
d AS (SELECT o.*, coalesce(c, 0) AS drawn FROM o LEFT JOIN (SELECT split, label, count(*) AS c FROM s GROUP BY 1, 2) USING (split, label))""".replace("{u}", repr(sampling._start(42)) + "::DOUBLE")
SQL["p1_sample"] = f"{_P1} SELECT record_id, split, label FROM s"
SQL["p1_report"] = f"""{_P1} SELECT split, label, target_bp, min_rows, available, stratum_rows, round(wanted, 4) AS wanted, drawn, round(wanted / nullif(sum(wanted) OVER (PARTITION BY split), 0), 6) AS share_wanted,
  round(drawn / nullif(sum(drawn) OVER (PARTITION BY split), 0)::DOUBLE, 6) AS share_drawn, available < min_rows OR available * 50000 < target_bp * stratum_rows AS unmet,
  CASE WHEN available < min_rows OR available * 50000 < target_bp * stratum_rows THEN greatest(ceil(wanted), min_rows)::BIGINT - drawn ELSE 0 END AS missing FROM d"""

# every document has one source here, so the cheapest largest flow of a source is the smaller of its quota and of all its tokens as often as it may be used
_P7 = f"""
WITH d AS (SELECT doc_id, {_KEY.format("source")} AS source, coalesce(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]+')), 0) AS n FROM documents),
a AS (SELECT sum(n)::BIGINT AS n FROM d),
m AS (SELECT source, target_bp::BIGINT AS target_bp, max_repeats::BIGINT AS max_repeats, coalesce(s.n, 0)::BIGINT AS tokens, target_bp * a.n AS quota, least(target_bp * a.n, max_repeats * coalesce(s.n, 0)::BIGINT * 10000) AS routed
  FROM mix_targets LEFT JOIN (SELECT source, sum(n) AS n FROM d GROUP BY 1) s USING (source), a),
l AS (SELECT doc_id, d.source, d.n, tokens * 10000 AS w, routed, (sum(d.n) OVER (PARTITION BY d.source ORDER BY ('0x' || md5('42|' || doc_id)[1:15])::BIGINT, doc_id) - d.n)::BIGINT * 10000 AS b FROM d JOIN m USING (source) WHERE d.n > 0),
c AS (SELECT doc_id, source, ((routed - b + w - 1) // w)::BIGINT AS n_uses, ((routed - b + w - 1) // w * n)::BIGINT AS tokens FROM l WHERE routed > b)"""
SQL["p7_mix"] = f"{_P7} SELECT * FROM c"
SQL["p7_report"] = f"""{_P7} SELECT m.source, target_bp, max_repeats, m.tokens, quota / 10000::DOUBLE AS quota, routed / 10000::DOUBLE AS routed, routed < quota AS is_short, coalesce(chosen, 0) AS chosen, coalesce(n_documents, 0) AS n_documents, coalesce(most_uses, 0) AS most_uses,
  round(coalesce(chosen, 0) / (SELECT sum(tokens) FROM c)::DOUBLE, 6) AS share, round(coalesce(chosen, 0) / (SELECT n FROM a)::DOUBLE, 6) AS share_of_all
FROM m LEFT JOIN (SELECT source, sum(tokens)::BIGINT AS chosen, count(*) AS n_documents, max(n_uses) AS most_uses FROM c GROUP BY 1) USING (source)"""
