"""Inserts, updates and deletes as transformations of whole tables; each gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.manifest import keep_first
from foliant.operators.ranking import ranked


def padded(number: Column, digits: int) -> Column:
    """Digits of a whole number with zeros before it; a longer number is never cut."""
    return F.format_string(f"%0{digits}d", number)


def next_ids(new: DataFrame, history: DataFrame, code: str, order: list[str], prefix: str = "PG-", digits: int = 6) -> DataFrame:
    """new with `number` and `code` after the largest number among all codes ever given in history, so none is used again.

    Codes that do not have the form prefix + digits, or whose number is no bigint, are left aside; without any, numbers start at 1.
    """
    n = F.regexp_extract(F.col(code), f"^{prefix}([0-9]+)$", 1)
    top = history.agg(F.coalesce(F.max(F.when(n != "", n.try_cast("bigint"))), F.lit(0)).alias("_top"))
    out = ranked(new, [], order).withColumn("number", top.scalar() + F.col("rank"))
    return out.withColumn(code, F.concat(F.lit(prefix), padded(F.col("number"), digits))).drop("rank", "group_rows")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key old does not have; of several new rows with one key any one, the same on every run. Null keys are not inserted."""
    keys = old.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct()
    absent = new.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_k"), "left_anti")
    plain = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in absent.dtypes]
    once = keep_first(absent.withColumn("_o", F.struct(*plain)), key, ["_o"]).drop("_o")
    return old.unionByName(once, allowMissingColumns=True)


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the columns that `changes` supplies for a key: has_x tells whether x is supplied, and then a null overwrites.

    changes has key, x and has_x for each column; keys of changes must be unique, those old does not have are left aside.
    """
    c = changes.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_{x}") for x in columns), *(F.coalesce(F.col(f"has_{x}"), F.lit(False)).alias(f"_has_{x}") for x in columns))
    out = old.join(c, F.col(key) == F.col("_k"), "left")
    return out.withColumns({x: F.when(F.coalesce(F.col(f"_has_{x}"), F.lit(False)), F.col(f"_{x}")).otherwise(F.col(x)) for x in columns}).select(*old.columns)


def delete_cascade(doomed: DataFrame, key: str, entities: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The entities and their children (name: (table, foreign key)) without the doomed keys; rows with a null key stay."""
    gone = doomed.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct()
    out = {"entities": entities.join(gone, F.col(key) == F.col("_k"), "left_anti")}
    for name, (df, fk) in children.items():
        out[name] = df.join(gone, F.col(fk) == F.col("_k"), "left_anti")
    return out


def append_observations(observations: DataFrame, images: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, images) with the new uploads (plant_id, file_name, created_at and the prediction's columns) appended.

    Ids follow the largest there are, in the order (created_at, plant_id, file_name); an observation gets the id of its
    image, and the image its path by the plant's number of observations, counted on from those before.
    """
    rank = ranked(new, [], ["created_at", "plant_id", "file_name"]).drop("group_rows").withColumnRenamed("rank", "_n")
    rank = ranked(rank, ["plant_id"], ["_n"]).drop("group_rows").withColumnRenamed("rank", "_p")
    top = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    had = observations.groupBy(F.col("plant_id").alias("_e")).agg(F.count(F.lit(1)).alias("_had"))
    x = rank.join(had, F.col("plant_id") == F.col("_e"), "left")
    x = x.withColumns({"id": top(observations) + F.col("_n"), "image_id": top(images) + F.col("_n"), "_at": F.col("_p") + F.coalesce("_had", F.lit(0))})
    code = F.concat(F.lit("PG-"), padded(F.col("plant_id"), 6))
    name = F.concat(F.lit("observation_"), padded(F.col("_at"), 3), F.lit(".jpg"))
    pictures = x.select(F.col("image_id").alias("id"), "plant_id", F.concat_ws("/", F.lit("data/plants"), code, name).alias("file_path"), name.alias("file_name"), F.col("created_at").alias("upload_date"))
    return (
        observations.unionByName(x.select("id", "image_id", *[c for c in new.columns if c in observations.columns]), allowMissingColumns=True),
        images.unionByName(pictures, allowMissingColumns=True),
    )


def fill_diagnosis(plants: DataFrame, first: DataFrame, key: str, fk: str) -> DataFrame:
    """plants with initial_diagnosis filled from `first` (fk, disease, health_status, confidence, model_version, date) where it is empty: null or without any value.

    A diagnosis that is there stays as it is. first must be unique by fk; plants without an entry stay empty.
    """
    names = ["disease", "health_status", "confidence", "model_version"]
    given = F.struct(*names, F.col("date").alias("timestamp"))
    f = first.select(F.col(fk).alias("_f"), given.alias("_given"))
    old = F.col("initial_diagnosis")
    empty = old.isNull() | F.coalesce(*(old[n].cast("string") for n in [*names, "timestamp"])).isNull()
    out = plants.join(f, F.col(key) == F.col("_f"), "left")
    return out.withColumn("initial_diagnosis", F.when(empty, F.col("_given")).otherwise(old)).drop("_f", "_given")


def stored_path(code: Column | str, number: Column | str, name: Column) -> Column:
    """Where an upload is stored: code/observation_001.jpg for a plant's numbered observation, else the eight digits of `name`, always as .jpg."""
    c, n = (F.col(x) if isinstance(x, str) else x for x in (code, number))
    return F.when(c.isNotNull() & n.isNotNull() & (n != 0), F.concat(c, F.lit("/observation_"), padded(n, 3), F.lit(".jpg"))).otherwise(F.concat(F.left(name, F.lit(8)), F.lit(".jpg")))


def random_digits() -> Column:
    """Hexadecimal digits of a random UUID; another on every run."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
