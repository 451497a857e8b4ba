"""Declared schemas of the stored tables, and tables made by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.files import exists

_DIAGNOSIS = "struct<disease:string,health_status:string,confidence:double,model_version:string,timestamp:string>"
_METADATA = "struct<notes:string,file_name:string,accepted:boolean,reason:string>"
_SCORES = "map<string,double>"

#: Columns of each table in order: those that must be given are marked NOT NULL.
TABLES: dict[str, str] = {
    "plants": f"id bigint NOT NULL, plant_id string NOT NULL, user_id int, species string, crop string NOT NULL, common_name string, date_created timestamp_ntz, initial_diagnosis {_DIAGNOSIS}, treatment string, treatment_date timestamp_ntz, notes string",
    "images": "id bigint NOT NULL, plant_id bigint, file_path string NOT NULL, file_name string NOT NULL, upload_date timestamp_ntz, quality_score double, embedding array<double>",
    "observations": f"id bigint NOT NULL, plant_id bigint NOT NULL, image_id bigint, predicted_disease string, predicted_deficiency string, health_status string, confidence double, disease_probabilities {_SCORES}, deficiency_probabilities {_SCORES}, severity double, severity_category string, affected_area_pct double, plant_id_prediction string, plant_id_confidence double, created_at timestamp_ntz, model_version string, metadata {_METADATA}",
    "predictions": "id bigint NOT NULL, plant_id bigint, image_path string, predicted_disease string, predicted_deficiency string, health_status string, confidence double, severity double, severity_category string, model_version string, created_at timestamp_ntz",
    "treatments": "id bigint NOT NULL, plant_id bigint NOT NULL, treatment_name string NOT NULL, description string, applied_date timestamp_ntz, notes string",
    "model_versions": f"id bigint NOT NULL, model_name string NOT NULL, version string NOT NULL, training_datasets array<string>, classes map<string,string>, performance_metrics {_SCORES}, model_path string, is_active boolean, created_at timestamp_ntz",
}


def declared(name: str) -> T.StructType:
    """The schema of a table; needs a session."""
    return T.StructType.fromDDL(TABLES[name])


def create_if_missing(spark: SparkSession, folder: str) -> list[str]:
    """Write each declared table that the folder lacks as an empty one; the names of those written. Tables that are there are left alone."""
    made = []
    for name in TABLES:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if not exists(spark, path):
            spark.createDataFrame([], declared(name)).write.parquet(path)
            made.append(name)
    return made


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of the declared table, cast to its types; columns that df lacks are null, further ones are left out."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared(name).fields))


def violations(df: DataFrame, name: str) -> DataFrame:
    """column, n: rows of a table that lack a value in a column that must have one, for each such column."""
    needed = [f.name for f in declared(name).fields if not f.nullable]
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in needed))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in needed))).alias("x")).select("x.*")
