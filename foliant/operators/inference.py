"""Scoring with a given model: batches of arrays go to Python workers, the rest stays in expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score(df: DataFrame, features: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, out: str = "logits", batch_size: int = 32) -> DataFrame:
    """df with the array<double> that a model gives for each array of `width` numbers; null for null.

    load is called once in each Python worker and gives a function from a (rows, width) to a (rows, classes) array.
    """
    udf = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    zeros = F.array_repeat(F.lit(0.0), width)
    x = F.transform(F.coalesce(F.col(features), zeros), lambda a: a.cast("double"))
    return df.withColumn("_x", x).withColumn("_y", udf("_x")).withColumn(out, F.when(F.col(features).isNotNull(), F.col("_y"))).drop("_x", "_y")
