"""Order features shared by segmentation and regression: one join, one encoder.

Category levels are indexed in alphabetical order and one-hot encoded with a slot for
unknown ones, which ``dropLast`` drops, so each level seen in the data keeps a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Every order with its product's category and sub-category, NULL if the product is unknown."""
    return orders.join(products.select("product_id", "category", "sub_category"), "product_id", "left")


def complete_rows(frame: DataFrame, fields: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """Rows with every one of ``fields``, and with ``positive`` ones above zero."""
    for name in positive:
        frame = frame.where(F.col(name) > 0)
    return frame.dropna("any", subset=list(fields))


def encoder(numeric: Sequence[str], categorical: Sequence[str], *estimator: Estimator, output: str = "features") -> Pipeline:
    """Numeric columns beside the one-hot block of the categorical ones, then ``estimator`` if one is given."""
    blocks = [f"{c}__levels" for c in categorical]
    stages: list = []
    if categorical:
        numbers = [f"{c}__number" for c in categorical]
        stages = [
            StringIndexer(inputCols=list(categorical), outputCols=numbers, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=numbers, outputCols=blocks),
        ]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *blocks], outputCol=output), *estimator])
