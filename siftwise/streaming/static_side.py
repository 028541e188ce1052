"""Stream-static joins: filters of the static side are applied to a stream before its join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwise.config import TransferConfig
from siftwise.operators.filters import build_filters


def reduce_stream(stream: DataFrame, key: str, static: DataFrame, static_key: str, **changes) -> DataFrame:
    """The stream without rows that an inner join on the keys would drop anyway.

    The static side is read once, when the query is defined; refreshed static tables need a new definition.
    """
    spark = static.sparkSession
    config = TransferConfig.of(spark, **changes)
    type_ = static.select(static_key)._jdf.schema().apply(0).dataType().sql()
    (found,), _ = build_filters(spark, static, [(F.col(static_key), type_)], config)
    test = found.predicate(spark, F.col(key))
    return stream if test is None else stream.filter(test)
