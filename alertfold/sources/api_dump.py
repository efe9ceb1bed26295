"""Dumps of monitoring API responses, one JSON body per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_api_dump(bodies: DataFrame, item_schema: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(items, errors): the entries of every ``result`` as rows, and the ``error.data`` of failed calls.

    Other columns of ``bodies`` are kept. Bodies that are no JSON object are errors without data.
    """
    schema = f"result ARRAY<STRUCT<{item_schema}>>, error STRUCT<code: BIGINT, data: STRING>"
    others = [c for c in bodies.columns if c != body]
    parsed = bodies.select(*others, F.from_json(body, schema).alias("r"))
    failed = F.col("r.error").isNotNull() | F.col("r.result").isNull()
    items = parsed.filter(~failed).select(*others, F.explode("r.result").alias("item")).select(*others, "item.*")
    errors = parsed.filter(failed).select(*others, F.col("r.error.data").alias("error"))
    return items, errors
