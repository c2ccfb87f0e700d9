"""Whole records as JSON text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false", "timeZone": "UTC"}


def encode(records: DataFrame, *keys: str) -> DataFrame:
    """The key columns and `document`, the JSON text of the whole row."""
    return records.select(*keys, F.to_json(F.struct(*records.columns), _OPTIONS).alias("document"))


def decode(documents: DataFrame, schema: StructType) -> DataFrame:
    """The rows that encode() was given. Text that is no such record is an error, not a null."""
    options = {k: v for k, v in _OPTIONS.items() if k != "ignoreNullFields"} | {"mode": "FAILFAST"}
    return documents.select(F.from_json("document", schema, options).alias("r")).select("r.*")
