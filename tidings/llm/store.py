"""Intermediate tables in the shared folder, and keys for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.session import work_folder


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and still there
    after an executor is lost."""
    path = work_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def row_key(frame: DataFrame) -> list[Column]:
    """128 bits over all columns, as ``key_a`` and ``key_b``; rows with equal keys
    are the same in every column.

    Hashes pass over nulls and cannot read maps, so it is also hashed which columns
    are null, and nested columns as JSON.
    """
    def plain(name: str, kind: T.DataType) -> Column:
        column = frame[f"`{name}`"]
        return F.to_json(F.struct(column), {"ignoreNullFields": "false"}) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column

    nulls = F.concat_ws("", *(F.isnull(frame[f"`{name}`"]).cast("int") for name in frame.columns))
    columns = [plain(field.name, field.dataType) for field in frame.schema]
    return [
        F.xxhash64(nulls, *columns).alias("key_a"),
        F.xxhash64(F.lit(0x5bd1e995), *reversed(columns), nulls, F.lit(len(columns))).alias("key_b"),
    ]
