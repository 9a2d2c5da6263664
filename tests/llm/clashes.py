"""Frames with further columns."""

from __future__ import annotations

from pyspark.sql import types as T


def with_clashes(spark, rows, schema):
    """A frame with further columns whose names the operators use inside."""
    extra = "id string, text_ string, label_ string, h int, g int, tie int, spans int, keys int, block int, first int, _rank int"
    names = {f.name for f in T._parse_datatype_string(schema).fields}
    add = [f for f in T._parse_datatype_string(extra).fields if f.name not in names]
    full = T.StructType([*T._parse_datatype_string(schema).fields, *add])
    return spark.createDataFrame([(*r, *[None] * len(add)) for r in rows], full)
