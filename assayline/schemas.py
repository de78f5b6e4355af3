"""Explicit schemas of the input tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

RESPONSES = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

BRAND = T.StructType(
    [
        T.StructField("company", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("font", T.StringType()),
        T.StructField("colors", _TEXT_MAP),
        T.StructField("logos", _TEXT_MAP),
        T.StructField("logo_svg", _TEXT_MAP),
        T.StructField("logo_height_cm", T.DoubleType()),
        T.StructField("logo_position", T.ArrayType(T.DoubleType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

SHAPES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("fill", T.StringType()),
    ]
)

# Prices stay text: "0" and "0.00" mean different things (free is exactly "0").
CATALOGUE = T.StructType(
    [
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField(
                            "pricing",
                            T.StructType(
                                [
                                    T.StructField("prompt", T.StringType()),
                                    T.StructField("completion", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "architecture",
                            T.StructType(
                                [
                                    T.StructField("modality", T.StringType()),
                                    T.StructField("input_modalities", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField("context_length", T.StringType()),
                        T.StructField(
                            "top_provider",
                            T.StructType([T.StructField("max_completion_tokens", T.StringType())]),
                        ),
                    ]
                )
            ),
        )
    ]
)
