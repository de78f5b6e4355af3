"""File typing and catalogue filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.schemas import CATALOGUE

# Image types accepted as cover input.
IMAGE_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".gif": "image/gif",
}

EXTENSION = r"(?s)[^/](\.[^./]+)$"


def type_files(
    df: DataFrame,
    path_col: str,
    ext_map: dict[str, str] | None = None,
    pattern: str = EXTENSION,
) -> DataFrame:
    """Add ``type_key``, ``mime`` and, where the key is unknown, ``reject_reason``.

    The map is a short literal, so typing is a projection; nothing is joined.
    """
    known = IMAGE_TYPES if ext_map is None else ext_map
    key = F.lower(F.regexp_extract(path_col, pattern, 1))
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return (
        df.withColumn("type_key", key)
        .withColumn("mime", F.try_element_at(lookup, F.col("type_key")))
        .withColumn("reject_reason", F.when(F.col("mime").isNull(), F.lit("unsupported type")))
    )


def filter_catalogue(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Entries of catalogue documents that cost exactly "0" and take images, sorted by id.

    Equal entries are listed once with their number of ``copies``: they are counted before the
    sort, since a range sort cannot split rows that compare equal.
    """
    entry = F.explode(F.from_json(json_col, CATALOGUE)["data"]).alias("m")
    models = df.select(entry)
    price = [F.coalesce(F.col(f"m.pricing.{side}"), F.lit("1")) for side in ("prompt", "completion")]
    modality = F.coalesce(
        F.nullif(F.col("m.architecture.modality"), F.lit("")),
        F.col("m.architecture.input_modalities"),
        F.lit(""),
    )
    kept = models.filter(
        (price[0] == "0") & (price[1] == "0") & F.contains(F.lower(modality), F.lit("image"))
    ).select(
        F.col("m.id").alias("id"),
        F.coalesce("m.name", "m.id").alias("name"),
        F.coalesce("m.context_length", F.lit("?")).alias("ctx"),
        F.coalesce("m.top_provider.max_completion_tokens", F.lit("?")).alias("max_out"),
    )
    fields = kept.columns
    return kept.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies")).orderBy(*fields)
