"""From raw responses to conformed artifacts, in one pass per table.

Attempts are resolved per request, the winning block is extracted, conformed to its brand's
palette, placed, toned, validated and composed. Rows that fail carry ``reject_reason`` and stay
in the result, so accepted and quarantined rows always add up to the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.colour import luminance
from assayline.operators.attempts import classify_failures, resolve_attempts
from assayline.operators.blocks import cover_rules, extract_balanced, parse_annotation, validate_rules
from assayline.operators.reference import (
    ALIAS_ROLES,
    BACKGROUND_ROLE,
    MUTED_ROLE,
    alias_columns,
    conform,
    definition_text,
    first_in_reference,
    load_reference,
)
from assayline.operators.scale import hot_keys, spread_join
from assayline.operators.shapes import height_scale
from assayline.operators.tone import TINTS, classify_tone, preferred, variant_or
from assayline.sources.writers import compose

# Stand-ins for what a brand leaves out, and the names of the text colours.
GREY = "#808080"
LOGO_POSITION = (1.5, 26.5)
LIGHT_ROLE = "light"
TEXT_COLOURS = {"fg": "VSCoverFg", "sub_fg": "VSCoverSubFg", "muted_fg": "VSCoverMutedFg", "faint_fg": "VSCoverFaintFg"}


def attempt_status(responses: DataFrame) -> DataFrame:
    """Add ``status`` to each attempt: the block's status, ``empty``, a retryable failure class, or
    ``fatal``."""
    judged = classify_failures(extract_balanced(responses, "raw"), "error").withColumnRenamed("status", "block_status")
    return judged.withColumn(
        "status",
        F.when(F.col("fatal"), "fatal")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.coalesce(F.col("raw"), F.lit("")) == "", "empty")
        .otherwise(F.col("block_status")),
    ).drop("block", "block_status", "fatal", "failure")


def resolved_requests(responses: DataFrame, **slicing) -> DataFrame:
    """One row per (request_id, brand) with the outcome of its attempts and its last payload."""
    return resolve_attempts(
        attempt_status(responses), ["request_id", "brand"], ["attempt"], "status", "raw", "model", **slicing
    )


def _has_palette() -> Column:
    """Whether the row's brand has colours; a brand with an empty map is treated as none."""
    return F.coalesce(F.size("colors") > 0, F.lit(False))


def _preamble() -> Column:
    """Colour definitions of a branded artifact; NULL without a palette."""
    aliases = [F.when(F.col(a).isNotNull(), definition_text(F.lit(a), F.col(a))) for a in ALIAS_ROLES]
    texts = [definition_text(F.lit(name), F.col(column)) for column, name in TEXT_COLOURS.items()]
    series = F.when(
        F.coalesce(F.col("series"), F.lit("")) != "",
        F.concat(F.lit("\\renewcommand{\\BookSeries}{"), F.col("series"), F.lit("}")),
    )
    head = F.concat(F.lit("% Colours of "), F.coalesce("company", "brand"))
    lines = F.array_compact(F.array(head, *aliases, *texts, series, F.lit("% End of the brand's colours")))
    return F.when(_has_palette(), F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def conform_requests(requests: DataFrame, brands: DataFrame, comment: str = "Auto-generated", **sizing) -> DataFrame:
    """Finish resolved requests against ``brands`` (one row per brand).

    Colours, placed logo, tone and preamble need a brand with colours; without one (also where the
    brand is '') the block stays as it is.
    """
    checked = load_reference(brands, "colors").select(
        "brand", "company", "series", "colors", "logos", "logo_height_cm", "logo_position",
        F.col("reject_reason").alias("__brand_fault"), F.lit(True).alias("__listed"),
    )
    owned = spread_join(requests, checked, ["brand"], "left", **sizing)
    failed = F.concat(F.col("outcome"), F.lit(": no complete block"))
    reasoned = owned.withColumn(
        "reject_reason",
        F.when(F.col("outcome") != "ok", failed)
        .when((F.col("brand") != "") & F.col("__listed").isNull(), "unknown brand")
        .otherwise(F.col("__brand_fault")),
    )
    usable = F.when(F.col("reject_reason").isNull(), F.col("last_payload"))
    blocks = extract_balanced(reasoned.withColumn("__raw", usable), "__raw").drop("status", "__raw")
    conformed = first_in_reference(parse_annotation(conform(blocks, "block", "colors"), "block"), "block", "colors")

    def role(name: str) -> Column:
        return F.try_element_at("colors", F.lit(name))

    under_logo = F.coalesce(F.try_element_at("colors", F.col("placement.bg")), role(BACKGROUND_ROLE), F.lit(GREY))
    accepted = F.col("reject_reason").isNull()
    branded = _has_palette() & accepted
    scale = height_scale(F.col("placement.height"), F.col("logo_height_cm"))
    sized = conformed.withColumn("scale", F.when(branded, scale)).withColumn(
        "reject_reason", F.when(branded & F.col("scale").isNull(), "no native height").otherwise(F.col("reject_reason"))
    )
    placed = sized.withColumns(
        {
            "variant": F.when(branded, preferred(luminance(under_logo), F.map_keys("logos"))),
            "logo_at": F.when(F.col("placement").isNotNull(), F.array("placement.x", "placement.y")).otherwise(
                F.coalesce("logo_position", F.array(*[F.lit(v) for v in LOGO_POSITION]))
            ),
            "__ground": F.coalesce(F.nullif("background", F.lit("")), role(BACKGROUND_ROLE)),
            "__light": role(LIGHT_ROLE),
            "__muted": role(MUTED_ROLE),
        }
    )
    toned = alias_columns(classify_tone(placed, "__ground", "__light", "__muted"), "colors")
    validated = validate_rules(toned, cover_rules("block"))
    named = F.nullif("brand", F.lit(""))
    note = F.coalesce(F.concat(F.lit(f"{comment} (brand: "), named, F.lit(")")), F.lit(comment))
    logos = F.coalesce(F.map_keys("logos"), F.array().cast("array<string>"))
    artifact = F.when(accepted, compose(note, _preamble(), F.col("block")))
    return validated.select(
        "request_id",
        "brand",
        "outcome",
        "attempts",
        "winner",
        "reject_reason",
        F.when(F.col("reject_reason").isNotNull(), F.col("last_payload")).alias("rejected_payload"),
        F.when(accepted, F.col("off_reference")).alias("off_reference"),
        "placement",
        "logo_at",
        "variant",
        F.when(branded, variant_or("alt", logos, F.col("variant"))).alias("footer_variant"),
        F.when(branded, variant_or("dark", logos, F.col("variant"))).alias("watermark_variant"),
        "scale",
        F.when(accepted, F.col("background")).otherwise(F.lit("")).alias("background"),
        F.when(branded, F.col("tone")).alias("tone"),
        F.when(accepted, F.col("warnings")).alias("warnings"),
        artifact.alias("artifact"),
    )


def conform_responses(responses: DataFrame, brands: DataFrame, comment: str = "Auto-generated", **slicing) -> DataFrame:
    """The whole job: (request_id, brand, attempt, model, raw, error) to one row per request."""
    hot = hot_keys(responses.select("brand"), ["brand"])
    return conform_requests(resolved_requests(responses, **slicing), brands, comment, hot=hot)
