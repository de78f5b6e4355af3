"""From canvas documents to named colours and ordered element lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.colour import full_hex, is_hex
from assayline.operators.contract import CANVAS, Contract, canvas_elements, document_faults
from assayline.operators.reference import definition_text
from assayline.operators.render import assemble
from assayline.operators.scale import HOT_MIN_ROWS, spread_join
from assayline.operators.shapes import element_colours, expand_grid, first_seen_dictionary
from assayline.session import materialise_counted

# Fixed value: prefix of the names given to hex colours.
COLOUR_PREFIX = "dyncolor"


def judged_documents(docs: DataFrame, json_col: str, contract: Contract = CANVAS) -> DataFrame:
    """Add ``violations`` and ``reject_reason`` to each document."""
    judged = docs.withColumn("violations", F.size(document_faults(F.col(json_col), contract)).cast("bigint"))
    return judged.withColumn("reject_reason", F.when(F.col("violations") > 0, "breaks the contract"))


def accepted_elements(docs: DataFrame, key: Sequence[str], json_col: str, contract: Contract = CANVAS) -> DataFrame:
    """Elements of the documents that keep the contract; a document that breaks it gives none."""
    accepted = judged_documents(docs, json_col, contract).filter("reject_reason IS NULL")
    return canvas_elements(accepted, key, json_col, contract.root)


def colour_mentions(elements: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, pos, slot, hex) of every hex colour that an element names."""
    flat = elements.select(
        *key,
        "pos",
        F.try_variant_get(F.try_element_at("fields", F.lit("color")), "$", "string").alias("color"),
        F.try_variant_get(F.try_element_at("fields", F.lit("colors")), "$", "array<string>").alias("colors"),
    )
    return element_colours(flat, key, "pos", "color", "colors")


def named_colours(mentions: DataFrame, key: Sequence[str], **slicing) -> DataFrame:
    """(key, hex, name), numbered as first met."""
    words = first_seen_dictionary(mentions, key, "hex", ["pos", "slot"], **slicing)
    return words.select(*key, "hex", F.concat(F.lit(COLOUR_PREFIX), F.col("id").cast("string")).alias("name"))


def colour_names(elements: DataFrame, key: Sequence[str], **slicing) -> DataFrame:
    """Name of every hex colour of a document: (key, hex, name), numbered as first met."""
    return named_colours(colour_mentions(elements, key), key, **slicing)


def colour_definitions(names: DataFrame, key: Sequence[str], part_items: int, **slicing) -> DataFrame:
    """Definitions of a document's colours, one per line in the order of their names as text, in
    pages of ``part_items``."""
    line = F.concat(F.lit("  "), definition_text(F.col("name"), F.col("hex")))
    return assemble(names, key, ["name"], line, "\n", part_items=part_items, **slicing)


def element_lists(
    elements: DataFrame,
    names: DataFrame,
    key: Sequence[str],
    part_items: int,
    contract: Contract = CANVAS,
    rows: int | None = None,
    **sizing,
) -> DataFrame:
    """Elements of a document bottom to top, one ``type colour`` per line, in pages of ``part_items``;
    unknown types are left out and hex colours appear under their names."""
    colour = F.try_variant_get(F.try_element_at("fields", F.lit("color")), "$", "string")
    known = elements.filter(F.col("type").isin(*contract.types)).select(
        *key, "pos", "type", colour.alias("color"), F.when(is_hex(colour), full_hex(colour)).alias("hex")
    )
    named = spread_join(known, names, [*key, "hex"], "left", null_safe=True, **sizing)
    text = F.concat_ws(" ", "type", F.coalesce("name", "color"))
    return assemble(named, key, ["pos"], text, "\n", part_items=part_items, rows=rows)


def canvas_definitions(docs: DataFrame, key: Sequence[str], json_col: str, part_items: int) -> DataFrame:
    """Colour definitions of all documents that keep the contract. They are judged and parsed once: the
    mentions are written, slim, and counted as they are written."""
    mentions, rows = materialise_counted(colour_mentions(accepted_elements(docs, key, json_col), key))
    return colour_definitions(named_colours(mentions, key, rows=rows), key, part_items, rows=rows)


def canvas_listing(docs: DataFrame, key: Sequence[str], json_col: str, part_items: int) -> DataFrame:
    """Element lists of all documents that keep the contract."""
    # Written once: the elements are read for names, for sizes and for the lists.
    elements, rows = materialise_counted(accepted_elements(docs, key, json_col).withColumn("fields", F.to_json("fields")))
    parsed = elements.withColumn("fields", F.try_variant_get(F.try_parse_json("fields"), "$", "map<string,variant>"))
    # The contract allows a colour and a list of four per element.
    names = colour_names(parsed, key, rows=5 * rows)
    hot = {"hot": []} if rows <= HOT_MIN_ROWS else {}
    return element_lists(parsed, names, key, part_items, rows=rows, **hot)


def canvas_cells(docs: DataFrame, key: Sequence[str], json_col: str) -> DataFrame:
    """Cells of all pattern elements of the documents that keep the contract, as ``expand_grid`` gives
    them, with the document's key and the element's ``pos``."""
    patterns = accepted_elements(docs, key, json_col).filter("type = 'pattern'")

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(F.try_element_at("fields", F.lit(name)), "$", kind).alias(name)

    numbers = ("x_start", "y_start", "x_step", "y_step", "radius", "width", "height")
    flat = patterns.select(
        *key,
        "pos",
        *[field(n, "string") for n in ("pattern_type", "color_rule")],
        *[field(n, "double").cast("int").alias(n) for n in ("cols", "rows")],
        *[field(n, "double") for n in numbers],
        field("colors", "array<string>"),
        field("stagger", "boolean"),
    )
    return expand_grid(flat)
