"""Tagged-union contract check on JSON elements, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One property: its kind, bounds (``above`` is exclusive), allowed values, item limits."""

    kind: str
    least: float | None = None
    most: float | None = None
    above: float | None = None
    values: tuple[str, ...] = ()
    min_items: int | None = None
    max_items: int | None = None
    required: bool = True


@dataclass(frozen=True)
class Contract:
    """Field rules per element type, sizes a sub-kind needs, and the root keys of a document."""

    types: Mapping[str, Mapping[str, Field]]
    colour: str = ".*"
    needs: Mapping[tuple[str, str, str], tuple[str, ...]] | None = None
    root: str = "elements"


# Ranges, enums and keys of a canvas document.
_X = Field("number", least=-5.0, most=26.0)
_Y = Field("number", least=-5.0, most=34.7)
_COLOUR = Field("colour")
_POSITIVE = Field("number", above=0.0)
_OPTIONAL_POSITIVE = Field("number", above=0.0, required=False)
_ROTATION = Field("number", required=False)
CANVAS = Contract(
    types={
        "background": {"color": _COLOUR},
        "rectangle": {"x1": _X, "y1": _Y, "x2": _X, "y2": _Y, "color": _COLOUR, "rotation": _ROTATION},
        "triangle": {"x1": _X, "y1": _Y, "x2": _X, "y2": _Y, "x3": _X, "y3": _Y, "color": _COLOUR},
        "circle": {"cx": _X, "cy": _Y, "radius": Field("number", above=0.0, most=30.0), "color": _COLOUR},
        "line": {"x1": _X, "y1": _Y, "x2": _X, "y2": _Y, "color": _COLOUR, "width": _POSITIVE},
        "pattern": {
            "pattern_type": Field("string", values=("circle_grid", "rect_grid")),
            "cols": Field("integer", least=1, most=30),
            "rows": Field("integer", least=1, most=30),
            "x_start": Field("number", least=0.0, most=21.0),
            "y_start": Field("number", least=0.0, most=29.7),
            "x_step": _POSITIVE,
            "y_step": _POSITIVE,
            "colors": Field("colours", min_items=1, max_items=4),
            "color_rule": Field("string", values=("checker", "row", "col"), required=False),
            "stagger": Field("boolean", required=False),
            "radius": _OPTIONAL_POSITIVE,
            "width": _OPTIONAL_POSITIVE,
            "height": _OPTIONAL_POSITIVE,
            "rotation": _ROTATION,
        },
    },
    colour=r"^(#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})|[a-zA-Z][a-zA-Z0-9!]*( [a-zA-Z0-9!]+)*)$",
    needs={
        ("pattern", "pattern_type", "circle_grid"): ("radius",),
        ("pattern", "pattern_type", "rect_grid"): ("width", "height"),
    },
)


def _texts(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _map_of(entries: Mapping[str, Column], empty: str) -> Column:
    if not entries:
        return F.create_map().cast(empty)
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def _kind_ok(kind: Column, json_type: Column, value: Column) -> Column:
    is_number = json_type.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "number", is_number)
        .when(kind == "integer", is_number & (number == F.floor(number)))
        .when(kind == "boolean", json_type == "BOOLEAN")
        .when(kind == "colours", F.startswith(json_type, F.lit("ARRAY")))
        .otherwise(json_type == "STRING")
    )


def _field_fault(rule: Column, value: Column, colour: str) -> Column:
    """Name of the broken rule of one value, or NULL."""
    json_type = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    items = F.try_variant_get(value, "$", "array<variant>")
    count = F.size(items)
    bad_item = F.exists(
        items,
        lambda i: (F.schema_of_variant(i) != "STRING")
        | ~F.coalesce(F.try_variant_get(i, "$", "string").rlike(colour), F.lit(False)),
    )
    is_number = rule["kind"].isin("number", "integer")
    return (
        F.when(~F.coalesce(_kind_ok(rule["kind"], json_type, value), F.lit(False)), "type")
        .when(
            is_number & ((number < rule["least"]) | (number > rule["most"]) | (number <= rule["above"])), "range"
        )
        .when((rule["kind"] == "string") & (F.size(rule["values"]) > 0) & ~F.array_contains(rule["values"], text), "enum")
        .when((rule["kind"] == "colour") & ~text.rlike(colour), "colour")
        .when((rule["kind"] == "colours") & ((count < rule["min_items"]) | (count > rule["max_items"])), "items")
        .when((rule["kind"] == "colours") & bad_item, "colour")
    )


def element_faults(kind: Column, fields: Column, contract: Contract, tag: str | None = "type") -> Column:
    """Array of (rule, field) for one element: its type name and its map of VARIANT fields."""
    types = contract.types
    allowed = _map_of(
        {t: _texts([*([tag] if tag else []), *spec]) for t, spec in types.items()}, "map<string,array<string>>"
    )
    required = _map_of(
        {t: _texts([n for n, f in spec.items() if f.required]) for t, spec in types.items()},
        "map<string,array<string>>",
    )
    rules = _map_of(
        {
            f"{t}.{name}": F.struct(
                F.lit(f.kind).alias("kind"),
                F.lit(-float("inf") if f.least is None else float(f.least)).alias("least"),
                F.lit(float("inf") if f.most is None else float(f.most)).alias("most"),
                F.lit(-float("inf") if f.above is None else float(f.above)).alias("above"),
                _texts(f.values).alias("values"),
                F.lit(0 if f.min_items is None else f.min_items).alias("min_items"),
                F.lit(2**31 - 1 if f.max_items is None else f.max_items).alias("max_items"),
            )
            for t, spec in types.items()
            for name, f in spec.items()
        },
        "map<string,string>",
    )

    def fault(rule: Column, field: Column) -> Column:
        return F.struct(rule.alias("rule"), field.alias("field"))

    keys = F.map_keys(fields)
    missing = F.transform(F.array_except(F.try_element_at(required, kind), keys), lambda n: fault(F.lit("missing"), n))
    extra = F.transform(F.array_except(keys, F.try_element_at(allowed, kind)), lambda n: fault(F.lit("extra"), n))
    ruled = F.filter(
        F.transform(
            F.map_entries(fields),
            lambda e: F.struct(
                e["key"].alias("key"),
                e["value"].alias("value"),
                F.try_element_at(rules, F.concat(kind, F.lit("."), e["key"])).alias("rule"),
            ),
        ),
        lambda e: e["rule"].isNotNull(),
    )
    faulty = F.filter(
        F.transform(ruled, lambda e: fault(_field_fault(e["rule"], e["value"], contract.colour), e["key"])),
        lambda f: f["rule"].isNotNull(),
    )
    lists = [missing, extra, faulty]
    for (type_name, selector, choice), sizes in (contract.needs or {}).items():
        chosen = F.try_variant_get(F.try_element_at(fields, F.lit(selector)), "$", "string")
        wanted = F.transform(F.array_except(_texts(sizes), keys), lambda n: fault(F.lit("needed"), n))
        lists.append(F.when((kind == type_name) & (chosen == choice), wanted))
    known = F.map_contains_key(required, kind)
    none = F.array().cast("array<struct<rule:string,field:string>>")
    found = F.concat(*[F.coalesce(part, none) for part in lists])
    unknown = F.array(fault(F.lit("unknown_type"), F.lit(tag or "type")))
    return F.when(F.coalesce(known, F.lit(False)), found).otherwise(unknown)


def check_elements(
    df: DataFrame, key: Sequence[str], kind: str, fields_json: str, contract: Contract
) -> DataFrame:
    """Violations of rows that are one element each, with the type in its own column:
    (key, type, rule, field). Text that is no JSON object gives one ``corrupt`` row."""
    parsed = df.select(
        *key,
        F.col(kind).alias("type"),
        F.try_variant_get(F.try_parse_json(fields_json), "$", "map<string,variant>").alias("__fields"),
    )
    corrupt = F.array(F.struct(F.lit("corrupt").alias("rule"), F.lit(None).cast("string").alias("field")))
    faults = F.when(F.col("__fields").isNull(), corrupt).otherwise(
        element_faults(F.col("type"), F.col("__fields"), contract, tag=None)
    )
    return parsed.select(*key, "type", F.inline(faults))


def canvas_elements(df: DataFrame, key: Sequence[str], json_col: str, root: str = "elements") -> DataFrame:
    """One row per element: ``pos`` (z-order), ``type`` and ``fields``, a map of VARIANT values."""
    items = F.try_variant_get(F.try_parse_json(json_col), f"$.{root}", "array<variant>")
    return (
        df.select(*key, F.posexplode(items).alias("pos", "__el"))
        .select(*key, "pos", F.try_variant_get("__el", "$", "map<string,variant>").alias("fields"))
        .select(
            *key,
            "pos",
            F.try_variant_get(F.try_element_at("fields", F.lit("type")), "$", "string").alias("type"),
            "fields",
        )
    )


def document_faults(json: Column, contract: Contract = CANVAS) -> Column:
    """Array of (pos, type, rule, field) of one document, empty for a good one; ``pos`` is NULL for
    faults of the document itself (``corrupt``, ``missing``, ``extra``, ``items``, ``type``)."""
    kind = "array<struct<pos:int,type:string,rule:string,field:string>>"

    def fault(rule: str, field: Column, pos: Column | None = None, of: Column | None = None) -> Column:
        return F.struct(
            (F.lit(None) if pos is None else pos).cast("int").alias("pos"),
            (F.lit(None) if of is None else of).cast("string").alias("type"),
            F.lit(rule).alias("rule"),
            field.cast("string").alias("field"),
        )

    def judge(doc: Column) -> Column:
        root = F.try_variant_get(doc, "$", "map<string,variant>")
        items = F.try_variant_get(doc, f"$.{contract.root}", "array<variant>")
        own, none = F.lit(contract.root), F.lit(None)
        extra = F.transform(F.array_except(F.map_keys(root), _texts([contract.root])), lambda n: fault("extra", n))
        body = (
            F.when(~F.map_contains_key(root, own), F.array(fault("missing", own)))
            .when(items.isNull(), F.array(fault("type", own)))
            .when(F.size(items) < 1, F.array(fault("items", own)))
            .otherwise(F.array().cast(kind))
        )

        def of_element(item: Column, pos: Column) -> Column:
            fields = F.try_variant_get(item, "$", "map<string,variant>")
            name = F.try_variant_get(F.try_element_at(fields, F.lit("type")), "$", "string")
            found = F.transform(
                element_faults(name, fields, contract),
                lambda f: F.struct(pos.cast("int").alias("pos"), name.alias("type"), f["rule"].alias("rule"), f["field"].alias("field")),
            )
            return F.when(fields.isNull(), F.array(fault("type", none, pos))).otherwise(found)

        inside = F.coalesce(F.flatten(F.transform(items, of_element)), F.array().cast(kind))
        return (
            F.when(doc.isNull(), F.array(fault("corrupt", none)))
            .when(root.isNull(), F.array(fault("type", none)))
            .otherwise(F.concat(extra, body, inside))
        )

    # Bound through a one-item array, so that the text is parsed once.
    return F.get(F.transform(F.array(F.try_parse_json(json)), judge), F.lit(0))


def check_union(df: DataFrame, key: Sequence[str], json_col: str, contract: Contract = CANVAS) -> DataFrame:
    """Violations of whole documents, one row each: (key, pos, type, rule, field)."""
    return df.select(*key, F.inline(document_faults(F.col(json_col), contract)))


def violation_report(violations: DataFrame) -> DataFrame:
    return violations.groupBy("type", "rule").agg(F.count(F.lit(1)).alias("n"))
