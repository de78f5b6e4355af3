"""First-seen encoding, grid expansion and bounding-box normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.colour import full_hex, is_hex
from assayline.operators.scale import HOT_MIN_ROWS, numbered, spread_join

# Grid kinds with the sizes each needs, and the colour rule used when none fits.
GRID_SIZES = {"circle_grid": ("radius",), "rect_grid": ("width", "height")}
# Most cells along an axis.
GRID_MOST = 30
DEFAULT_RULE = "checker"


# Bits of the whole-number types that an order may have.
WHOLE_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """A value that sorts as the tuple ``order`` does, NULL first: one number where whole numbers of up to 126 bits
    make it up, so that minima of it are hashed and need no sort; else a struct."""
    kinds = dict(df.select(*order).dtypes)
    widths = [WHOLE_BITS.get(kinds[c]) for c in order]
    if None in widths or sum(w + 1 for w in widths) > 126:
        return F.struct(*order)
    number = lambda n: F.lit(n).cast("decimal(38,0)")
    place = number(0)
    for c, w in zip(order, widths):
        shifted = F.coalesce(F.col(c).cast("decimal(38,0)") + number(f"{2 ** (w - 1) + 1}"), number(0))
        place = (place * number(f"{2 ** (w + 1)}") + shifted).cast("decimal(38,0)")
    return place


def first_seen_dictionary(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    order: Sequence[str],
    name: str = "id",
    rows_per_slice: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Distinct values per group with dense 0-based ids in the order they were first met.

    ``rows`` is a known upper bound on the rows of ``df`` that saves counting them.
    """
    seen = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(_place(df, order)).alias("__first"))
    # The rows of ``df`` bound those of its aggregate, and counting them needs no shuffle.
    bound = df.count() if rows is None else rows
    ids = numbered(seen, group, ["__first", value], "__n", rows_per_slice, bound, df)
    return ids.select(*group, value, (F.col("__n") - 1).alias(name))


def encode_first_seen(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    order: Sequence[str],
    name: str = "id",
    rows_per_slice: int | None = None,
    rows: int | None = None,
    **sizing,
) -> DataFrame:
    """Add the dictionary id of ``value`` to every row, NULL for NULL values."""
    bound = df.count() if rows is None else rows
    words = first_seen_dictionary(df, group, value, order, name, rows_per_slice, bound)
    if not sizing and bound <= HOT_MIN_ROWS:
        sizing = {"hot": []}
    return spread_join(df, words, [*group, value], "left", null_safe=True, **sizing)


def element_colours(elements: DataFrame, key: Sequence[str], pos: str, colour: str, colours: str) -> DataFrame:
    """Colour mentions of elements in encounter order: ``color`` before the items of ``colors``;
    names are left out, hex values get six digits."""
    mentions = F.concat(F.array(F.col(colour)), F.coalesce(F.col(colours), F.array().cast("array<string>")))
    return (
        elements.select(*key, pos, F.posexplode(mentions).alias("slot", "__c"))
        .filter(is_hex(F.col("__c")))
        .select(*key, pos, "slot", full_hex(F.col("__c")).alias("hex"))
    )


def fill_colour(fill: Column) -> Column:
    """Fill of a vector shape as six digits, alpha dropped; NULL when the shape is not filled."""
    digits = F.upper(F.left(F.ltrim(fill, F.lit("#")), F.lit(6)))
    return F.when(~F.lower(fill).isin("none", ""), digits)


def expand_grid(df: DataFrame) -> DataFrame:
    """One row per cell of each grid row, with ``row``, ``col``, ``x``, ``y``, ``colour_index`` and
    ``colour``; a faulty grid yields one row with ``reject_reason`` instead.

    Reads ``pattern_type, cols, rows, x_start, y_start, x_step, y_step, colors, color_rule,
    stagger, radius, width, height``; other columns are carried along.
    """
    kind = F.col("pattern_type")
    reason = F.when(kind.isNull() | ~kind.isin(*GRID_SIZES), F.concat(F.lit("unknown_type: "), F.coalesce(kind, F.lit("null"))))
    for name, sizes in GRID_SIZES.items():
        lacking = F.concat_ws(", ", *[F.when(F.col(size).isNull(), size) for size in sizes])
        reason = reason.when((kind == name) & (lacking != ""), F.concat(F.lit("needed: "), lacking))
    empty = F.coalesce((F.col("rows") < 1) | (F.col("cols") < 1) | (F.size("colors") < 1), F.lit(True))
    beyond = (F.col("rows") > GRID_MOST) | (F.col("cols") > GRID_MOST)
    reason = reason.when(empty, F.lit("items: rows, cols, colors")).when(beyond, F.lit("range: rows, cols"))

    cell = df.withColumn("reject_reason", reason)
    # One axis at a time; a faulty grid has neither.
    for axis, size in (("row", "rows"), ("col", "cols")):
        steps = F.when(F.col("reject_reason").isNull(), F.sequence(F.lit(0), F.col(size).cast("int") - 1))
        cell = cell.select("*", F.explode_outer(steps).alias(axis))
    rule = F.coalesce(F.col("color_rule"), F.lit(DEFAULT_RULE))
    turn = (
        F.when(rule == "row", F.col("row"))
        .when(rule == "col", F.col("col"))
        .otherwise(F.col("row") + F.col("col"))
    )
    odd = F.coalesce(F.col("stagger"), F.lit(False)) & (F.col("row") % 2 == 1)
    shift = F.when(odd, F.col("x_step") / 2).otherwise(0.0)
    return (
        cell.withColumn("x", F.col("x_start") + F.col("col") * F.col("x_step") + shift)
        .withColumn("y", F.col("y_start") + F.col("row") * F.col("y_step"))
        .withColumn("colour_index", F.when(F.col("row").isNotNull(), F.pmod(turn, F.size("colors"))))
        .withColumn("colour", F.try_element_at("colors", F.col("colour_index") + 1))
    )


def normalise_bbox(
    df: DataFrame,
    group: Sequence[str],
    xs: tuple[str, str],
    ys: tuple[str, str],
    target: float | Column,
    also: dict[str, Column] | None = None,
    **sizing,
) -> DataFrame:
    """Scale each group to a target height, move it to the origin and flip Y: adds ``scale``,
    ``n<column>`` for each coordinate, and ``reject_reason`` for groups without a usable box.

    The box is a partial aggregate joined back to the rows, so no window buffers a group.
    ``also`` names further aggregates of the group to bring back with it.
    """
    height = F.lit(target) if isinstance(target, (int, float)) else target
    box = df.groupBy(*group).agg(
        F.min(F.least(*xs)).alias("__x"),
        F.min(F.least(*ys)).alias("__low"),
        F.max(F.greatest(*ys)).alias("__high"),
        *[c.alias(n) for n, c in (also or {}).items()],
    )
    span = F.col("__high") - F.col("__low")
    boxed = spread_join(df, box, group, "left", null_safe=True, **sizing)
    reason = F.when(F.col("__x").isNull() | span.isNull(), F.lit("no bounding box")).when(
        span <= 0, F.lit("no height")
    )
    scaled = boxed.withColumn("reject_reason", reason).withColumn(
        "scale", F.when(F.col("reject_reason").isNull(), height / F.nullif(span, F.lit(0.0)))
    )
    moved = {f"n{c}": (F.col(c) - F.col("__x")) * F.col("scale") for c in dict.fromkeys(xs)}
    flipped = {f"n{c}": (F.col("__high") - F.col(c)) * F.col("scale") for c in dict.fromkeys(ys)}
    return scaled.withColumns({**moved, **flipped}).drop("__x", "__low", "__high")


def height_scale(wanted: Column, native: Column, default: float = 3.0) -> Column:
    """Scale of a placed shape: wanted over native height; no or zero wanted height means 1, and a
    native height of zero leaves no scale (NULL)."""
    known = F.coalesce(native, F.lit(default))
    return F.when(F.coalesce(wanted, F.lit(0.0)) != 0, F.try_divide(wanted, known)).otherwise(1.0)
