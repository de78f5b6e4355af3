"""From brand manifests and parsed vector shapes to normalised, coloured shapes per variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.text import pascal_case
from assayline.operators.reference import manifest_status, reconcile_maps
from assayline.operators.scale import HOT_MIN_ROWS, hot_keys, spread_join
from assayline.operators.shapes import encode_first_seen, fill_colour, normalise_bbox
from assayline.session import materialise

# Height in cm when neither the call nor the brand gives one; macro prefix.
DEFAULT_HEIGHT = 3.0
MACRO_PREFIX = "Logo"
BOX = (("x0", "x1"), ("y0", "y1"))


def logo_manifest(brands: DataFrame, inventory: DataFrame, height: float | None = None, **sizing) -> DataFrame:
    """One row per variant: source and target path, macro name, height and ``status``.

    Paths lie below the brand's name; ``inventory`` lists the existing source paths (``path``).
    The height given in the call wins over the brand's, also when that is zero.
    """
    layers = ([F.lit(height)] if height is not None else []) + [F.col("logo_height_cm"), F.lit(DEFAULT_HEIGHT)]
    pairs = reconcile_maps(
        brands.select("brand", F.coalesce(*layers).alias("height"), "logo_svg", F.coalesce("logos", F.create_map().cast("map<string,string>")).alias("logos")),
        "logo_svg",
        "logos",
    )
    below = pairs.withColumn("source", F.concat("brand", F.lit("/"), "source")).withColumn(
        "macro", F.concat(F.lit(MACRO_PREFIX), pascal_case(F.col("brand")), pascal_case(F.col("key")))
    )
    return manifest_status(below, inventory, **sizing)


def logo_shapes(manifest: DataFrame, shapes: DataFrame, **sizing) -> DataFrame:
    """Shapes of every convertible variant, scaled to its height with Y up, in paint order.

    All shapes shape the box; only filled ones are kept, each with the ``colour_id`` of its fill
    in order of first use. A variant without a usable box or fill keeps its shapes with a
    ``reject_reason``, and one without any shape gives one row with it. A file belongs to one
    variant, so ``shapes`` itself bounds the sizes of all steps.
    """
    wanted = manifest.filter("status = 'ok'").select("brand", "key", "macro", "height", F.col("source").alias("file"))
    wanted = materialise(wanted)
    group, rows = ["brand", "key"], shapes.count()
    drawn = spread_join(shapes, wanted, ["file"], "inner", **sizing).withColumn("colour", fill_colour(F.col("fill")))
    small = rows <= HOT_MIN_ROWS
    hot = [] if small else hot_keys(drawn, group)
    boxed = normalise_bbox(drawn, group, *BOX, F.col("height"), also={"__filled": F.count("colour")}, hot=hot)
    judged = boxed.withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.col("__filled") == 0, F.lit("no filled shape")))
    )
    kept = materialise(judged.filter("reject_reason IS NOT NULL OR colour IS NOT NULL").drop("__filled"))
    coded = encode_first_seen(
        kept, group, "colour", ["pos"], "colour_id", rows=rows, hot=[] if small else hot_keys(kept, [*group, "colour"])
    )
    bare = wanted.join(shapes.select("file").distinct(), ["file"], "left_anti")
    return coded.unionByName(bare.withColumn("reject_reason", F.lit("no bounding box")), allowMissingColumns=True)
