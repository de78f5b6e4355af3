"""Reference tables: loading with quarantine, conforming text, aliases, layers, reconciliation.

A reference is carried as a MAP column, one small map per row, attached by a join on its owner.
Conforming is then a projection: no text is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.colour import HEX6_PATTERN, clean_hex, contrast, luminance
from assayline.operators.scale import hot_keys, join_null_safe, spread_join
from assayline.session import materialise

# Patterns of the artifact and the roles behind its colour aliases.
DEFINITION = r"\\definecolor\{([A-Za-z0-9_]+)\}\{HTML\}\{([0-9A-Fa-f]{3,8})\}"
DEFINITION_PARTS = ("\\definecolor{", "}{HTML}{", "}")
FILL = r"\\fill\[([A-Za-z0-9_]+)\]\s*\([^)]+\)\s*rectangle\s*\([^)]+\)"
ALIAS_ROLES = {
    "VSBlack": "bg_primary",
    "VSGraphite": "bg_secondary",
    "VSTeal": "accent_1",
    "VSRed": "accent_2",
    "VSSilver": "neutral",
    "VSPaperWhite": "light",
    "VSMutedText": "muted",
}
LINK_ALIAS = "VSRed"
BACKGROUND_ROLE = "bg_primary"
MUTED_ROLE = "muted"
LINK_DEFAULT = "5D5956"
LINK_RATIO = 2.5

# Occurrences of one text that are looked up together in ``conform_rows``.
PART_HITS = 256


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


# --- loading -----------------------------------------------------------------


def load_reference(df: DataFrame, map_col: str, pattern: str = HEX6_PATTERN) -> DataFrame:
    """Add ``bad_roles`` (sorted role names) and ``reject_reason``, one message per row that
    names every role whose value fails ``pattern``; NULL for a clean row."""
    bad = F.filter(
        F.map_entries(map_col), lambda e: ~F.coalesce(e["value"].rlike(pattern), F.lit(False))
    )
    ordered = F.array_sort(bad)
    texts = F.transform(ordered, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return df.withColumn(
        "bad_roles", F.coalesce(F.transform(ordered, lambda e: e["key"]), F.array().cast("array<string>"))
    ).withColumn(
        "reject_reason",
        F.when(F.size(bad) > 0, F.concat(F.lit("invalid values: "), F.array_join(texts, ", "))),
    )


def reference_rows(df: DataFrame, map_col: str, key_name: str = "role", value_name: str = "hex") -> DataFrame:
    """The map as rows, other columns repeated."""
    kept = [c for c in df.columns if c != map_col]
    return df.select(*kept, F.explode(map_col).alias(key_name, value_name))


def attach_reference(df: DataFrame, reference: DataFrame, on: Sequence[str], **sizing) -> DataFrame:
    """Left-join each row to its owner's map (one reference row per owner)."""
    return spread_join(df, reference, on, "left", **sizing)


# --- conforming --------------------------------------------------------------


def occurrences(
    df: DataFrame, keep: Sequence[str], col: str, pattern: str = DEFINITION, groups: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per match: 0-based ``pos`` and one column per named group, in text order."""
    groups = {"name": 1, "value": 2} if groups is None else groups
    lists = {n: F.regexp_extract_all(col, F.lit(pattern), g) for n, g in groups.items()}
    zipped = df.select(*keep, F.arrays_zip(*[c.alias(n) for n, c in lists.items()]).alias("__hits"))
    return zipped.select(*keep, F.posexplode("__hits").alias("pos", "__hit")).select(
        *keep, "pos", *[F.col(f"__hit.{n}") for n in groups]
    )


def conform_occurrences(occ: DataFrame, ref_col: str, name: str = "name", value: str = "value") -> DataFrame:
    """Add ``conformed`` (the reference value, else the own one) and ``known``."""
    return occ.withColumn("known", F.map_contains_key(ref_col, F.col(name))).withColumn(
        "conformed", F.coalesce(F.try_element_at(ref_col, F.col(name)), F.col(value))
    )


def definition_text(name: Column, value: Column) -> Column:
    first, middle, last = (F.lit(p) for p in DEFINITION_PARTS)
    return F.concat(first, name, middle, clean_hex(value), last)


def conform_text(
    text: Column,
    ref: Column,
    pattern: str = DEFINITION,
    name_group: int = 1,
    rewrite=definition_text,
) -> Column:
    """Rewrite every match whose name is in ``ref``; other matches and all text between stay.

    The text is cut once at the matches and joined again, so cost grows with its length and not
    with the number of reference entries.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    names = F.regexp_extract_all(text, F.lit(pattern), name_group)
    pieces = F.zip_with(
        whole,
        names,
        lambda hit, name: F.coalesce(rewrite(name, F.try_element_at(ref, name)), hit),
    )
    joined = F.zip_with(gaps, pieces, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit(""))))
    return F.when(ref.isNull() | (F.size(whole) == 0), text).otherwise(F.array_join(joined, ""))


def conform(
    df: DataFrame, col: str, ref_col: str, pattern: str = DEFINITION, name_group: int = 1, rewrite=definition_text
) -> DataFrame:
    """Replace ``col`` by its conformed text and add ``off_reference``: names without an entry,
    distinct and sorted; none where there is no reference at all."""
    names = F.regexp_extract_all(col, F.lit(pattern), name_group)
    ref = F.coalesce(F.col(ref_col), F.create_map().cast("map<string,string>"))
    off = F.array_sort(
        F.array_distinct(F.filter(names, lambda name: ~F.map_contains_key(ref, name)))
    )
    off = F.when((F.size(ref) == 0) & names.isNotNull(), F.array().cast("array<string>")).otherwise(off)
    return df.withColumn("off_reference", off).withColumn(
        col, conform_text(F.col(col), F.col(ref_col), pattern, name_group, rewrite)
    )


def conform_rows(
    df: DataFrame,
    key: Sequence[str],
    col: str,
    reference: DataFrame,
    on: Sequence[str] = (),
    name: str = "role",
    value: str = "hex",
    pattern: str = DEFINITION,
    name_group: int = 1,
    rewrite=definition_text,
    part_hits: int = PART_HITS,
    **sizing,
) -> DataFrame:
    """``conform`` against reference rows (``on``, ``name``, ``value``) of any number, one per owner and name.

    The names of each text are cut into parts of ``part_hits`` occurrences, distinct in each, and only they
    meet the reference, hot ones unshuffled. Every part comes back with the entries it uses, so a
    row carries no more of the reference than its own text names, and a lookup walks one part's entries
    however long the text is. The text moves once, to its parts, and is joined again in order from the gaps and the
    rewritten occurrences. ``key`` is unique per text; NULL keys meet, a NULL owner has no reference.
    Names without an entry go to ``off_reference``, distinct and sorted; none where the owner has no entry at
    all. An entry whose value is NULL is known and leaves the text as it is.
    """
    found = F.regexp_extract_all(col, F.lit(pattern), name_group)
    # One constant column stands for the owner of a reference that all texts share.
    owner = [*on, "__all"]
    numbers = F.sequence(F.lit(0), F.expr(f"(size(__names) - 1) div {part_hits}"))
    cut = F.transform(numbers, lambda i: F.array_distinct(F.slice("__names", i * part_hits + 1, F.lit(part_hits))))
    named = df.select(*key, *[c for c in on if c not in key], F.lit(1).alias("__all"), found.alias("__names")).filter("size(__names) > 0")
    parts = named.select(*key, *[c for c in owner if c not in key], F.posexplode(cut).alias("__part", "__some"))
    asked = materialise(parts.select(*key, *[c for c in owner if c not in key], "__part", F.explode("__some").alias("__name")))
    entries = reference.select(
        *on, F.lit(1).alias("__all"), F.col(name).alias("__name"), F.struct(F.col(value).alias("value")).alias("__entry")
    )
    owners = entries.select(*owner).distinct().withColumn("__owned", F.lit(True))
    met = spread_join(asked, entries, [*owner, "__name"], **sizing)
    known = F.collect_list(F.when(F.col("__entry").isNotNull(), F.struct(F.col("__name").alias("key"), F.col("__entry.value").alias("value"))))
    missing = F.collect_set(F.when(F.col("__entry").isNull(), F.col("__name")))
    per_part = met.groupBy(*key, *[c for c in owner if c not in key], "__part").agg(known.alias("__known"), missing.alias("__missing"))
    per_text = per_part.groupBy(*key, *[c for c in owner if c not in key]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__part", "__known"))), lambda p: F.map_from_entries(p["__known"])).alias("__maps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__missing")))).alias("__off"),
    )
    judged = spread_join(per_text, owners, owner, **sizing).select(*key, "__maps", F.when(F.col("__owned"), F.col("__off")).alias("__off"))
    held = join_null_safe(df, judged, key, "left")

    gaps, whole = F.split(col, pattern, -1), F.regexp_extract_all(col, F.lit(pattern), 0)

    def piece(hit: Column, at: Column) -> Column:
        entry = F.try_element_at(F.get("__maps", F.floor(at / part_hits).cast("int")), hit["name"])
        return F.coalesce(rewrite(hit["name"], entry), hit["text"])

    pieces = F.transform(F.arrays_zip(whole.alias("text"), found.alias("name")), piece)
    joined = F.array_join(F.zip_with(gaps, pieces, lambda gap, p: F.concat(gap, F.coalesce(p, F.lit("")))), "")
    none = F.when(F.col(col).isNotNull(), F.coalesce("__off", F.array().cast("array<string>")))
    return held.withColumns(
        {"off_reference": none, col: F.when(F.col("__maps").isNull(), F.col(col)).otherwise(joined)}
    ).drop("__maps", "__off")


def off_reference(occ: DataFrame, ref_col: str, name: str = "name") -> DataFrame:
    """Names that the reference lacks, with their counts, sorted by name."""
    return (
        occ.filter(~F.coalesce(F.map_contains_key(ref_col, F.col(name)), F.lit(False)))
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(name)
    )


def off_reference_rows(occ: DataFrame, ref: DataFrame, on: Sequence[str]) -> DataFrame:
    """The same against a reference table of any size: names are counted before the anti join,
    so the join sees each name once."""
    counted = occ.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(ref.select(*on).distinct(), list(on), "left_anti").orderBy(*on)


def first_in_reference(
    df: DataFrame, col: str, ref_col: str, pattern: str = FILL, name_group: int = 1, name: str = "background"
) -> DataFrame:
    """Add the reference value of the first match, in text order, whose name has an entry; else ''."""
    names = F.regexp_extract_all(col, F.lit("(?U)" + pattern), name_group)
    known = F.filter(names, lambda n: F.map_contains_key(ref_col, n))
    hit = F.try_element_at(ref_col, F.try_element_at(known, F.lit(1)))
    return df.withColumn(name, F.coalesce(F.ltrim(hit, F.lit("#")), F.lit("")))


def first_in_reference_rows(
    occ: DataFrame,
    keys: DataFrame,
    ref_col: str,
    key: Sequence[str],
    pos: str = "pos",
    name: str = "name",
    out: str = "background",
) -> DataFrame:
    """The same over an occurrence table: one mergeable ``min_by`` per key.

    ``keys`` lists every key once, also those without any occurrence; they get ''.
    """
    known = F.map_contains_key(ref_col, F.col(name))
    value = F.ltrim(F.try_element_at(ref_col, F.col(name)), F.lit("#"))
    found = occ.groupBy(*key).agg(F.min_by(value, F.when(known, F.col(pos))).alias(out))
    return join_null_safe(keys.select(*key), found, key, "left").select(*key, F.coalesce(out, F.lit("")).alias(out))


# --- aliases -----------------------------------------------------------------


@dataclass(frozen=True)
class Aliases:
    """Aliases with their roles, and which of them (``link``) turns to the ``muted`` role where it hardly
    differs from the ``background`` role; no fallback without a link."""

    roles: Mapping[str, str] = field(default_factory=lambda: dict(ALIAS_ROLES))
    link: str | None = LINK_ALIAS
    background: str = BACKGROUND_ROLE
    muted: str = MUTED_ROLE
    muted_default: str = LINK_DEFAULT
    least_ratio: float = LINK_RATIO


def _aliases(colour, aliases: Aliases, fallback: bool) -> list[Column]:
    found = {a: F.nullif(clean_hex(colour(role)), F.lit("")) for a, role in aliases.roles.items()}
    background = F.nullif(clean_hex(colour(aliases.background)), F.lit(""))
    if fallback and aliases.link is not None:
        link = found[aliases.link]
        close = contrast(luminance(link), luminance(background)) < aliases.least_ratio
        muted = clean_hex(F.coalesce(colour(aliases.muted), F.lit(aliases.muted_default)))
        found[aliases.link] = F.when(link.isNotNull() & background.isNotNull() & close, muted).otherwise(link)
    return [c.alias(a) for a, c in found.items()]


def alias_columns(df: DataFrame, colours_col: str, fallback: bool = True, aliases: Aliases = Aliases()) -> DataFrame:
    """Add one column per alias from a palette map; empty roles give NULL. The link alias turns
    to muted when it hardly differs from the background."""
    return df.select(
        "*", *_aliases(lambda role: F.try_element_at(colours_col, F.lit(role)), aliases, fallback)
    )


def pivot_alias(
    palette: DataFrame,
    by: Sequence[str],
    role: str = "role",
    value: str = "hex",
    fallback: bool = True,
    aliases: Aliases = Aliases(),
) -> DataFrame:
    """The same from palette rows: a pivot over the fixed role list, one partial aggregate."""
    needed = sorted({*aliases.roles.values(), aliases.background, aliases.muted})
    wide = palette.groupBy(*by).agg(
        *[F.max(F.when(F.col(role) == r, F.col(value))).alias(f"__{r}") for r in needed]
    )
    return wide.select(*by, *_aliases(lambda r: F.col(f"__{r}"), aliases, fallback))


# --- layers and reconciliation -----------------------------------------------


def layered(mode: str, *layers: Column) -> Column:
    """First layer with a value. ``not_null`` asks for a value, ``truthy`` also skips a zero of any
    numeric type, the empty string and false; the text '0' is a value."""
    if mode == "truthy":
        def held(c: Column) -> Column:
            text = c.cast("string")
            other = F.coalesce(text.try_cast("double") != 0, text != "false")
            return F.when(F.when(F.typeof(c) == "string", text != "").otherwise(other), c)

        return F.coalesce(*[held(c) for c in layers[:-1]], layers[-1])
    return F.coalesce(*layers)


def layered_maps(keys: Sequence[str], *layers: str) -> Column:
    """Merged settings of several map columns: the first layer that *has* a key wins, even where
    its value is NULL."""
    def pick(key: str) -> Column:
        choice = F.when(F.lit(False), F.lit(None).cast("string"))
        for layer in layers:
            choice = choice.when(F.map_contains_key(layer, F.lit(key)), F.try_element_at(layer, F.lit(key)))
        return choice

    return F.struct(*[pick(k).alias(k) for k in keys])


def layered_defaults(
    base: DataFrame,
    layers: Sequence[DataFrame],
    on: Sequence[str],
    column: str,
    default,
    mode: str = "not_null",
    **sizing,
) -> DataFrame:
    """Add ``column``: the value of the first table in ``layers`` (one row per key) that has one,
    else the value ``base`` itself holds under that name, else ``default``."""
    joined, names = base, []
    hot = hot_keys(base, on, **sizing)
    for i, layer in enumerate(layers):
        name = f"__layer_{i}"
        joined = spread_join(joined, layer.select(*on, F.col(column).alias(name)), on, "left", hot=hot)
        names.append(name)
    stack = [F.col(n) for n in names] + ([F.col(column)] if column in base.columns else [])
    return joined.withColumn(column, layered(mode, *stack, F.lit(default))).drop(*names)


def reconcile(
    src: DataFrame,
    tgt: DataFrame,
    inventory: DataFrame,
    on_target: Sequence[str],
    on_inventory: Sequence[str],
    **sizing,
) -> DataFrame:
    """Add ``status`` to every source row: ``no_target``, then ``missing_source``, else ``ok``.

    Targets and inventory are reduced to distinct keys before the joins; keys only they have are
    ignored.
    """
    targets = tgt.select(*on_target).distinct().withColumn("__target", F.lit(True))
    held = inventory.select(*on_inventory).distinct().withColumn("__held", F.lit(True))
    hot = [hot_keys(src, on, **sizing) for on in (on_target, on_inventory)]
    matched = spread_join(src, targets, on_target, hot=hot[0])
    joined = spread_join(matched, held, on_inventory, hot=hot[1])
    return joined.withColumn(
        "status",
        F.when(F.col("__target").isNull(), "no_target")
        .when(F.col("__held").isNull(), "missing_source")
        .otherwise("ok"),
    ).drop("__target", "__held")


def reconcile_maps(df: DataFrame, src_col: str, tgt_col: str) -> DataFrame:
    """Pair two manifest maps of a row: one output row per source key with ``source`` and
    ``target`` paths, target NULL when absent or empty."""
    kept = [c for c in df.columns if c not in (src_col, tgt_col)]

    def pair(entry: Column) -> Column:
        target = F.try_element_at(tgt_col, entry["key"])
        return F.struct(
            entry["key"].alias("key"), entry["value"].alias("source"), F.when(target != "", target).alias("target")
        )

    return df.select(*kept, F.inline(F.transform(F.map_entries(src_col), pair)))


def manifest_status(manifest: DataFrame, inventory: DataFrame, path: str = "path", **sizing) -> DataFrame:
    """Status of paired manifest rows against an inventory of existing source paths."""
    held = inventory.select(F.col(path).alias("source")).distinct().withColumn("__held", F.lit(True))
    return (
        spread_join(manifest, held, ["source"], **sizing)
        .withColumn(
            "status",
            F.when(F.col("target").isNull(), "no_target")
            .when(F.col("__held").isNull(), "missing_source")
            .otherwise("ok"),
        )
        .drop("__held")
    )


def status_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))
