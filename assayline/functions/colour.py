"""Colour helpers: hex tests, relative luminance, contrast and blending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a colour and the luminance formula of WCAG 2.1.
HEX6_PATTERN = r"^#?[0-9A-Fa-f]{6}$"
HEX_PATTERN = r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"
LINEAR_LIMIT = 0.04045
LINEAR_SLOPE = 12.92
GAMMA_SHIFT = 0.055
GAMMA = 2.4
RED_WEIGHT = 0.2126
GREEN_WEIGHT = 0.7152
BLUE_WEIGHT = 0.0722
CONTRAST_SHIFT = 0.05


def is_hex(col: Column) -> Column:
    return col.rlike(HEX_PATTERN)


def clean_hex(col: Column) -> Column:
    """Upper case without leading hash signs."""
    return F.upper(F.ltrim(col, F.lit("#")))


def full_hex(col: Column) -> Column:
    """Six upper-case digits from #RGB or #RRGGBB."""
    digits = clean_hex(col)
    return F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)


def channels(hex_col: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue, 0 to 255, from one base conversion."""
    number = F.conv(F.substring(clean_hex(hex_col), 1, 6), 16, 10).cast("int")
    return (
        F.shiftright(number, 16),
        F.shiftright(number, 8).bitwiseAND(F.lit(255)),
        number.bitwiseAND(F.lit(255)),
    )


def linear(channel: Column) -> Column:
    """An sRGB channel in 0..1, linearised."""
    return F.when(channel <= LINEAR_LIMIT, channel / LINEAR_SLOPE).otherwise(
        F.pow((channel + GAMMA_SHIFT) / (1 + GAMMA_SHIFT), F.lit(GAMMA))
    )


def luminance(hex_col: Column) -> Column:
    red, green, blue = (linear(c / F.lit(255.0)) for c in channels(hex_col))
    return RED_WEIGHT * red + GREEN_WEIGHT * green + BLUE_WEIGHT * blue


def contrast(lum_a: Column, lum_b: Column) -> Column:
    """Contrast ratio of two luminances, 1 to 21."""
    return (F.greatest(lum_a, lum_b) + CONTRAST_SHIFT) / (F.least(lum_a, lum_b) + CONTRAST_SHIFT)


def blend(base: Column, toward: Column, share: float) -> Column:
    """Mix two colours; halves round to even."""
    mixed = [
        F.rint(b * F.lit(1 - share) + t * F.lit(share)).cast("int")
        for b, t in zip(channels(base), channels(toward))
    ]
    number = F.shiftleft(mixed[0], 16) + F.shiftleft(mixed[1], 8) + mixed[2]
    return F.lpad(F.hex(number), 6, "0")
