"""Text helpers with the whitespace, digit and line rules of the artifacts' origin."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace here includes the four ASCII separators, which Java's \s leaves out.
_SPACE = r"[\s\x1c-\x1f]"

# Decimal digits outside ASCII, paired with their values, for number parsing.
_DIGITS = [
    (chr(cp), str(unicodedata.decimal(chr(cp))))
    for cp in range(128, sys.maxunicode + 1)
    if unicodedata.category(chr(cp)) == "Nd"
]
_WIDE_DIGITS = "".join(d for d, _ in _DIGITS)
_PLAIN_DIGITS = "".join(v for _, v in _DIGITS)


def strip_space(col: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(col, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def strip_fences(col: Column, languages: tuple[str, ...] = ("latex", "tex")) -> Column:
    """Remove code fences wherever they stand, with the language tag and space after an opener."""
    tags = "|".join(languages)
    opened = F.regexp_replace(col, rf"(?U)```(?:{tags})?{_SPACE}*", "")
    return F.when(F.contains(col, F.lit("```")), F.replace(opened, F.lit("```"), F.lit(""))).otherwise(col)


def unwrap_fence(col: Column, language: str = "json") -> Column:
    """Contents of a text that is one fenced block as a whole; other texts only lose outer space."""
    text = strip_space(col)
    pattern = rf"(?sU)\A```(?:{language})?{_SPACE}*(.*?){_SPACE}*```\z"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def pascal_case(col: Column) -> Column:
    words = F.split(F.replace(col, F.lit("-"), F.lit("_")), "_")
    capital = F.transform(
        words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 2**31 - 1)))
    )
    return F.array_join(capital, "")


def to_number(col: Column) -> Column:
    """Digits of any script to DOUBLE; NULL when the text is no number."""
    return F.translate(col, _WIDE_DIGITS, _PLAIN_DIGITS).try_cast("double")


def rounded(col: Column, places: int) -> Column:
    """A double to so many places by plain double arithmetic, halves up, as any engine does it."""
    scale = float(10**places)
    return F.floor(col * scale + 0.5) / scale


def plain_number(col: Column) -> Column:
    """A double as text, without a decimal part when it is whole."""
    whole = F.floor(col)
    return F.when(col == whole, whole.cast("bigint").cast("string")).otherwise(col.cast("string"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once and stands once in the plan, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def binary_round(col: Column, places: int) -> Column:
    """``col`` times 10**places as a whole number: the binary value rounded, exact halves to even.

    Only where the product comes out as a half can its own rounding hide the side; splitting the
    value in two parts, each with few bits, then gives the product's error.
    """
    scale = float(10**places)

    def parts(c: Column) -> Column:
        upper = c * 134217729.0 - (c * 134217729.0 - c)
        return F.struct(c.alias("c"), (c * scale).alias("product"), F.floor(c * scale).alias("whole"), upper.alias("upper"))

    def settled(v: Column) -> Column:
        error = (v["upper"] * scale - v["product"]) + (v["c"] - v["upper"]) * scale
        rest = v["product"] - v["whole"]
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (v["whole"] % 2 != 0))))
        return v["whole"] + F.when(up, 1).otherwise(0)

    return bind(bind(col, parts), settled)


def short_number(col: Column) -> Column:
    """Round to three places, show at most six significant digits, drop trailing zeros.

    Both roundings look at the binary value, with halves to the even digit.
    """

    def fixed(value: Column, places: int) -> Column:
        def written(digits: Column) -> Column:
            head = F.floor(digits / 10**places).cast("string")
            tail = F.lpad((digits % 10**places).cast("string"), places, "0")
            return F.concat(F.when(value < 0, "-").otherwise(""), head, *([F.lit("."), tail] if places else []))

        return bind(F.abs(binary_round(value, places)), written)

    def of(v: Column) -> Column:
        number, value = v["number"], v["value"]
        size = F.abs(value)
        text = (
            F.when(size < 1000, fixed(number, 3))
            .when(size < 10000, fixed(value, 2))
            .when(size < 100000, fixed(value, 1))
            .when(size < 999999.5, fixed(value, 0))
        )
        trimmed = bind(text, lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t))
        mantissa = F.regexp_replace(F.format_string("%.5e", number), r"\.?0+e", "e")
        return F.when(size < 999999.5, trimmed).otherwise(mantissa)

    return bind(bind(col, lambda c: F.struct(c.alias("number"), (binary_round(c, 3) / 1000.0).alias("value"))), of)


# Beyond \n, a line also ends at these; \r\n counts as one end.
_OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_ENDS = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def split_lines(col: Column) -> Column:
    """All lines of a text; a final line end opens no extra line.

    Most texts hold newlines only, and cutting at one literal is several times faster than at a
    pattern, so the pattern is kept for texts that need it.
    """
    unusual = F.contains(col, F.lit(_OTHER_ENDS[0]))
    for end in _OTHER_ENDS[1:]:
        unusual = unusual | F.contains(col, F.lit(end))
    parts = F.when(unusual, F.split(col, r"\r\n|\n|" + LINE_ENDS, -1)).otherwise(F.split(col, "\n", -1))
    return bind(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
