import pytest
from pyspark.sql import functions as F

from assayline.operators.blocks import (
    COVER_MARKER,
    cover_rules,
    extract_balanced,
    parse_annotation,
    rule_report,
    suspect_numbers,
    validate_rules,
)

MACROS = r"\BookTitle \BookSubtitle \BookDescription \BookAuthor \BookDate \BookVersion"
GOOD = (
    COVER_MARKER
    + "{%\n"
    + "\\definecolor{bg_primary}{HTML}{201F1E}\n\\definecolor{light}{HTML}{FFFFFF}\n"
    + "\\begin{tikzpicture}[remember picture]\n\\fill[bg_primary] (-1,-1) rectangle (22,31);\n"
    + "% LOGO_PLACEMENT x=1.5 y=26.5 height=2.0 bg=bg_primary\n"
    + MACROS
    + "\n\\end{tikzpicture}%\n}"
)


@pytest.mark.parametrize(
    "text, status",
    [
        (GOOD, "ok"),
        ("```latex\n" + GOOD + "\n```", "ok"),
        ("```tex\n" + GOOD + "\n```", "ok"),
        ("Here is some prose.", "not_found"),
        (GOOD[:-1], "truncated"),
        (COVER_MARKER + "{a {b {c} d} e} tail", "ok"),
        (COVER_MARKER + " % \n{x}", "ok"),
        (COVER_MARKER + " % note {x}", "not_found"),
        (COVER_MARKER + r"{\{}", "truncated"),
        (COVER_MARKER + r"{\}", "ok"),
        (COVER_MARKER, "not_found"),
        (COVER_MARKER + "[1] " + COVER_MARKER + "{x}", "not_found"),
        ("", "not_found"),
    ],
)
def test_extract_status(spark, text, status):
    row = extract_balanced(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    assert row.status == status
    assert (row.block is not None) == (status == "ok")
    if row.block:
        assert "```" not in row.block
        assert row.block.startswith(COVER_MARKER) and row.block.endswith("}")


def test_extract_stops_at_matching_brace(spark):
    text = "é" + COVER_MARKER + " %\n{a{b}c}{d}"
    row = extract_balanced(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    assert row.block == COVER_MARKER + " %\n{a{b}c}"


def rules_of(spark, block):
    df = spark.createDataFrame([(block,)], "block string")
    return {w.rule: w.message for w in validate_rules(df, cover_rules("block")).first().warnings}


def test_valid_block_has_no_warning(spark):
    assert rules_of(spark, GOOD) == {}


@pytest.mark.parametrize(
    "change, rule",
    [
        (("\\begin{tikzpicture}", ""), "begin"),
        (("\\end{tikzpicture}", ""), "end"),
        (("% LOGO_PLACEMENT", "%LOGO_PLACEMENT"), "annotation"),
        (("bg=bg_primary", "bg=dark"), "annotation_role"),
        (("bg=bg_primary", "bg=Bg_Primary"), "annotation_role"),
        (("(22,31)", "(1920,1080)"), "range"),
    ],
)
def test_one_fault_one_warning(spark, change, rule):
    assert list(rules_of(spark, GOOD.replace(*change))) == [rule]


def test_missing_macros_make_one_warning(spark):
    found = rules_of(spark, GOOD.replace("\\BookTitle ", "").replace("\\BookDate ", ""))
    assert list(found) == ["macros"]
    assert "\\BookTitle" in found["macros"] and "\\BookDate" in found["macros"]


def test_macro_test_is_a_substring_test(spark):
    assert rules_of(spark, GOOD.replace("\\BookTitle ", "\\BookTitleX ")) == {}


def test_role_check_is_silent_without_declarations_and_across_lines(spark):
    bare = GOOD.replace("\\definecolor", "\\other").replace("bg=bg_primary", "bg=dark")
    assert rules_of(spark, bare) == {}
    split = GOOD.replace("height=2.0 bg=bg_primary", "height=2.0\nbg=dark")
    assert rules_of(spark, split) == {}


def test_rule_report(spark):
    df = spark.createDataFrame([("x",), (GOOD,)], "block string")
    report = {r.rule: r.n for r in rule_report(validate_rules(df, cover_rules("block"))).collect()}
    assert report == {"begin": 1, "end": 1, "annotation": 1, "macros": 1}


def test_suspect_numbers_guard_only_the_first_digit(spark):
    df = spark.createDataFrame([("{1920} 3.7125 x1920 (201) 150 151 arc (0:360:5)",)], "t string")
    row = suspect_numbers(df, "t").first()
    assert row.suspects == ["920", "7125", "920", "201", "151"]


def test_suspect_numbers_keep_all_but_show_five(spark):
    df = spark.createDataFrame([(" ".join(str(n) for n in range(200, 210)),)], "t string")
    row = suspect_numbers(df, "t").first()
    assert len(row.suspects) == 10 and row.first_suspects == ["200", "201", "202", "203", "204"]


def test_suspect_numbers_ignore_colour_definitions(spark):
    df = spark.createDataFrame([(r"\definecolor{c}{HTML}{201999}",)], "t string")
    assert suspect_numbers(df, "t").first().suspects == []


def test_suspect_numbers_read_other_digits(spark):
    df = spark.createDataFrame([("(٣٢١)",)], "t string")
    assert suspect_numbers(df, "t").first().suspects == ["٣٢١"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("% LOGO_PLACEMENT x=1.5 y=26.5 height=2.0 bg=bg_primary", (1.5, 26.5, 2.0, "bg_primary")),
        ("%LOGO_PLACEMENT x=1 y=26 height=3 bg=light", (1.0, 26.0, 3.0, "light")),
        ("% LOGO_PLACEMENT y=1 x=2 height=3 bg=light", None),
        ("% LOGO_PLACEMENT x=-1 y=2 height=3 bg=light", None),
        ("nothing", None),
    ],
)
def test_parse_annotation(spark, text, want):
    row = parse_annotation(spark.createDataFrame([(text,)], "b string"), "b").first()
    assert (tuple(row.placement) if row.placement else None) == want


def test_annotation_of_null(spark):
    df = spark.createDataFrame([(None,)], "b string")
    assert parse_annotation(df, "b").first().placement is None
    assert extract_balanced(df, "b").select(F.col("status")).first().status == "not_found"
