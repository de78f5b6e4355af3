"""License scan of responses by ordered signatures, in DataFrame functions only.

A text is reduced to its words; signatures are patterns over whole words. A signature is tried only
on texts that hold its keyword, and only after a cheap test for any keyword at all. Detections
are word intervals; one that lies inside another of the same or a better priority is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayline.llm.common import quoted, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Signature:
    """``pattern`` over lower-case words with single spaces, tried where one of ``keywords`` occurs; ``priority`` 1 is best."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    relevance: float
    base: bool = False


# Phrases and labels of the base scan.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

VERSION = "(?: v| version)?"

# Label, name as written in notices (a pattern over words), keywords of which any such name holds one, and
# the words of its identifier. Identifiers are split into words as texts are: dots and hyphens go.
LICENSES = (
    ("gpl-1.0", f"gnu general public licen[cs]e{VERSION} 1(?: 0)?", "general public", "gpl 1 0"),
    ("gpl-2.0", f"gnu general public licen[cs]e{VERSION} 2(?: 0)?", "general public", "gpl 2 0"),
    ("gpl-3.0", f"gnu general public licen[cs]e{VERSION} 3(?: 0)?", "general public", "gpl 3 0"),
    ("lgpl-2.0", f"gnu library general public licen[cs]e(?:{VERSION} 2(?: 0)?)?", "general public", "lgpl 2 0"),
    ("lgpl-2.1", f"gnu lesser general public licen[cs]e{VERSION} 2 1", "general public", "lgpl 2 1"),
    ("lgpl-3.0", f"gnu lesser general public licen[cs]e{VERSION} 3(?: 0)?", "general public", "lgpl 3 0"),
    ("agpl-1.0", f"affero general public licen[cs]e{VERSION} 1(?: 0)?", "affero", "agpl 1 0"),
    ("agpl-3.0", f"gnu affero general public licen[cs]e(?:{VERSION} 3(?: 0)?)?", "affero", "agpl 3 0"),
    ("gfdl-1.1", f"gnu free documentation licen[cs]e{VERSION} 1 1", "free documentation", "gfdl 1 1"),
    ("gfdl-1.2", f"gnu free documentation licen[cs]e{VERSION} 1 2", "free documentation", "gfdl 1 2"),
    ("gfdl-1.3", f"gnu free documentation licen[cs]e{VERSION} 1 3", "free documentation", "gfdl 1 3"),
    ("apache-1.0", f"apache (?:software )?licen[cs]e{VERSION} 1 0", "apache", "apache 1 0"),
    ("apache-1.1", f"apache (?:software )?licen[cs]e{VERSION} 1 1", "apache", "apache 1 1"),
    ("apache-2.0", f"apache (?:software )?licen[cs]e{VERSION} 2(?: 0)?", "apache", "apache 2 0"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit no", "mit 0"),
    ("mit", "(?:the )?mit(?: x11)? licen[cs]e", "mit", "mit"),
    ("x11", "x11 licen[cs]e", "x11", "x11"),
    ("bsd-1-clause", "bsd (?:1|one) clause licen[cs]e", "bsd", "bsd 1 clause"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd (?:2|two) clause) licen[cs]e", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd (?:3|three) clause) licen[cs]e", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd (?:4|four) clause) licen[cs]e", "bsd", "bsd 4 clause"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd) licen[cs]e", "bsd", "0bsd"),
    ("isc", "isc licen[cs]e", "isc", "isc"),
    ("mpl-1.0", f"mozilla public licen[cs]e{VERSION} 1 0", "mozilla", "mpl 1 0"),
    ("mpl-1.1", f"mozilla public licen[cs]e{VERSION} 1 1", "mozilla", "mpl 1 1"),
    ("mpl-2.0", f"mozilla public licen[cs]e{VERSION} 2(?: 0)?", "mozilla", "mpl 2 0"),
    ("epl-1.0", f"eclipse public licen[cs]e{VERSION} 1 0", "eclipse", "epl 1 0"),
    ("epl-2.0", f"eclipse public licen[cs]e{VERSION} 2(?: 0)?", "eclipse", "epl 2 0"),
    ("edl-1.0", "eclipse distribution licen[cs]e(?: v| version)?(?: 1 0)?", "eclipse", "edl 1 0"),
    ("cddl-1.0", f"common development and distribution licen[cs]e{VERSION} 1 0", "common development", "cddl 1 0"),
    ("cddl-1.1", f"common development and distribution licen[cs]e{VERSION} 1 1", "common development", "cddl 1 1"),
    ("cpl-1.0", f"common public licen[cs]e(?:{VERSION} 1 0)?", "common public", "cpl 1 0"),
    ("cpal-1.0", f"common public attribution licen[cs]e(?:{VERSION} 1 0)?", "common public", "cpal 1 0"),
    ("ipl-1.0", f"ibm public licen[cs]e(?:{VERSION} 1 0)?", "ibm public", "ipl 1 0"),
    ("eupl-1.1", f"european union public licen[cs]e{VERSION} 1 1", "european union", "eupl 1 1"),
    ("eupl-1.2", f"european union public licen[cs]e{VERSION} 1 2", "european union", "eupl 1 2"),
    ("osl-3.0", f"open software licen[cs]e(?:{VERSION} 3(?: 0)?)?", "open software", "osl 3 0"),
    ("afl-3.0", f"academic free licen[cs]e(?:{VERSION} 3(?: 0)?)?", "academic free", "afl 3 0"),
    ("ecl-2.0", f"educational community licen[cs]e(?:{VERSION} 2(?: 0)?)?", "educational community", "ecl 2 0"),
    ("artistic-1.0", f"artistic licen[cs]e{VERSION} 1 0", "artistic", "artistic 1 0"),
    ("artistic-2.0", f"artistic licen[cs]e{VERSION} 2(?: 0)?", "artistic", "artistic 2 0"),
    ("bsl-1.0", "boost software licen[cs]e(?: v| version)?(?: 1 0)?", "boost", "bsl 1 0"),
    ("busl-1.1", "business source licen[cs]e(?: v| version)?(?: 1 1)?", "business source", "busl 1 1"),
    ("sspl-1.0", "server side public licen[cs]e(?: v| version)?(?: 1(?: 0)?)?", "server side", "sspl 1 0"),
    ("elastic-2.0", "elastic licen[cs]e(?: v| version)?(?: 2(?: 0)?)?", "elastic", "elastic 2 0"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "what the fuck", "wtfpl"),
    ("zlib", "zlib licen[cs]e", "zlib", "zlib"),
    ("libpng", "libpng licen[cs]e", "libpng", "libpng 2 0"),
    ("ijg", "independent jpeg group licen[cs]e", "jpeg", "ijg"),
    ("openssl", "openssl licen[cs]e", "openssl", "openssl"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "postgresql"),
    ("php-3.01", "php licen[cs]e(?: v| version)?(?: 3(?: 01)?)?", "php", "php 3 01"),
    ("psf-2.0", "(?:python software foundation|psf) licen[cs]e(?: v| version)?(?: 2(?: 0)?)?", "licen", "psf 2 0"),
    ("ruby", "ruby licen[cs]e", "ruby", "ruby"),
    ("perl", "same terms as perl itself", "perl", "artistic 1 0 perl"),
    ("tcl", "tcl tk licen[cs]e", "tcl", "tcl"),
    ("lppl-1.3c", "latex project public licen[cs]e(?: v| version)?(?: 1 3c?)?", "latex project", "lppl 1 3c"),
    ("ofl-1.1", "(?:sil )?open font licen[cs]e(?: v| version)?(?: 1 1)?", "open font", "ofl 1 1"),
    ("ncsa", "university of illinois (?:ncsa )?open source licen[cs]e", "illinois", "ncsa"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft", "ms pl"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft", "ms rl"),
    ("upl-1.0", "universal permissive licen[cs]e(?: v| version)?(?: 1 0)?", "universal permissive", "upl 1 0"),
    ("blueoak-1.0", "blue oak model licen[cs]e(?: 1 0 0)?", "blue oak", "blueoak 1 0 0"),
    ("mulanpsl-2.0", "mulan permissive software licen[cs]e(?: v| version)?(?: ?2)?", "mulan", "mulanpsl 2 0"),
    ("odbl-1.0", "open (?:data commons open )?database licen[cs]e(?: v1 0| 1 0)?", "database", "odbl 1 0"),
    ("odc-by-1.0", "open data commons attribution licen[cs]e(?: v1 0| 1 0)?", "data commons", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication and licen[cs]e(?: v1 0| 1 0)?", "public domain", "pddl 1 0"),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: v?1 0)?(?: universal)?", "cc0|creative commons", "cc0 1 0"),
    ("cc-by-2.0", "(?:cc by|creative commons attribution) 2 0", "cc by|creative commons", "cc by 2 0"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution) 3 0", "cc by|creative commons", "cc by 3 0"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution)(?: international)? 4 0(?: international)?", "cc by|creative commons", "cc by 4 0"),
    ("cc-by-sa-3.0", "(?:cc by sa|creative commons attribution share ?alike) 3 0", "cc by|creative commons", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "(?:cc by sa|creative commons attribution share ?alike)(?: international)? 4 0", "cc by|creative commons", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "(?:cc by nc|creative commons attribution non ?commercial)(?: international)? 4 0", "cc by|creative commons", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: international)? 4 0", "cc by|creative commons", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: international)? 4 0", "cc by|creative commons", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: international)? 4 0", "cc by|creative commons", "cc by nc nd 4 0"),
)

# Notices that name no license of the table above by its title.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee", 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 0.95),
    ("gpl", "(?:free software )?you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute it", 0.95),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "general public", 0.8),
    ("gpl", "gnu gpl", "gpl", 0.6),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.95),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable", "as is", 0.9),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 0.6),
    ("proprietary", "all rights reserved", "rights reserved", 0.3),
    ("copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", "copyright", 0.2),
)


def signatures() -> tuple[Signature, ...]:
    """All signatures in their order: base phrases, identifiers, titles, references, notices.

    Each license gives four patterns: its tag, its title, a grant under it and its short name followed by
    the word license.
    """
    found = [Signature(label, phrase, (phrase,), 2, 0.7, base=True) for phrase, label in BASE_PHRASES]
    for label, title, keyword, words in LICENSES:
        names = tuple(keyword.split("|"))
        grant = f"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:{title}|{words})"
        found += [
            Signature(label, f"spdx licen[cs]e identifier {words}(?: only| or later)?", ("spdx",), 1, 1.0),
            Signature(label, grant, (*names, words), 1, 1.0),
            Signature(label, title, names, 2, 0.8),
            Signature(label, f"{words} licen[cs]e", (words,), 2, 0.7),
        ]
    return tuple(found + [Signature(label, pattern, (keyword,), 1 if r > 0.9 else 3, r) for label, pattern, keyword, r in NOTICES])


# Every text with a detection holds one of these; tried before any signature.
GATE = (
    "licen[cs]|(?:released|distributed|available) under|cc by|cc0|spdx|copyright|creative commons|public domain|rights reserved|hereby granted"
    "|gnu gpl|redistribut|with or without fee|unencumbered|provided as is|perl itself|no attribution"
)


def words_line(raw: str) -> Column:
    """The words in lower case, each between single spaces, with one space at both ends."""
    text = F.translate(whole_text(raw), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NOT_WORD, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan_licenses(responses: DataFrame, *, key: str = "request_id", raw: str = "raw", rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """One row per row of ``responses``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base counts and positions (words from 0) take all places of base phrases; ``labels`` holds their labels
    and those of the detections that remain after suppression, distinct, sorted and comma-joined. ``score``
    is the best relevance that remains, 0 without any. A null text counts as empty: no words, null
    positions, empty labels. Repeated rows are judged each. Only word counts leave the task that
    reads a text; detections of one text meet again under the row's own number.
    """
    rules = signatures() if rules is None else rules
    table = F.array(
        *(
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
                F.array(*map(F.lit, r.keywords)).alias("keywords"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.relevance).alias("relevance"),
                F.lit(r.base).alias("base"),
            )
            for i, r in enumerate(rules)
        )
    )
    lines = responses.select(quoted(key).alias(key), F.monotonically_increasing_id().alias("row"), words_line(raw).alias("line"))
    n_words = F.when(F.length("line") <= 2, F.lit(0)).otherwise(spaces(F.col("line")) - 1).cast("long")
    tried = F.when(F.col("line").rlike(GATE), F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("line"), k))))
    one = lines.select(key, "row", "line", n_words.alias("n_words"), F.explode_outer(tried).alias("r"))
    parts = one.withColumns(
        {
            "gaps": F.when(F.col("r").isNotNull(), F.transform(F.split("line", F.col("r.pattern"), -1), spaces)),
            "hits": F.when(F.col("r").isNotNull(), F.transform(F.regexp_extract_all("line", F.col("r.pattern"), F.lit(0)), spaces)),
        }
    ).drop("line")
    zipped = F.when(F.size("hits") > 0, F.arrays_zip(F.slice("gaps", 1, F.size("hits")).alias("gap"), F.col("hits").alias("hit")))
    places = parts.select(key, "row", "n_words", "r.rule", "r.label", "r.priority", "r.relevance", "r.base", F.posexplode_outer(zipped).alias("n", "z"))
    # One line per text and a few per detection; all windows below share this exchange.
    places = places.select("*", F.col("z.gap").alias("gap"), F.col("z.hit").alias("hit")).drop("z").repartition("row")
    along = Window.partitionBy("row", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.col("hit")).over(along) - F.col("hit") - 1
    placed = places.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.col("hit") + 1).cast("long"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    reach = F.lit(None).cast("long")
    for level in levels:
        reach = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") <= level, F.col("end"))).over(before)).otherwise(reach)
    judged = placed.withColumn("stays", F.col("start").isNotNull() & F.coalesce(F.col("end") > reach, F.lit(True)))
    is_base = F.coalesce("base", F.lit(False)) & F.col("start").isNotNull()
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        judged.groupBy("row")
        .agg(
            F.any_value(key).alias(key),
            F.any_value("n_words").alias("n_words"),
            F.count_if(is_base).alias("n_base"),
            F.min(F.when(is_base, F.col("start"))).alias("first_word"),
            F.max(F.when(is_base, F.col("start"))).alias("last_word"),
            joined(is_base).alias("base_labels"),
            joined(is_base | F.col("stays")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("stays"), F.col("relevance"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
