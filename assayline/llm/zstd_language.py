"""Language identification by compression against dictionaries of known texts.

One raw-content zstandard dictionary per language is filled with texts of that language. A text
belongs to the language whose dictionary leaves it smallest: sequences that the dictionary holds
cost a reference, all others are spelt out. So that very short texts count too, each text is written
behind short primers of the language, which set the coder's letter costs, and the primers' own
size is taken off. Only runs of letters count, in lower case.

A language that was not learned leaves every text about equally large, and larger than texts of known
languages get. Some of the sample is therefore kept out of the dictionaries and tells how many bits a letter
costs at each length; a text above that which no language fits clearly better is rejected.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayline.llm.common import fresh, quoted

UNDETERMINED = "und"
LEVEL = 5  # of compression
# Two primers of this many bytes each follow the dictionary in what is learned.
PRIMER_BYTES, PRIMERS = 1024, 2
LETTERS = re.compile(r"[^\W\d_]+")
# Every such text of a language's sample measures costs and is in no dictionary.
MEASURE_EVERY = 4
# What a known language may cost above the dearest measured text of its length.
SLACK = 1.1
# Bits a letter, beyond what sizes waver by, that the best language must lead by where the text costs more than that.
CLEAR_BITS = 1.0
# Bytes, over all primers, by which sizes waver: they are whole bytes.
LEAST_BYTES = 3


class Dictionaries(dict[str, bytes]):
    """Content by language; ``bounds`` holds the bits a letter that texts of known languages cost at most, by ``length_class``."""

    bounds: dict[int, float]


def length_class(words: bytes) -> int:
    return len(words).bit_length()


def letters_only(raw: str | None) -> bytes:
    """Lower-cased words of letters, one space between them; empty for null."""
    return " ".join(LETTERS.findall((raw or "").lower())).encode("utf-8", "replace")


def learn_dictionaries(
    responses: DataFrame,
    *,
    key: str = "request_id",
    raw: str = "raw",
    lang: str = "lang",
    texts_per_language: int = 400,
    text_bytes: int = 16_384,
    dictionary_bytes: int = 131_072,
) -> Dictionaries:
    """Dictionary content per value of ``lang`` and cost bounds, from the labelled rows of ``responses``.

    The sample is bounded: of each language's rows about four times ``texts_per_language`` by a hash of
    their key, and of these the ``texts_per_language`` that come first, texts of at most ``text_bytes``
    before longer ones; the dictionary ends at ``dictionary_bytes``, the primers follow. Every fourth of them is
    left out and measured. Only these rows reach the driver, each cut to what a dictionary can hold. Rows
    without a label, without a text or without letters teach nothing; rows that repeat a key count once. An
    empty table gives no dictionary.
    """
    rows = responses.select(
        F.xxhash64(quoted(key)).alias("h"),
        (F.octet_length(quoted(raw)) > text_bytes).cast("int").alias("long"),
        quoted(lang).cast("string").alias("lang"),
        quoted(raw).alias("raw"),
    ).filter(F.col("lang").isNotNull() & F.col("raw").rlike(r"\p{L}"))
    # One row per label. A cut by hash leaves about four times the sample for the ranking.
    counts = rows.groupBy("lang").agg(F.count("*").alias("of_lang"))
    near = F.pmod("h", F.lit(1 << 40)) < F.lit(4.0 * texts_per_language * (1 << 40)) / F.col("of_lang")
    first = Window.partitionBy("lang").orderBy("long", "h")
    picked = (
        rows.select("lang", "long", "h")
        .join(F.broadcast(counts), "lang")
        .filter(near)
        .select("lang", "long", "h")
        .distinct()
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= texts_per_language)
        .select("lang", "h")
    )
    most = dictionary_bytes + PRIMERS * PRIMER_BYTES
    # The picked keys are at most texts_per_language for each label.
    cut = F.left(F.min("raw"), F.lit(most)).alias("raw")
    sample = rows.join(F.broadcast(picked), ["lang", "h"], "left_semi").groupBy("lang", "h", "long").agg(cut)
    content, measured, seen = Dictionaries(), [], Counter()
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["long"], r["h"])):
        lang, words = row["lang"], letters_only(row["raw"])
        held = content.setdefault(lang, b"")
        seen[lang] += 1
        if seen[lang] % MEASURE_EVERY == 0:
            measured.append(words)
        elif len(held) < most:
            content[lang] = (held + words + b" ")[:most]
    content.bounds = cost_bounds(content, measured)
    return content


def cost_bounds(content: dict[str, bytes], measured: list[bytes], level: int = LEVEL) -> dict[int, float]:
    """Bits a letter of the dearest measured text of each length class or a longer one, and some slack.

    Shorter texts cost more a letter, so each bound also serves the shorter classes that have no text.
    """
    dearest: dict[int, float] = {}
    coders = compressors(content, level)
    for words in filter(None, measured):
        size = max(min(coder.size(words) for coder in coders), 0)
        at = length_class(words)
        dearest[at] = max(dearest.get(at, 0.0), 8 * size / len(words))
    bounds, bound = {}, 0.0
    for at in range(max(dearest, default=0), 0, -1):
        bound = max(bound, dearest.get(at, 0.0))
        bounds[at] = SLACK * bound
    return bounds


# Of the latest call that a worker has seen.
_CODERS: dict[str, list] = {}


@dataclass
class Coder:
    """A language's compressor with its primers and their size."""

    lang: str
    coder: zstandard.ZstdCompressor
    primers: list[bytes]
    own: int = 0

    def size(self, words: bytes) -> int:
        return sum(len(self.coder.compress(p + words)) for p in self.primers) - self.own


def compressors(content: dict[str, bytes], level: int) -> list[Coder]:
    found, tail = [], PRIMERS * PRIMER_BYTES
    for lang in sorted(content):
        text, primers = content[lang], [b""]
        if len(text) > 2 * tail:
            text, rest = text[:-tail], text[-tail:]
            primers = [rest[i : i + PRIMER_BYTES] for i in range(0, tail, PRIMER_BYTES)]
        words = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        coder = Coder(lang, zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False), primers)
        coder.own = coder.size(b"")
        found.append(coder)
    return found


def judge(raw: str | None, coders: list[Coder], reject_margin: float, bounds: dict[int, float] | None = None) -> tuple[str, float, bool]:
    """Language, margin between the two smallest sizes as a share of the second, rejected."""
    words = letters_only(raw)
    if not words or not coders:
        return UNDETERMINED, 0.0, True
    sizes = sorted((max(coder.size(words), 0), coder.lang) for coder in coders)
    best, lang = sizes[0]
    # Texts longer than all measured ones cost no more a letter than the longest of these.
    dear = bool(bounds) and 8 * best > bounds[min(length_class(words), max(bounds))] * len(words)
    if len(sizes) == 1:
        return lang, 1.0, dear
    lead = sizes[1][0] - best
    margin = lead / (sizes[1][0] + LEAST_BYTES)
    unclear = dear and 8 * (lead - LEAST_BYTES) < CLEAR_BITS * len(words)
    return lang, margin, lead < LEAST_BYTES or margin < reject_margin or unclear


def identify_language(
    responses: DataFrame,
    content: dict[str, bytes],
    *,
    raw: str = "raw",
    level: int = LEVEL,
    reject_margin: float = 0.002,
) -> DataFrame:
    """``responses`` with ``lang_pred``, ``score`` and ``rejected``, from the whole text alone.

    ``lang_pred`` is a key of ``content``, or ``und`` where the text is null or has no letter, or
    nothing was learned; ``score`` is the margin in size between the best and the second language,
    0 to 1 (1 with a single language). ``rejected`` marks ``und``, margins under ``reject_margin`` or of fewer bytes
    than sizes waver by, and texts that cost more a letter than texts of their length in any known language,
    unless one language leads clearly. A plain dict as ``content`` has no such costs. Ties go to the first language in alphabetical order, are of score 0 and
    rejected. Rows are judged one by one, so repeated rows get equal answers and no row moves.
    Columns of these names in the input are replaced.
    """
    schema = "lang_pred string, score double, rejected boolean"
    shared, name = responses.sparkSession.sparkContext.broadcast(dict(content)), uuid.uuid4().hex
    bounds = getattr(content, "bounds", {})

    @F.pandas_udf(schema)
    def predict(texts: pd.Series) -> pd.DataFrame:
        if name not in _CODERS:  # built once per worker, which may serve several calls in turn
            _CODERS.clear()
            _CODERS[name] = compressors(shared.value, level)
        coders = _CODERS[name]
        return pd.DataFrame([judge(t, coders, reject_margin, bounds) for t in texts], columns=["lang_pred", "score", "rejected"])

    (found,) = fresh(responses, "found")
    kept = [quoted(c) for c in responses.columns if c not in ("lang_pred", "score", "rejected")]
    judged = responses.select(*kept, predict(quoted(raw).cast("string")).alias(found))
    return judged.select(*kept, f"{found}.*")
