"""Spelling variants of the words in responses, by permuterm rotations.

A model writes the names it was given (roles, macros, brands) with small slips, and the slips can be
told from names by how much rarer they are. Every word gets a terminator and is turned until the
place of an edit comes last: ``a c b`` with the edited letter ``c`` becomes ``b $ a c``. All words
that differ from it in that letter alone share the prefix ``b $ a``, and so does ``a b``, the word
without it. In the sorted rotations each prefix is one range, and a scan of the range tells every member how
many neighbours it has there and which is the most frequent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayline.llm.common import Batches, quoted
from assayline.session import materialise

MARK = "$"  # ends a word; never part of one
HELD_WORDS = 200_000  # distinct words a task holds before it hands them on
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def words_of(key: str | None, raw: bytes | None, min_length: int, slip_every: int | None) -> Counter:
    """Counts of the words of one text, A-Z in lower case, slips applied (see ``count_words``)."""
    found = Counter(re.findall(r"[a-zÀ-ÿ]{%d,}" % min_length, (raw or b"").lower().decode("utf-8", "replace")))
    if not slip_every:
        return found
    slipped: Counter = Counter()
    for word, n in found.items():
        h = zlib.crc32(f"{key or ''}:{word}".encode())
        if h % slip_every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= min_length:
            slipped[word] += n
    return slipped


def count_words(
    responses: DataFrame, *, key: str = "request_id", raw: str = "raw", min_length: int = 7, min_count: int = 2, slip_every: int | None = None
) -> DataFrame:
    """(word, n): the distinct words of all texts with at least ``min_length`` code points and ``min_count`` uses.

    A word is a maximal run of a-z, A-Z and U+00C0 to U+00FF; only A-Z are put in lower case. Null and
    empty texts hold no word; repeated rows count each time; bytes that are no UTF-8 end a word. Other
    columns are ignored, an empty table gives no row.

    ``slip_every`` plants slips: where it divides h, the CRC-32 of "<key>:<word>" (a null key is empty),
    every use of the word in that text loses its code point h % length, counted from 0.
    """

    def count(batches: Batches) -> Batches:
        held: Counter = Counter()
        for batch in batches:
            for k, text in zip(batch["key"].to_pylist(), batch["raw"].to_pylist()):
                held.update(words_of(k, text, min_length, slip_every))
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTED)
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTED)

    texts = responses.select(quoted(key).cast("string").alias("key"), quoted(raw).cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, n): every rotation of every word, its last letter apart, and every whole rotation (``edited`` empty)."""
    length = F.length("word")
    tail, head = F.substring(F.col("word"), F.col("at") + 1, length), F.substring(F.col("word"), F.lit(1), F.col("at"))
    after = F.substring(F.col("word"), F.col("at") + 2, length)
    letter = F.substring(F.col("word"), F.col("at") + 1, F.lit(1))
    turned = words.withColumn("at", F.explode(F.sequence(F.lit(0), length)))
    both = F.array(
        F.struct(F.concat(tail, F.lit(MARK), head).alias("prefix"), F.lit("").alias("edited")),
        F.when(F.col("at") < length, F.struct(F.concat(after, F.lit(MARK), head).alias("prefix"), letter.alias("edited"))),
    )
    return turned.select(F.explode(both).alias("r"), "n").filter("r IS NOT NULL").select("r.prefix", "r.edited", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): per word that has any, its near words by number and the most frequent as (n, word).

    A range holds one word for each letter of the alphabet at most, and none of its pairs is built: each
    member takes counts of the range and the first other member.
    """
    letters = F.split("prefix", re.escape(MARK))
    word = F.concat(F.try_element_at(letters, F.lit(2)), F.col("edited"), F.try_element_at(letters, F.lit(1)))
    cut = F.col("edited") != ""
    # In a run of equal letters each one leaves the same shorter word: the first alone counts for it.
    first = cut & (F.right(F.col("prefix"), F.lit(1)) != F.col("edited"))
    scan = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    member = F.struct("n", "word")
    ranges = (
        rotations(words)
        .withColumns({"word": word, "cut": cut.cast("long"), "first": first.cast("long")})
        .select(
            "word",
            "cut",
            "first",
            F.row_number().over(rank).alias("place"),
            F.count("*").over(scan).alias("members"),
            F.sum("cut").over(scan).alias("cuts"),
            F.sum("first").over(scan).alias("firsts"),
            F.first(member).over(scan).alias("top"),
            F.nth_value(member, 2).over(scan).alias("second"),
        )
        .filter("members > 1")
    )
    near = F.when(F.col("cut") == 1, F.col("cuts") - 1 + F.col("first") * (F.col("members") - F.col("cuts"))).otherwise(F.col("firsts"))
    other = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))
    order = F.struct((-other["n"]).alias("least"), other["word"].alias("word"))
    return ranges.groupBy("word").agg(F.sum(near).alias("n_near"), F.min(order).alias("best"))


def group_variants(words: DataFrame, *, lift: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word string, n long).

    Two words are near if one inserted, deleted or replaced code point parts them. ``form`` is the near
    word of largest ``n`` (ties: the smaller one in code-point order) if that is at least ``lift`` times
    the word's own, else null, and ``form_n`` its ``n``; ``n_near`` counts all near words. ``root`` is
    the last word reached through forms, the word itself if it has none. Words repeated in the table
    count once, with their summed ``n``; null words are left out; a word holds no ``$``. An empty table
    gives no row.

    Each step along forms multiplies ``n``, so a chain has at most log(largest n) of them, and they are
    followed by doubling. A form has no more direct variants than a word has edits.
    """
    if lift < 2:
        raise ValueError("lift must be at least 2")
    counted = materialise(
        words.select(F.col("word").cast("string"), F.col("n").cast("long")).filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    )
    found = counted.join(neighbours(counted), "word", "left")
    far = -F.col("best.least")
    ahead = far >= lift * F.col("n")
    judged = materialise(
        found.select(
            "word",
            F.when(ahead, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(ahead, far).alias("form_n"),
        )
    )
    top, hops = judged.agg(F.max("form_n")).first()[0] or 1, 0
    while lift ** (hops + 1) <= top:
        hops += 1
    links = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, hops - 1).bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    rooted = judged.join(links, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
