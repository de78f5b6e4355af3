"""A corpus pipeline over the documents table: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as Parquet
to the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import raking, secret_ledger, simhash_vptree, tile_decontamination, zstd_language
from assayline.llm.common import fresh, known_to_workers, quoted
from assayline.llm.queries import topic_of
from assayline.session import materialise, scratch

KEEP_TOKENS = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those that the classifier rejects go.

    It is fitted on a bounded sample of the labelled documents (see ``learn_dictionaries``). Documents
    without a ``lang`` get the language found, which the mixture counts them under.
    """
    content = zstd_language.learn_dictionaries(docs, key="doc_id", raw="text", lang="lang")
    names = fresh(docs, "judged_text", "judged_row")
    row = F.struct(*(quoted(c).alias(c) for c in docs.columns)).alias(names[1])
    judged = zstd_language.identify_language(docs.select(quoted("text").alias(names[0]), row), content, raw=names[0])
    found = {"lang": F.coalesce(F.col(names[1])["lang"], F.col("lang_pred"))}
    return judged.filter("NOT rejected").select(*(found.get(c, F.col(names[1])[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, a null id last.

    Shingles of five words, similarity of 0.8 or more. Groups are found by the texts themselves, so
    documents without an id, or several under one id, count like any others; of rows with equal id and
    text one stays.
    """
    blob, id_, n = fresh(docs, "dedup_blob", "dedup_id", "dedup_rows")
    marked = docs.withColumn(blob, secret_ledger.blob_id("text"))
    groups = simhash_vptree.near_duplicates(marked.select(blob, "text"), key=blob, raw="text")
    rows = materialise(marked.groupBy(quoted("doc_id").alias(id_), blob).agg(F.count("*").alias(n)))
    first = F.min(F.struct(F.col(id_).isNull().alias("no_id"), id_, blob)).alias("first")
    stay = materialise(rows.join(groups, blob).groupBy("component_id").agg(first).select(f"first.{id_}", f"first.{blob}"))
    whole = lambda table: (quoted("doc_id").eqNullSafe(table[id_])) & (marked[blob] == table[blob])
    gone = materialise(rows.join(stay.withColumnRenamed(blob, "kept_blob"), rows[id_].eqNullSafe(stay[id_]) & (rows[blob] == F.col("kept_blob")), "left_anti").select(id_, blob))
    kept = marked.join(gone, whole(gone), "left_anti")
    repeated = materialise(rows.filter(F.col(n) > 1).select(id_, blob))
    if not repeated.isEmpty():
        again = kept.join(repeated, whole(repeated), "left_semi").dropDuplicates(["doc_id", blob])
        kept = kept.join(repeated, whole(repeated), "left_anti").unionByName(again)
    return kept.select(*(quoted(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item for the greater part.

    Texts decide, not ids: every row of a contaminated text goes, whatever its id, and no other row does.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    blob, gone = fresh(docs, "text_blob", "gone_blob")
    marked = docs.withColumn(blob, secret_ledger.blob_id("text"))
    found = tile_decontamination.contaminated(marked.select(blob, "text"), items, key=blob, raw="text")
    # Written, so that the list is computed once and its size is known to the join.
    blobs = materialise(found.select(F.col(blob).alias(gone)).distinct())
    return marked.join(blobs, F.col(blob) == F.col(gone), "left_anti").select(*(quoted(c) for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind in brackets; ``n_chars`` follows the text."""
    versions = docs.select(F.lit(0).alias("attempt"), quoted("text").alias("raw"))
    ledger = materialise(secret_ledger.scan_unseen(versions))
    (blob, findings) = fresh(docs, "blob_id", "found_spans")
    # Only texts that hold something are looked up.
    held = ledger.filter(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(findings))
    marked = docs.join(held, secret_ledger.blob_id("text") == F.col(blob), "left")
    text = secret_ledger.redact(quoted("text"), F.coalesce(F.col(findings), F.array().cast("array<struct<kind:string, start:long, end:long>>")))
    changed = {"text": text, "n_chars": F.when(F.col(blob).isNull(), quoted("n_chars")).otherwise(F.length(text).cast("long"))}
    return marked.select(*(changed.get(c, quoted(c)).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their targets, with their probabilities.

    Targets are the token shares to the power 0.5; the result holds about ``KEEP_TOKENS`` of all tokens.
    Documents of kinds that must grow come several times, numbered from 1 in ``mix_copy``. A column of that name is replaced.
    """
    docs = docs.drop("mix_copy")
    (topic, tokens) = fresh(docs, "mix_topic", "mix_tokens")
    words = F.size(F.filter(F.split(F.coalesce(quoted("text"), F.lit("")), r"\s+"), lambda w: w != ""))
    rows = docs.withColumns({topic: topic_of("text"), tokens: words.cast("long")})
    mixed = raking.mixing_probabilities(rows, margins=["source", "lang", topic], tokens=tokens, key="doc_id", keep=KEEP_TOKENS)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy")
    kept = mixed.filter("mix_copies > 0")
    return kept.select(*(quoted(c) for c in kept.columns if c not in ("mix_kept", "mix_copies", tokens)), copies)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

# Compression, fingerprints and string tiling are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    known_to_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
