"""Corpus pipeline: quality rules, near-duplicates, secret scans, mixing, encoding.

Each stage takes the documents that its predecessor kept, whole, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mixing, near_copies, pieces, quality, secret_scan
from barloom.llm.queries import piece_model
from barloom.llm.shared import discard, fresh, stored

#: Columns of ``documents``, which the operators read.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def carried(stage):
    """A stage over documents with any further columns, in any case of letters: these travel in one struct, so that no name of theirs meets one that an operator makes.

    Documents without further columns pass as they are. ``n_chars`` is made where it is missing, and goes again.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c.lower() for c in DOCUMENT}
        extra = [c for c in docs.columns if c.lower() not in names]
        lacking = [c for c in DOCUMENT if c not in docs.columns]
        if not extra and not lacking:
            return stage(spark, docs, sf_dir)
        (held,) = fresh(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in extra]), "carried_columns")
        kinds = {"doc_id": "long", "n_chars": "long"}
        own = [F.col(c) if c not in lacking else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in DOCUMENT]
        packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)]).alias(held) if extra else None
        out = stage(spark, docs.select(*own, *([packed] if extra else [])), sf_dir)
        place = {c: F.col(f"`{held}`.c{i}").alias(c) for i, c in enumerate(extra)}
        return out.select(*[place.get(c, F.col(f"`{c}`")) for c in docs.columns])

    run.__doc__ = stage.__doc__
    run.__name__ = stage.__name__
    return run


@carried
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


@carried
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, similarity 0.8 or more, compared whole. SimHash gives the closest candidates."""
    return near_copies.drop_near_copies(docs)


@carried
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text gives way to a mark; ``n_chars`` follows. All documents stay."""
    clean = secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


@carried
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it. The one at a source's cut is taken whole if half of it is within."""
    return mixing.mixed_rows(docs).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text with an end id, and the text that they decode to."""
    return pieces.encode_decode(docs, piece_model(), keep_text=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mixing_sources),
    ("sentencepiece", sentencepiece_encoding),
]

#: Sketch thresholds could be written in SQL; components, token tests and merges can't. The tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    A stage's files go once the next one's are written, the last ones when the driver ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
