"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceloom.llm import minhash, mixing, packing, quality, secrets
from sliceloom.llm.queries import table, tokenizer_path
from sliceloom.llm.store import save

#: Component choice, the classifier and packing are not expressible in SQL; the stages are tested by what must hold after each.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, and every weak part linked to one, is cut from its text; documents stay."""
    return _counted(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return _counted(mixing.training_order(docs))


def in_order(docs: DataFrame) -> DataFrame:
    """docs with `training_place`, a number that rises with the order in which the stage before wrote its rows.

    The mix is written range-sorted by training time, so number of the file and of the row in it are that order, however
    the files are read. Each copy of a document has a place of its own.
    """
    at = docs.metadataColumn("_metadata")
    file = lambda rx: F.regexp_extract(at["file_name"], rx, 1).cast("long")
    place = F.shiftleft(file(r"^part-(\d+)"), 43) + F.shiftleft(file(r"-c(\d+)\."), 33) + at["row_index"]
    return docs.withColumn("training_place", place)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: a row for each piece of each copy of a document, with its place in its sequence and in training.

    Documents that stand near each other in training are packed together; read in order of sequence_place, sequences
    follow the mix's schedule.
    """
    return packing.pack(in_order(docs), tokenizer_path(), place="training_place")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_copies),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
