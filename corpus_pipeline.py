"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, redaction of personal data, packing.

All stages but the last take a table of documents and return its columns COLUMNS: one that the table lacks is null, further
ones are dropped. Names are matched without regard to case. Null texts count as empty, texts are used whole whatever their
length, rows are never told apart by their id alone, and an empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import jaccard_join, line_dedup, packing, pii, quality
from pixelloom.llm.common import ship, table, written

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _own(docs: DataFrame) -> DataFrame:
    """The documents' columns, in their order; those that are not there are null."""
    there = {c.lower(): c for c in docs.columns}
    return docs.select(*[(F.col(f"`{there[c]}`") if c in there else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars following the text (null: null)."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject; those without text are among them. Equal rows fare alike."""
    ship(spark)
    return quality.keep_good(_own(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents only in the largest id. A document left without text stays, empty; rows that share an id
    are one document here, and so are those without any."""
    return _counted(line_dedup.dedup_lines(_own(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the row with the smallest doc_id, rows without one last.

    Unlike texts all stay, also where they share an id or have none; of equal rows one stays. Texts without words are no group.
    """
    ship(spark)
    return jaccard_join.keep_one(_own(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind in brackets; a null text stays null."""
    return _counted(pii.redact(_own(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids: columns of packing.pack. A null text is packed as an empty one."""
    import public_tokenizers

    ship(spark)
    return packing.pack(_own(docs), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality_rules", drop_junk),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("packing", pack),
]

#: The tokenizer's ids and the verdict by distribution divergence have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
