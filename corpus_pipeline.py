"""A corpus pipeline of five stages; each works on all that the stage before kept.

1. toxicity: documents that the network rejects go.
2. near_duplicates: of each group of documents linked by their five-word shingles (a
   similarity of 0.8 or more), the one with the smallest doc_id stays.
3. decontamination: documents with a window of any benchmark item go.
4. secrets: confirmed and pattern-matched secrets are replaced by a mark in the text.
5. pieces: what is left is encoded.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from delimkit.llm import decontaminate, secret_scan, sentencepiece_codec, set_join, toxicity
from delimkit.llm.common import drop_kept, keep
from delimkit.llm.queries import tokenizer_file

#: SQL expresses neither the trained network nor the encoder.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network doesn't call toxic. It is trained on this stage's own rows and the labels of their ids."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id; repeated rows count as copies. Rows without words stay."""
    return set_join.keep_one(docs, width=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of any benchmark item (two items are the rule of op7's column only)."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"), least=1)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in texts are replaced by a mark, and n_chars follows the text."""
    return secret_scan.redact_rows(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_pieces, piece_ids, decoded_sha256, round_trip."""
    return sentencepiece_codec.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again, and go when the next one's are written."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        docs = keep(made, name)
        drop_kept(*before, *getattr(made, "_reads", []))
        before = [docs]
