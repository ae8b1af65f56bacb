"""The corpus pipeline: five stages, each one operator of ``cotejo.llm``, from documents to packed sequences.

1. language_id: documents in no language that was learned, or of none surely enough, go.
2. near_dedup: one document of each group of near duplicates stays, the one of the least id.
3. secret_scan: secrets are overwritten in the text, its length stays.
4. mix_sources: documents are repeated or left out until each source comes near its target.
5. pack: the mixed documents become pieces of sequences of at most 2048 tokens.

Each stage but the last returns the columns of its input. A null text has no language
and so goes with stage 1; an empty table stays empty throughout; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cotejo.llm import language_id, minhash_dedup, mixing, packing, secrets
from cotejo.llm._session import table, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs, secrets.find_secrets(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_to_targets),
    ("pack", pack_sequences),
]

#: No SQL can express the first two stages and the last one; ``tests/llm`` hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
