"""The corpus pipeline: rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame;
``run`` writes every stage's result as Parquet into the shared folder and gives
it to the next.  All stages but the last return the columns of ``documents``.

Every stage takes null in any column, extra columns of any name, repeated rows
and an empty table (which gives an empty one); a null text counts as empty.
What each stage then does with them is said with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, linededup, pack, repetition, simhash
from lodestone.llm.store import made, remove, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits.

    A null or empty text has no words and goes; repeated rows are judged each,
    and so stay or go together; a very long text is judged whole.
    """
    return repetition.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document with a larger id keeps; ``n_chars`` follows.

    No row goes: a text may end empty, and a null text stays null.  A null id
    is smaller than all others; rows of one id are one document for counting.
    """
    columns = docs.columns
    out = linededup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (null is the smallest).

    Of repeated rows one stays; all texts without words are one group, and of
    rows with one id and other texts each text is a document of its own.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null text holds none; repeated rows stay or go together; items without
    characters are not searched, and an empty benchmark takes nothing out.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: the pieces of documents and their places.

    A null or empty text is its end id alone; a null id is carried; repeated
    rows are packed each.
    """
    return pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot tokenize, fingerprint or align; ``tests/llm/test_pipeline.py`` holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = made()[-1:] if name != STAGES[0][0] else []
        known = made()
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # what the stage itself wrote, and what it read, is of no more use
        remove(spark, before + [path for path in made()[:-1] if path not in known])
    return STAGES[-1][1](spark, docs, sf_dir)
