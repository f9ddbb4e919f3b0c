"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``, whatever those are beside ``doc_id``, ``text`` and
``source``. Empty tables pass through, null texts count as empty (and have null
ids at the end), rows without an id are treated like others; each operator's
docstring says what that means for it.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from tidings.llm import boosted, mixing, simhash, surrogates, wfst
from tidings.session import prepare, ship, work_folder

#: Documents scored below this go.
LEAST_QUALITY = 0.7
#: A test key; a real one is kept apart from the code.
SURROGATE_KEY = b"surrogates of the corpus pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(prepare(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = boosted.train(docs, labels.where(~boosted.held_out()))
    return boosted.score(docs, trees, keep=LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    ship(prepare(spark))
    return simhash.first_of_group(docs, shingle=3, bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts give way to surrogates."""
    ship(prepare(spark))
    return surrogates.replace_checked(docs, SURROGATE_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    ship(prepare(spark))
    return mixing.mixed(docs, weights=(3, 1, 2), budget=1.5, most=2)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as ``ids``, beside the other columns, and whether the ids decode to them."""
    ship(prepare(spark))
    return wfst.encode(docs, tokenizer_path("piece_bpe_32k.model"), check=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Scores of boosted trees and paths through a transducer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
