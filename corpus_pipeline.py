"""A corpus pipeline: five stages over documents, each written as Parquet and read back as the next one's documents.

What holds for every stage: each works on all rows that the one before kept, on whole texts of any length. A null text counts as
an empty one, and stays null where a stage passes texts on; a null doc_id is an id like others. An empty table gives an empty
one. Columns beyond those of documents pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import byte_bpe, decontaminate, quality_gam, secrets, simhash
from quantloom.llm.common import discard, stored


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the texts are now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, learned from `labels`, scores 0.5 or more.

    A score of 0.5 stays; so does everything where there are no labels to learn from. Repeated rows have equal scores.
    """
    return quality_gam.keep_good(docs, quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity of 0.8 or more.

    The least doc_id stays, nulls last, and one row of those that tie. Texts of fewer than five words are one shingle of all;
    those without words are one class.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents of whose words half or more are in such passages go.

    An empty benchmark cuts nothing; a text without words stays.
    """
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials replaced by a mark; all rows stay, and rows of equal texts change alike."""
    return _counted(secrets.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text (of none, to nothing)."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.tokenized(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: No stage but the third is expressible in SQL: the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted once the next one's stands: the one that the result is read from stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        now: list[str] = []
        docs = stored(stage(spark, docs, sf_dir), now)
        discard(before)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
