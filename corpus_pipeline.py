"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of documents. An empty table passes all stages and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, decontamination, jaccard, packing, secrets, tokens, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Null and empty texts have the score of the bias alone; repeated rows stay or go together."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Null and empty texts and those without words are in no group and stay; of repeated rows one stays."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item. Null and empty texts share none and stay; repeated rows stay or go together."""
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced; n_chars follows a text that changed. Null texts stay null, and repeated rows are changed alike."""
    scanned = secrets.scan(docs.select(*COLUMNS))
    changed = F.size("secret_spans") > 0
    return scanned.select(
        "doc_id",
        F.col("redacted_text").alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length("redacted_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, with their token ids; few words are cached, as four stages' leftovers share the memory.

    A null or empty text is one end id, and repeated rows are packed as often as they occur.
    """
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), with_ids=True, cached_words=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express a classifier, the randomness tests or the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
