"""A corpus pipeline over ``documents``: each stage is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvexa.llm import language, minhash, packing, quality, repeats
from corvexa.llm.common import Workspace, doc_hash, table
from corvexa.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


#: A text of so many characters whose best language has no more than this share is in none of them.
LONG, SHARE = 200, 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: no letter at all, or a text of LONG characters in which none stands out.

    Null, empty and blank texts have no letter and go. Of a short text too little is known to reject it, so it stays.
    Each row is judged by its own text, so repeated rows and ties stand or fall together; without any labelled row
    every row goes. An empty table gives an empty one; columns other than those of ``documents`` aren't carried.
    """
    model = language.train(docs.where(doc_hash() % 4 != 2))
    found = language.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return found.where((F.col("score") >= SHARE) | (F.length("text") < LONG)).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below the threshold.

    Null and empty texts have the score of a text without words. Each row is judged by its own text, so repeated rows
    stand or fall together; a score of exactly 0.5 stays, so without labels of both kinds every row stays. An empty
    table gives an empty one; columns other than those of ``documents`` aren't carried.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels.where(doc_hash() % 3 != 1))
    return quality.predict(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (Jaccard 0.8 on five-word shingles).

    Null, empty and blank texts and rows without an id belong to no group and stay. Rows that share an id are one
    document of several texts: they stand or fall together. An empty table gives an empty one; columns other than
    those of ``documents`` aren't carried.
    """
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts, with the rest of a character that a passage's end cuts. No row goes.

    Null texts become empty ones. Rows without an id come before all others, and rows that share an id are told apart
    by a row number, so of repeated rows one keeps its text. An empty table gives an empty one; columns other than
    those of ``documents`` aren't carried.
    """
    out = repeats.remove_repeats(docs.select(*COLUMNS), as_text=True)
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of token sequences, of every row.

    Null and empty texts are the end token alone; rows without an id keep their null; repeated rows are documents of
    their own. An empty table gives no pieces; other columns aren't carried.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
