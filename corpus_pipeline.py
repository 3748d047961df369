"""The corpus pipeline: language ID, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents; a changed text
gets a new ``n_chars``. Rows are matched by doc_id, which names a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponexus.llm import langid, line_templates, packing, simhash_pairs, storage, suffix_repeats

#: A document whose language scores less than this is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the network can name a language for; texts and labels stay as they are.

    Null text and text without a letter are rejected. Rows with null or repeated ids are judged like
    any other.
    """
    network = langid.fit(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    named = langid.identify(docs, network, "text", as_row=True)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def _with_text(docs: DataFrame, found: DataFrame, text) -> DataFrame:
    """The columns of ``docs``, carried in ``found`` as ``row``, with the text that ``text`` gives."""
    rows = found.select("row", text.alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return rows.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs across documents, save in the first; all rows stay, null text as empty text."""
    kept = line_templates.drop_recurring(docs, "doc_id", "text", carry=[c for c in docs.columns if c != "text"])
    return _with_text(docs, kept, F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near-duplicates: 5-word Jaccard similarity of 0.8 or more.

    Rows that share an id stay or go together; rows without an id stay.
    """
    groups = simhash_pairs.similar(docs, "doc_id", "text", words=5, least=0.8)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop bytes covered by 100-byte strings that also start earlier; all rows stay, null text as empty text.

    A cut can fall inside a character; its bytes that are left are dropped from the new text.
    """
    kept = suffix_repeats.remove_repeats(docs, "doc_id", "text", length=100, with_bytes=False, with_text=True, carry=[c for c in docs.columns if c != "text"])
    return _with_text(docs, kept, F.col("kept_text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", length=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_template_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained network nor the tokenizer. The tests hold the near-dedup stage and the other
#: stages' operators against brute force, and ``run`` against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
