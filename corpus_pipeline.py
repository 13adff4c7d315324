"""A corpus pipeline of five stages: documents in, token ids out.

Each stage takes all that its predecessor kept, returns the columns of documents (the last one
token ids), and is written to the shared folder and read again before the next one starts.

    languages   rejects documents whose text has no letters or is far from all learned languages
    near copies keeps the document of smallest id of each group of near copies
    passages    removes every byte of a 100-byte string that also starts earlier
    mixing      puts the documents in the order of the Pfair schedule of the target weights
    tokens      encodes each text with the SentencePiece model, and returns slot and place in the mix

Rows of equal ids and texts are copies of each other, of which one stays. An empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finscan.llm import chosen_path, language_id, pfair_mix, sentencepiece_bpe, suffix_dedup
from finscan.llm.shared import settled, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the classifier is fitted on the labelled ones."""
    model = language_id.fit(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
    found = language_id.identify(docs, model, prefix="__id_")
    return found.where(~F.col("__id_rejected")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id; of repeated rows one."""
    return chosen_path.representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; characters cut in part go as well. n_chars follows the text."""
    return suffix_dedup.cleaned(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, which files do not keep: tokens() names each row's slot and place."""
    return pfair_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, whether they decode to it, and the row's slot and place in the mix of docs.

    The schedule reads its rows several times, so the encoded ones are written first.
    """
    tied = docs.select("doc_id", "source", "lang", "text", pfair_mix.tie(docs).alias("__mix_tie"))
    found = sentencepiece_bpe.encode(tied, decode=True).withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text")))
    names = ["doc_id", "source", "lang", "n_tokens", "token_ids", "round_trip"]
    planned = pfair_mix.schedule(settled(found.select(*names, "__mix_tie"), "tokens"), tied_by=F.col("__mix_tie"))
    return planned.select(*names, "slot", "place")


STAGES = [("languages", languages), ("near copies", near_copies), ("passages", passages), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settled(docs, "stage-" + name.replace(" ", "-"))
    return docs


#: Language rejection, similarity joins and tokenization have no SQL form; tests use brute force.
ORACLE_SQL = None
