"""From raw documents to packed training sequences: five stages, each a DataFrame job over all that the one before kept.

ORACLE_SQL is None: SQL can express neither the language mixtures nor the passage search; the tests hold each stage
against a brute-force version. All stages keep the columns they are given, whatever their names; only doc_id, text, lang,
source and n_chars are read. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phasegrid.llm import langid, mixing, near_copies as copies, packing, substring_dedup
from phasegrid.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly in a language of the corpus; the model learns from the rows of docs that operator 2 doesn't hold out.

    Null texts and texts without letters go. Rows with a null id are judged but not learned from; repeated rows stay repeated.
    """
    model = langid.fit(docs.where(~langid.held_out(5, 0) & docs["doc_id"].isNotNull()))
    return langid.keep_known(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 over five-word shingles), the one with the least id.

    Operator 1's fingerprints and indexes give the first links, MinHash bands those beyond its radius. Texts without a word are copies of
    each other. Of rows that share an id one stays. Rows with a null id stay if no document with an id is like them.
    """
    return copies.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand in a document with a lesser id; those left without a word go.

    Null texts, rows with a null id and texts of under 50 words stay as they are; n_chars is set anew where a text changes.
    """
    return substring_dedup.remove_passages(docs, substring_dedup.near_passages(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share asks for, whole.

    A null source is a source of its own. Texts without a word weigh nothing and are taken as often as whole epochs. Repeated rows share
    what is taken of them, ties go by id.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every row in a sequence.

    Null and empty texts are one token. Repeated rows and null ids are documents of their own. Only the pieces are returned.
    """
    # The workers also hold what the stages before left there, so the token cache is small.
    return packing.pack_documents(docs, room=24 << 20)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
