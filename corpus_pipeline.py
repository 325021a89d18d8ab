"""A corpus pipeline of five stages over `documents`, each written and read again.

Language identification drops texts without a language; the n-gram Jaccard join keeps
one document of each group of near duplicates, the one with the least id; contaminated
documents go; documents that hold a secret go; what is left is packed into sequences.
All but the last stage return the columns of their input, whatever their names: columns
that are called like an operator's result (score, items, spans ...) pass unchanged.

Edge cases: a null or empty text has no language and goes in the first stage; of rows
that repeat id and text one stays, in the second; rows of a null id or of one id with
different texts are judged each by its text in all stages but the second, which keeps
them if one of them names a group; nulls in other columns pass; an empty table stays
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, jaccard, langid, packing, secrets
from waymark.llm._common import materialise, table

TOKENIZER = "word_bpe_49k.json"
#: Words of a generation that packing workers keep: executors still hold the memory of the stages before.
KNOWN_WORDS = 200_000

#: No SQL: naive Bayes, tokenizers and first-fit packing are not expressible.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """The text, and the whole row as one column, out of reach of results of the same names."""
    return docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language was recognised."""
    model = langid.learn(docs.where(~langid.held_out()).select("lang", "text"))
    marked = langid.identify(_whole(docs), model, keep=["__doc"])
    return marked.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select("__doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component of links."""
    found = jaccard.components(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which test items make up a twentieth of the words or more."""
    found = decontaminate.report(_whole(docs), table(spark, sf_dir, "benchmark"), keep=["__doc"])
    return found.where(~decontaminate.contaminated()).select("__doc.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a credential, key or random string."""
    return docs.where(~secrets.has_secret(F.col("text")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row per piece."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), known_words=KNOWN_WORDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("without_secrets", without_secrets),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
