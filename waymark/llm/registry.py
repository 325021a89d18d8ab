"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.chat import ORACLE as CHAT_SQL
from waymark.llm.chat import op13_chat_formatting
from waymark.llm.decontaminate import op1_decontaminate
from waymark.llm.fingerprint import op8_fingerprints
from waymark.llm.jaccard import op10_ngram_jaccard
from waymark.llm.langid import op5_language_id
from waymark.llm.packing import op2_packing
from waymark.llm.quality import op9_quality
from waymark.llm.search import ORACLE as SEARCH_SQL
from waymark.llm.search import op11_lexical_search
from waymark.llm.secrets import op7_secrets
from waymark.llm.spelling import ORACLE as SPELLING_SQL
from waymark.llm.spelling import op12_spelling_variants
from waymark.llm.substrings import op3_substring_dedup
from waymark.llm.toxicity import op6_toxicity
from waymark.llm.warc import ORACLE as WARC_SQL
from waymark.llm.warc import op4_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_decontaminate": op1_decontaminate,
        "op2_packing": op2_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_warc": op4_warc,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_secrets": op7_secrets,
        "op8_fingerprints": op8_fingerprints,
        "op9_quality": op9_quality,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_lexical_search": op11_lexical_search,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_chat_formatting": op13_chat_formatting,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": WARC_SQL,
        "op11_lexical_search": SEARCH_SQL,
        "op12_spelling_variants": SPELLING_SQL,
        "op13_chat_formatting": CHAT_SQL,
    }
