"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenospark.llm import collocations
from phenospark.llm.decontaminate import op3_decontaminate
from phenospark.llm.embedding_dedup import op6_embedding_dedup
from phenospark.llm.language_id import op10_language_id
from phenospark.llm.lm_score import op7_lm_score
from phenospark.llm.merkle import manifest_sql, op13_merkle_manifest
from phenospark.llm.packing import op4_packing
from phenospark.llm.quality import op5_quality
from phenospark.llm.sentencepiece_table import op11_sentencepiece
from phenospark.llm.simhash import op2_simhash
from phenospark.llm.substring_dedup import op1_substring_dedup
from phenospark.llm.suffix_dedup import op8_suffix_dedup
from phenospark.llm.token_counts import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op12_collocations": collocations.SQL, "op13_merkle_manifest": manifest_sql()}
