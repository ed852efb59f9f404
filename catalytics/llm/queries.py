"""Queries of the numbered operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalytics.llm.ann_forest import op8_ann_forest
from catalytics.llm.bitsliced_topk import op4_bitsliced_topk
from catalytics.llm.langid import op1_language_id
from catalytics.llm.mixing import ORACLE_SQL as MIXING_SQL
from catalytics.llm.mixing import op6_source_mixing
from catalytics.llm.ngram_lm import op9_ngram_lm
from catalytics.llm.packing import op5_packing
from catalytics.llm.pii_crf import op10_personal_data
from catalytics.llm.prefix_trie import op11_prefix_trie
from catalytics.llm.secrets import op3_secret_scan
from catalytics.llm.simhash import op7_simhash
from catalytics.llm.substring_dedup import op2_substring_dedup
from catalytics.llm.suffix_dedup import op12_suffix_dedup
from catalytics.llm.token_alignment import op13_token_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_bitsliced_topk": op4_bitsliced_topk,
    "op5_packing": op5_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_simhash": op7_simhash,
    "op8_ann_forest": op8_ann_forest,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_personal_data": op10_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op6_source_mixing": MIXING_SQL}
