"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .chat import op4_chat_format
from .fingerprint import op5_fingerprints
from .jaccard import op9_jaccard_join
from .media import op2_media_columns
from .merkle import op13_merkle
from .mixing import op8_mixing
from .negatives import op11_hard_negatives
from .packing import op7_packing
from .pii import op12_pii
from .substring import op10_substring_dedup
from .tokencount import op6_token_counts
from .toxicity import op1_toxicity
from .urls import op3_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [op1_toxicity, op2_media_columns, op3_url_filter, op4_chat_format, op5_fingerprints, op6_token_counts, op7_packing, op8_mixing, op9_jaccard_join, op10_substring_dedup, op11_hard_negatives, op12_pii, op13_merkle]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": sql.CHAT, "op9_jaccard_join": sql.JACCARD, "op10_substring_dedup": sql.SUBSTRING, "op11_hard_negatives": sql.NEGATIVES, "op13_merkle": sql.MERKLE}
