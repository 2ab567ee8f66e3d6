"""Queries of this package for the driver's entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import ORACLE as CHAT_ORACLE
from .chat import op10_chat_format
from .embedding_dedup import ORACLE as EMBEDDING_ORACLE
from .embedding_dedup import op1_embedding_dedup
from .language_id import op8_language_id
from .licenses import op3_license_scan
from .minhash_dedup import ORACLE as MINHASH_ORACLE
from .minhash_dedup import op4_minhash_dedup
from .mixing import ORACLE as MIXING_ORACLE
from .mixing import op2_source_mixing
from .quality_rules import op6_quality_rules
from .resampling import op7_importance_resampling
from .sentencepieces import op5_sentencepieces
from .substring_dedup import ORACLE as SUBSTRING_ORACLE
from .substring_dedup import op9_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_dedup, op2_source_mixing, op3_license_scan, op4_minhash_dedup, op5_sentencepieces, op6_quality_rules, op7_importance_resampling, op8_language_id, op9_substring_dedup, op10_chat_format)
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": EMBEDDING_ORACLE, "op2_source_mixing": MIXING_ORACLE, "op4_minhash_dedup": MINHASH_ORACLE, "op9_substring_dedup": SUBSTRING_ORACLE, "op10_chat_format": CHAT_ORACLE,
}
