"""The queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.fingerprint import op9_fingerprint
from quire.llm.html_extract import op5_html_extraction
from quire.llm.media import op10_media
from quire.llm.near_dedup import op4_near_dedup
from quire.llm.packing import op7_packing
from quire.llm.pii import op6_pii
from quire.llm.sentencepieces import op1_sentencepiece
from quire.llm.sharding import op2_sharding
from quire.llm.suffix_dedup import op8_suffix_dedup
from quire.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_near_dedup": op4_near_dedup,
        "op5_html_extraction": op5_html_extraction,
        "op6_pii": op6_pii,
        "op7_packing": op7_packing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_fingerprint": op9_fingerprint,
        "op10_media": op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {}
