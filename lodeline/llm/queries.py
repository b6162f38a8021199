"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP12_SQL, op12_centroids
from .decontaminate import OP7_SQL, op7_decontaminate
from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .fill_middle import OP11_SQL, op11_fill_middle
from .language import op8_language_id
from .licenses import op5_licenses
from .mixing import OP6_SQL, op6_mix_sources
from .ngram_join import OP2_SQL, op2_ngram_join
from .pages import op10_extract_text
from .passages import op9_shared_passages
from .pii import op1_pii
from .quality import op3_quality
from .suffixes import OP13_SQL, op13_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_ngram_join": op2_ngram_join,
        "op3_quality": op3_quality,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_licenses": op5_licenses,
        "op6_mix_sources": op6_mix_sources,
        "op7_decontaminate": op7_decontaminate,
        "op8_language_id": op8_language_id,
        "op9_shared_passages": op9_shared_passages,
        "op10_extract_text": op10_extract_text,
        "op11_fill_middle": op11_fill_middle,
        "op12_centroids": op12_centroids,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": OP2_SQL,
        "op4_embedding_dedup": OP4_SQL,
        "op6_mix_sources": OP6_SQL,
        "op7_decontaminate": OP7_SQL,
        "op11_fill_middle": OP11_SQL,
        "op12_centroids": OP12_SQL,
        "op13_suffix_dedup": OP13_SQL,
    }
