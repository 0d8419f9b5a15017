"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, filter_audit, line_dedup
from .ann import op9_ann
from .decontamination import op7_decontamination
from .language_id import op3_language_id
from .licenses import op2_licenses
from .ngram_jaccard import op1_ngram_jaccard
from .packing import op4_packing
from .periodic_runs import op13_periodic_runs
from .pii import op5_pii
from .quality import op10_quality
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op3_language_id": op3_language_id,
    "op2_licenses": op2_licenses,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_chat": chat.op6_chat,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op6_chat": chat.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
