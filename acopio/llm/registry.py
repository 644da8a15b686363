"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op9_benchmark_decontamination
from .html_extract import op10_html_extraction
from .infill import OP12_SQL, op12_fill_in_middle
from .language_id import op8_language_id
from .license_scan import op7_license_scan
from .line_dedup import OP3_SQL, op3_line_dedup
from .near_dedup import op6_minhash_near_dedup
from .packing import op4_best_fit_packing
from .pii import op1_pii_surrogates
from .quality_classifier import op5_quality_classifier
from .quality_rules import op2_quality_rules
from .repeats import OP11_SQL, op11_suffix_dedup
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_surrogates, op2_quality_rules, op3_line_dedup, op4_best_fit_packing, op5_quality_classifier, op6_minhash_near_dedup, op7_license_scan, op8_language_id, op9_benchmark_decontamination, op10_html_extraction,
        op11_suffix_dedup, op12_fill_in_middle, op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_suffix_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_vector_codes": OP13_SQL}
