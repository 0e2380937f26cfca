"""The registered queries of this subpackage, one for each operator, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_byte_bpe
from .contam import op7_prefix_join
from .html_main import op5_template_removal
from .jaccard import op6_signature_trees
from .media_ts import op1_transport_stream
from .oracles import SQL
from .resample import op9_importance_resampling
from .secrets_scan import op8_secret_spans
from .shards import op10_differencing_shards
from .substrings import op2_seed_extend
from .suffixes import op4_interval_expansion


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_transport_stream, op2_seed_extend, op3_byte_bpe, op4_interval_expansion, op5_template_removal, op6_signature_trees, op7_prefix_join, op8_secret_spans, op9_importance_resampling, op10_differencing_shards,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
