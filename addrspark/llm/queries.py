"""The queries of this subpackage, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .decontaminate import OP6_SQL, op6_decontamination
from .lsh_forest import op11_lsh_forest
from .merkle import OP12_SQL, op12_merkle
from .phrases import OP13_SQL, op13_phrases
from .quality_rules import ABLATIONS_SQL, OP5_SQL, op5_quality_rules, quality_ablations
from .sharding import op2_sharding
from .simhash import op3_simhash
from .toxicity import op1_toxicity
from .token_count import op9_token_count
from .url_lm import OP10_SQL, op10_url_filter
from .warc_zip import OP4_SQL, op4_warc_zip
from .weak_labels import op7_weak_labels, weak_label_accuracies


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_simhash": op3_simhash,
        "op4_warc_zip": op4_warc_zip,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontamination": op6_decontamination,
        "op7_weak_labels": op7_weak_labels,
        "op8_bpe": op8_bpe,
        "op9_token_count": op9_token_count,
        "op10_url_filter": op10_url_filter,
        "op11_lsh_forest": op11_lsh_forest,
        "op12_merkle": op12_merkle,
        "op13_phrases": op13_phrases,
        "quality_ablations": quality_ablations,
        "weak_label_accuracies": weak_label_accuracies,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_zip": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_decontamination": OP6_SQL, "op10_url_filter": OP10_SQL, "op12_merkle": OP12_SQL, "op13_phrases": OP13_SQL, "quality_ablations": ABLATIONS_SQL}
