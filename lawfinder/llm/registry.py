"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import oracles
from .embeddup import op9_embedding_neardup
from .linededup import op4_line_dedup
from .neardup import op5_ngram_jaccard_join
from .packing import op2_packing
from .perplexity import op10_quality_rules
from .pieces import op6_sentencepiece
from .quality import op8_quality_classifier
from .residual import op13_best_fit_packing
from .secrets import op7_secret_scans
from .sharding import op1_sharding
from .toxicity import op3_toxicity
from .vectorcodes import op12_vector_codes
from .whitening import op11_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_secret_scans": op7_secret_scans,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_embedding_neardup": op9_embedding_neardup,
        "op10_quality_rules": op10_quality_rules,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_vector_codes": op12_vector_codes,
        "op13_best_fit_packing": op13_best_fit_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op5_ngram_jaccard_join": oracles.OP5, "op9_embedding_neardup": oracles.OP9, "op12_vector_codes": oracles.OP12}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
