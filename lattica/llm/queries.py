"""The numbered queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.ann import op3_nearest_neighbours
from lattica.llm.collocations import COLLOCATIONS_SQL, op12_collocations
from lattica.llm.divergence import DIVERGENCE_SQL, op13_divergence
from lattica.llm.exact_topk import TOPK_SQL, op6_exact_topk
from lattica.llm.jaccard_join import op10_ngram_jaccard_join
from lattica.llm.licenses import license_sql, op4_license_scans
from lattica.llm.mixing import MIX_SQL, op11_mix_sources
from lattica.llm.nbest import op5_nbest_pieces
from lattica.llm.packing import op8_best_fit_packing
from lattica.llm.pii import op7_surrogates
from lattica.llm.quality import op2_quality_classifier
from lattica.llm.secrets import op1_secret_scans
from lattica.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_license_scans": op4_license_scans,
    "op5_nbest_pieces": op5_nbest_pieces,
    "op6_exact_topk": op6_exact_topk,
    "op7_surrogates": op7_surrogates,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_mix_sources": op11_mix_sources,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = {
    "op4_license_scans": license_sql(),
    "op6_exact_topk": TOPK_SQL,
    "op11_mix_sources": MIX_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
    "op13_divergence": DIVERGENCE_SQL,
}
