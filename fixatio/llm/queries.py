"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fixatio.llm import digests
from fixatio.llm.sql import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_best_fit": digests.pack_best_fit,
    "op2_suffix_dedup": digests.suffix_array_dedup,
    "op3_line_dedup": digests.line_dedup,
    "op4_warc_segments": digests.warc_round_trip,
    "op5_minhash_near_dup": digests.near_duplicates,
    "op6_exact_top_k": digests.exact_top_k,
    "op7_quality_co_training": digests.quality_co_training,
    "op8_collision_ann": digests.collision_counting_ann,
    "op9_language_ppm": digests.language_ppm,
    "op10_mix_sources": digests.mix_sources,
    "op11_periodic_runs": digests.periodic_run_detection,
    "op12_token_alignment": digests.cross_tokenizer_alignment,
    "op13_vector_range_join": digests.embedding_near_duplicates,
    "pipeline": corpus_pipeline.run,
}
