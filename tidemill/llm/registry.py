"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontamination, divergence, fixity, infilling, jaccard, knn, language, licenses, lines, mixing, oracle, scoring, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_voronoi_top_k": knn.query,
        "op2_license_scan": licenses.query,
        "op3_line_dedup": lines.query,
        "op4_pareto_mixing": mixing.query,
        "op5_ppm_scoring": scoring.query,
        "op6_merkle_fixity": fixity.query,
        "op7_language_filters": language.query,
        "op8_benchmark_decontamination": decontamination.query,
        "op9_jaccard_join": jaccard.query,
        "op10_quality_classifier": classifier.query,
        "op11_fill_in_middle": infilling.query,
        "op12_sampled_splitters": sharding.query,
        "op13_source_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_voronoi_top_k": knn.ORACLE_SQL,
        "op4_pareto_mixing": mixing.ORACLE_SQL,
        "op6_merkle_fixity": fixity.ORACLE_SQL,
        "op8_benchmark_decontamination": oracle.DECONTAMINATION,
        "op9_jaccard_join": oracle.JACCARD,
        "op11_fill_in_middle": infilling.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
