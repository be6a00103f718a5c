"""The operators applied to their whole tables: name -> query, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stageflow.llm import alignment, chat_format, collocations, decontaminate, fingerprints, language_id, license_scan, ngram_join, packing, quality_classifier, quality_rules, sharding, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_quality_classifier": quality_classifier.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_url_filter": url_filter.op5,
    "op6_ngram_join": ngram_join.op6,
    "op7_license_scan": license_scan.op7,
    "op8_chat_format": chat_format.op8,
    "op9_packing": packing.op9,
    "op10_sharding": sharding.op10,
    "op11_fingerprints": fingerprints.op11,
    "op12_alignment": alignment.op12,
    "op13_collocations": collocations.op13,
}

SQL: dict[str, str] = {"op5_url_filter": url_filter.sql(), "op7_license_scan": license_scan.sql(), "op13_collocations": collocations.sql()}
