"""The operators' queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language_id, license_scan, minhash, mixing, pii, recompression, suffix_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_dedup": minhash.op1_minhash_dedup,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_recompression_dedup": recompression.op3_recompression_dedup,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_pii": pii.op6_pii,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_url_filter": url_filter.op10_url_filter,
        "license_scan_known": license_scan.license_scan_known,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": minhash.sql(),
        "op2_suffix_dedup": suffix_dedup.SQL,
        "op3_recompression_dedup": recompression.sql(),
        "op4_exact_dedup": exact_dedup.SQL,
        "op7_license_scan": license_scan.sql(),
        "op8_decontaminate": decontaminate.sql(),
        "license_scan_known": license_scan.known_sql(),
    }
