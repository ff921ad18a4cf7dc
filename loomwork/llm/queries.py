"""The queries of this folder's operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    decontaminate,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    quality_rules,
    sharding,
    url_filter,
    warc,
)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_warc": warc.query,
    "op3_license_scan": license_scan.query,
    "op4_url_filter": url_filter.query,
    "op5_quality_rules": quality_rules.query,
    "op6_sharding": sharding.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_line_dedup": line_dedup.query,
    "op9_ngram_jaccard_join": jaccard_join.query,
    "op10_source_mixing": mixing.query,
}

ORACLE_SQL = {
    "op2_warc": warc.ORACLE_SQL,
    "op7_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
}
