"""Temporary SQL functions, so that the engine's scalar functions can be used in plain SQL. Their bodies are SQL, so Catalyst inlines
them like any other expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "base_stem(stem STRING) RETURNS STRING": r"rtrim(regexp_replace(stem, r'(\s*\(\d{1,3}\)\s*)+$', ''))",
    "duration_text(seconds DOUBLE) RETURNS STRING": (
        "CASE WHEN seconds >= 86400 THEN concat(cast(floor(seconds / 86400) AS STRING), 'd ', lpad(cast(floor(seconds % 86400 / 3600) AS STRING), 2, '0')) "
        "ELSE cast(floor(greatest(seconds, 0) / 3600) AS STRING) END || ':' || lpad(cast(floor(greatest(seconds, 0) % 3600 / 60) AS STRING), 2, '0') || ':' || lpad(cast(floor(greatest(seconds, 0) % 60) AS STRING), 2, '0')"
    ),
    "long_coverage(coverage DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE": "CASE WHEN greatest(a, b) > 0 THEN coverage * (least(a, b) / greatest(a, b)) ELSE coverage END",
    "pair_digest(a STRING, b STRING) RETURNS STRING": "sha2(concat_ws('\\u001f', least(a, b), greatest(a, b)), 256)",
    "hamming32(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "problem_category(error STRING) RETURNS STRING": "CASE WHEN lower(coalesce(error, '')) RLIKE 'timeout|timed out' THEN 'reindex' ELSE 'corrupt' END",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in a session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
