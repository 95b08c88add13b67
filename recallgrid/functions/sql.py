"""The text functions for SQL: temporary functions of a session, written in built-in functions, so that Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bodies of the functions; each has one argument ``t``.
BODIES = {
    "rg_query_terms": ("string", r"regexp_replace(t, r'[^\x00-\x7f]+', ' ')"),
    "rg_tokens": ("array<string>", r"filter(split(lower(regexp_replace(t, r'([\x00-\x7f]+)', ' $1 ')), r'[^\p{L}\p{N}]+'), x -> x <> '')"),
    "rg_token_line": ("string", "concat('|', array_join(rg_tokens(t), '||'), '|')"),
}


def register(spark: SparkSession) -> None:
    """``rg_query_terms``, ``rg_tokens``, ``rg_token_line`` of a string, and ``rg_occurrences(line, word)``, the times that a line of tokens has a word."""
    for name, (kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rg_occurrences(line STRING, word STRING) RETURNS INT RETURN regexp_count(line, concat('\\\\|', word, '\\\\|'))")
