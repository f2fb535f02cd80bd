"""Shapes and fixed values of results."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the result format.
UNCLASSIFIED, PARSE_ERROR, PROCESSING_ERROR, API_ERROR = "unclassified", "parse_error", "processing_error", "api_error"
FAILURES = (UNCLASSIFIED, PARSE_ERROR, PROCESSING_ERROR, API_ERROR)
TRANSIENT = (API_ERROR, PROCESSING_ERROR)
UNMATCHED = "unmatched_"
RESULT_COLUMNS = ("label", "confidence", "confidence_detail", "is_low_confidence", "parse_status", "tokens_used")
COMPARE_COLUMNS = ("compare_old_label", "compare_is_match")

#: What a backend returns for each item, besides the item's own columns.
ANSWER_FIELDS = (
    ("raw_response", "string"),
    ("api_success", "boolean"),
    ("prompt_tokens", "bigint"),
    ("completion_tokens", "bigint"),
    ("total_tokens", "bigint"),
    ("n_retries", "bigint"),
    ("n_429", "bigint"),
    ("n_timeouts", "bigint"),
    ("n_other_errors", "bigint"),
    ("counted_retries", "bigint"),
    ("backoff_seconds", "double"),
)

#: Items and results of the ledger; seq orders what was written when.
LEDGER = T.StructType(
    [
        T.StructField("key_text", T.StringType()),
        T.StructField("key_context", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("confidence_detail", T.StringType()),
        T.StructField("is_low_confidence", T.StringType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("seq", T.LongType()),
        *(T.StructField(name, T.DoubleType() if kind == "double" else T.LongType()) for name, kind in ANSWER_FIELDS if name not in ("raw_response", "api_success", "total_tokens")),
    ]
)
