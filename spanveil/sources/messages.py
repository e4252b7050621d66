"""Messages as batch or streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REQUEST = (
    "thread_id string, session_id string, visitor_id string, client_id string, assistant_id string, op string, seq bigint, ts double, message string, new_user boolean,"
    " previous_assistant_message string, non_name_allowlist array<string>, failure_mode string, include_replacements boolean"
)

REFRESH = (
    "client_id string, assistant_id string, source_version string, updated_at_epoch double, terms array<string>, payload string,"
    " selectors array<struct<selector:string,include:string>>"
)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the fields of ``REQUEST``; missing ones are null."""
    return spark.read.schema(REQUEST).json(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_refreshes(spark: SparkSession, path: str) -> DataFrame:
    """Requests to refresh an allowlist, as JSON lines with the fields of ``REFRESH``; for ``operators.requests.validate_refresh``."""
    return spark.read.schema(REFRESH).json(path)
