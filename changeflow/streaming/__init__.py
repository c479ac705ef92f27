"""Structured Streaming jobs: direct upsert, staging append, staging merge."""

from changeflow.streaming.jobs import (  # noqa: F401
    direct_batch, latest_marked_batch, merge_once, merge_result, model_tables, staging_batch, start_direct, start_merge,
    start_staging,
)
