"""Sinks: append-only staging history and keyed tables with one-manifest publish
(rewritten by bucket, or merged on read)."""

from changeflow.sinks.change_files import ChangeTables  # noqa: F401
from changeflow.sinks.staging import StagingStore, staging_schema  # noqa: F401
from changeflow.sinks.tables import HadoopFS, TableSet, bucket_of  # noqa: F401
