"""Sources: change streams / logs (partitioned ones too), snapshots, seed documents, JDBC."""

from changeflow.sources.changes import (  # noqa: F401
    envelope_rejects,
    parse_envelope,
    peek_changes,
    read_change_log,
    read_changes,
)
from changeflow.sources.partitioned_log import append_log, read_log, stream_log  # noqa: F401
from changeflow.sources.snapshots import diff_snapshots, snapshot_events, without_id  # noqa: F401
from changeflow.sources.jdbc import read_jdbc, write_jdbc  # noqa: F401
from changeflow.sources.seeds import seed_messages, seed_policies, scenario_messages  # noqa: F401
