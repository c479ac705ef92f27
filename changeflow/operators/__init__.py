"""DataFrame -> DataFrame operators: filters, flatten, resolve, merge, checks."""

from changeflow.operators.checks import (  # noqa: F401
    children_per_parent, count_by_op, distinct_ops, envelope_shape, key_conflicts, lag_stats,
    null_violations, orphans, row_counts, unique_violations,
)
from changeflow.operators.filters import (  # noqa: F401
    drop_deletes, filter_ops, image, incremental_filter, max_time, since_watermark, with_change_meta,
)
from changeflow.operators.flatten import (  # noqa: F401
    flatten, flatten_events, flatten_union, parse_document, vanished_children,
)
from changeflow.operators.merge import (  # noqa: F401
    advance_watermark, advance_watermarks, apply_deletes, batch_metrics, merge_batch, merge_delete_insert, merge_upsert,
    model_rows, rebuild, run_model,
)
from changeflow.operators.resolve import (  # noqa: F401
    current_state, dead_keys, dead_keys_correlated, history, latest_per_key, max_arrival,
)
