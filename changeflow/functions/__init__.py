"""Scalar Column functions (JSON access, casts, time)."""

from changeflow.functions.casts import cast_leaf, cast_errors  # noqa: F401
from changeflow.functions.json import json_patch, json_value, json_values, summary_json  # noqa: F401
from changeflow.functions.time import epoch_millis, event_time_from_ms  # noqa: F401
