"""changeflow: change-event parsing, nested-document flattening, latest-state
resolution and keyed merges, written as Spark DataFrame / Structured Streaming jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from Column
expressions; IO (staging, keyed tables, manifests) and streaming wrap them.
"""

from changeflow.schemas import (  # noqa: F401
    ENTITIES,
    ENVELOPE,
    CLAIM,
    COVERAGE,
    DRIVER,
    POLICY,
    VEHICLE,
    EntitySpec,
    Leaf,
)

__version__ = "0.1.0"
