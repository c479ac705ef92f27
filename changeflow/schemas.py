"""Declared schemas: the change envelope, the policy document and the five
normalized entities flattened out of it.

Nothing is inferred. Document leaves are parsed as VARIANT, of which scalars are
taken as text and cast to the output type afterwards (a typed ``from_json`` schema
would turn the quoted ``"2"`` into NULL for INT / BOOLEAN, while the pipeline casts the
text; a STRING leaf would return objects as text and lose digits of long numbers).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The image of one source row inside a change event; timestamps arrive as text.
IMAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("data", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

# Change envelope: before / after images, op code, connector time in ms.
ENVELOPE = T.StructType([
    T.StructField("before", IMAGE),
    T.StructField("after", IMAGE),
    T.StructField("op", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
])

# Source table shape: policy(id, data JSON text, created_at, updated_at).
SOURCE_TABLE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("data", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# Op codes: create, snapshot read, update, delete.
OPS_ALL = ("c", "r", "u", "d")
OPS_NO_DELETE = ("c", "r", "u")


@dataclass(frozen=True)
class Leaf:
    """One output column read from a JSON path.

    ``path`` is relative to the element of array level ``level`` (``-1`` =
    the innermost level of the entity, ``0`` = the first array level; for a
    root entity the path is relative to the document).
    """

    out: str
    path: tuple[str, ...]
    dtype: str = "string"
    level: int = -1


@dataclass(frozen=True)
class EntitySpec:
    """How one normalized table is cut out of the document.

    ``arrays`` is the chain of array fields walked (``()`` for the root
    entity, ``("vehicles", "drivers")`` for a two-level fan-out); ``caps``
    bounds each level (``None`` = no cap); ``required`` is the key leaf whose
    NULL drops the row; ``staging_skip`` lists position tuples the staging
    flatten leaves out.
    """

    name: str
    keys: tuple[str, ...]
    leaves: tuple[Leaf, ...]
    arrays: tuple[str, ...] = ()
    caps: tuple[int | None, ...] = ()
    required: str | None = None
    staging_skip: tuple[tuple[int, ...], ...] = ()
    time_column: str | None = None
    id_column: str = "policy_id"
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def columns(self) -> list[str]:
        cols = [self.id_column] + [lf.out for lf in self.leaves]
        if self.time_column:
            cols.append(self.time_column)
        return cols

    @property
    def child_keys(self) -> tuple[str, ...]:
        return tuple(k for k in self.keys if k != self.id_column)

    def output_schema(self) -> T.StructType:
        fields = [T.StructField(self.id_column, T.LongType())]
        for lf in self.leaves:
            fields.append(T.StructField(lf.out, T._parse_datatype_string(lf.dtype)))
        if self.time_column:
            fields.append(T.StructField(self.time_column, T.TimestampNTZType()))
        return T.StructType(fields)


DEC = "decimal(12,2)"

# ---------------------------------------------------------------------------
# Entity names, keys, JSON paths, output names and types, and
# the per-level array caps of the pipeline. They must stay as they are for
# results to match (caps: 5 coverages, 3 vehicles x 3 drivers, 5 claims; the
# staging driver flatten leaves out vehicles[2].drivers[2]).
# ---------------------------------------------------------------------------
POLICY = EntitySpec(
    name="policy",
    keys=("policy_id",),
    leaves=(
        Leaf("policy_number", ("policy_number",)),
        Leaf("status", ("status",)),
        Leaf("effective_date", ("effective_date",), "date"),
        Leaf("expiration_date", ("expiration_date",), "date"),
        Leaf("holder_first_name", ("policyholder", "first_name")),
        Leaf("holder_last_name", ("policyholder", "last_name")),
        Leaf("holder_dob", ("policyholder", "date_of_birth"), "date"),
        Leaf("holder_email", ("policyholder", "contact", "email")),
        Leaf("holder_phone", ("policyholder", "contact", "phone")),
        Leaf("holder_street", ("policyholder", "contact", "address", "street")),
        Leaf("holder_city", ("policyholder", "contact", "address", "city")),
        Leaf("holder_state", ("policyholder", "contact", "address", "state")),
        Leaf("holder_zip", ("policyholder", "contact", "address", "zip")),
    ),
    time_column="source_event_time",
)

COVERAGE = EntitySpec(
    name="coverage",
    keys=("policy_id", "coverage_type"),
    leaves=(
        Leaf("coverage_type", ("type",)),
        Leaf("coverage_limit", ("limit",), DEC),
        Leaf("deductible", ("deductible",), DEC),
        Leaf("premium", ("premium",), DEC),
    ),
    arrays=("coverages",),
    caps=(5,),
    required="coverage_type",
)

VEHICLE = EntitySpec(
    name="vehicle",
    keys=("policy_id", "vin"),
    leaves=(
        Leaf("vin", ("vin",)),
        Leaf("year_made", ("year",), "int"),
        Leaf("make", ("make",)),
        Leaf("model", ("model",)),
    ),
    arrays=("vehicles",),
    caps=(3,),
    required="vin",
)

DRIVER = EntitySpec(
    name="driver",
    keys=("policy_id", "vehicle_vin", "license_number"),
    leaves=(
        Leaf("vehicle_vin", ("vin",), level=0),
        Leaf("driver_name", ("name",)),
        Leaf("license_number", ("license_number",)),
        Leaf("is_primary", ("is_primary",), "boolean"),
    ),
    arrays=("vehicles", "drivers"),
    caps=(3, 3),
    required="license_number",
    staging_skip=((2, 2),),
)

CLAIM = EntitySpec(
    name="claim",
    keys=("policy_id", "claim_id"),
    leaves=(
        Leaf("claim_id", ("claim_id",)),
        Leaf("claim_date", ("date",), "date"),
        Leaf("amount", ("amount",), DEC),
        Leaf("status", ("status",)),
        Leaf("description", ("description",)),
    ),
    arrays=("claims_history",),
    caps=(5,),
    required="claim_id",
)

ENTITIES: dict[str, EntitySpec] = {s.name: s for s in (POLICY, COVERAGE, VEHICLE, DRIVER, CLAIM)}

# Ordering columns carried by every staging row: arrival order of the event
# (``seq``) and the element positions inside the document (``pos``, ``pos2``).
ORDER_COLUMNS = ("event_time", "seq", "pos", "pos2")
STAGING_META = ("op", "event_time", "seq", "pos", "pos2")


def document_schema(specs) -> T.StructType:
    """The part of the document the given entities read, all leaves VARIANT.

    Parsing with exactly this schema prunes everything else out of the JSON
    parser's output (one parse serves all requested entities).
    """
    tree: dict = {}
    for spec in specs:
        for lf in spec.leaves:
            node = tree
            if spec.arrays:
                lvl = lf.level if lf.level >= 0 else len(spec.arrays) - 1
                for a in spec.arrays[: lvl + 1]:
                    node = node.setdefault(("arr", a), {})
            for i, k in enumerate(lf.path):
                if i == len(lf.path) - 1:
                    node.setdefault(("leaf", k), None)
                else:
                    node = node.setdefault(("obj", k), {})

    def build(node: dict) -> T.StructType:
        fields = {}
        for (kind, name), child in node.items():
            if kind == "leaf":
                fields.setdefault(name, T.VariantType())
            elif kind == "obj":
                fields[name] = build(child)
            else:
                fields[name] = T.ArrayType(build(child))
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])

    return build(tree)
