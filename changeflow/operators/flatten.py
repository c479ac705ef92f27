"""Flatten nested documents into normalized rows, driven by an EntitySpec.

The document is parsed once (``parse_document``) with only the fields the
requested entities read. An array level becomes one ``posexplode`` over
``slice(array, 1, cap)`` where a cap is asked for, over the whole array
otherwise; the element position is kept (``pos`` / ``pos2``) as the order of the row
inside its event. Rows whose required key leaf is NULL are dropped.

``flatten_union`` is the index-access form (one projection per array index,
unioned; without caps, one projection over the indexes that each row's arrays
have); it gives the same rows and is kept as a cross-check.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.casts import cast_errors, cast_leaf
from changeflow.functions.json import variant_text
from changeflow.schemas import EntitySpec, document_schema

DOC = "_doc"
COMPAT = "compat"


def parse_document(df: DataFrame, specs, data_col: str = "data", out: str = DOC) -> DataFrame:
    """Add ``out``: ``data`` parsed with the union of the specs' paths."""
    specs = [specs] if isinstance(specs, EntitySpec) else list(specs)
    return df.withColumn(out, F.from_json(F.col(data_col), document_schema(specs)))


def _caps(spec: EntitySpec, caps):
    if caps == COMPAT:
        return spec.caps
    if caps is None:
        return (None,) * len(spec.arrays)
    return tuple(caps)


def _get(base: Column, path) -> Column:
    return reduce(lambda c, k: c.getField(k), path, base)


def _leaf_text(spec: EntitySpec, lf, elems) -> Column:
    if not spec.arrays:
        return variant_text(_get(elems[0], lf.path))
    lvl = lf.level if lf.level >= 0 else len(spec.arrays) - 1
    return variant_text(_get(elems[lvl], lf.path))


def _project(spec: EntitySpec, id_col: str, elems, meta, on_error: str, positions) -> list[Column]:
    cols = [F.col(id_col).cast("long").alias(spec.id_column)]
    texts = []
    for lf in spec.leaves:
        txt = _leaf_text(spec, lf, elems)
        texts.append((lf.out, txt, lf.dtype))
        cols.append(cast_leaf(txt, lf.dtype, on_error).alias(lf.out))
    if spec.time_column:
        cols.append(F.col("event_time").alias(spec.time_column))
    cols += [F.col(m) for m in meta]
    cols += positions
    if on_error == "quarantine":
        cols.append(cast_errors(texts).alias("_cast_errors"))
    return cols


def flatten(df: DataFrame, spec: EntitySpec, *, caps=None, skip=(), on_error: str = "null",
            id_col: str = "id", doc: str = DOC, meta=None) -> DataFrame:
    """Rows of ``spec`` out of each parsed document.

    ``df`` holds ``id_col``, the parsed ``doc`` and metadata columns (all
    other columns are carried as ``meta`` unless given). ``caps``: ``None`` = every
    array element, ``"compat"`` = the spec's caps, or a tuple per level. ``skip``:
    position tuples left out (the staging driver mask is ``spec.staging_skip``).
    """
    if doc not in df.columns:
        df = parse_document(df, spec, out=doc)
    if meta is None:
        meta = [c for c in df.columns if c not in (id_col, doc, "data", "before", "after")]
    meta = [m for m in meta if m not in ("pos", "pos2")]
    caps = _caps(spec, caps)
    if spec.time_column and "event_time" not in df.columns:
        raise ValueError(f"{spec.name}: needs an event_time column")

    if not spec.arrays:
        out = df.select(*_project(spec, id_col, [F.col(doc)], meta, on_error,
                                  [F.lit(0).alias("pos"), F.lit(0).alias("pos2")]))
        return out

    # walk the array levels: one posexplode per level, capped before explode
    cur = df.select(F.col(id_col), *[F.col(m) for m in meta], F.col(doc).alias("_e_root"))
    elem_cols = []
    parent = F.col("_e_root")
    carried = []
    for lvl, (arr, cap) in enumerate(zip(spec.arrays, caps)):
        a = parent.getField(arr)
        if cap is not None:
            a = F.slice(a, 1, cap)
        p, e = f"_p{lvl}", f"_e{lvl}"
        cur = cur.select(F.col(id_col), *[F.col(m) for m in meta], *[F.col(c) for c in carried],
                         F.posexplode(a).alias(p, e))
        carried += [p, e]
        elem_cols.append(F.col(e))
        parent = F.col(e)
    if skip:
        for pos in skip:
            hit = reduce(lambda x, y: x & y,
                         [F.col(f"_p{i}") == F.lit(v) for i, v in enumerate(pos)])
            cur = cur.filter(~hit)
    n = len(spec.arrays)
    positions = [F.col("_p0").alias("pos"),
                 (F.col("_p1") if n > 1 else F.lit(0)).alias("pos2")]
    out = cur.select(*_project(spec, id_col, elem_cols, meta, on_error, positions))
    if spec.required:
        out = out.filter(F.col(spec.required).isNotNull())
    return out


def flatten_union(df: DataFrame, spec: EntitySpec, *, caps=None, skip=(), on_error: str = "null",
                  id_col: str = "id", doc: str = DOC, meta=None) -> DataFrame:
    """Index-access form: one projection per array index, unioned.

    A level without a cap takes its indexes from the sizes of each row's own
    arrays, so every element comes out and the plan doesn't grow with them.
    """
    if doc not in df.columns:
        df = parse_document(df, spec, out=doc)
    if meta is None:
        meta = [c for c in df.columns if c not in (id_col, doc, "data", "before", "after")]
    caps = _caps(spec, caps)
    if not spec.arrays:
        return flatten(df, spec, caps=caps, on_error=on_error, id_col=id_col, doc=doc, meta=meta)
    if any(c is None for c in caps):
        return _flatten_indexed(df, spec, caps, skip, on_error, id_col, doc, meta)
    branches = []
    for idx in product(*[range(c) for c in caps]):
        if idx in set(map(tuple, skip)):
            continue
        elems, parent = [], F.col(doc)
        for arr, i in zip(spec.arrays, idx):
            parent = F.try_element_at(parent.getField(arr), F.lit(i + 1))
            elems.append(parent)
        positions = [F.lit(idx[0]).alias("pos"), F.lit(idx[1] if len(idx) > 1 else 0).alias("pos2")]
        branches.append(df.select(*_project(spec, id_col, elems, meta, on_error, positions)))
    out = reduce(DataFrame.unionByName, branches)
    if spec.required:
        out = out.filter(F.col(spec.required).isNotNull())
    return out


def _flatten_indexed(df: DataFrame, spec: EntitySpec, caps, skip, on_error: str, id_col: str, doc: str,
                     meta) -> DataFrame:
    """``flatten_union`` over the indexes that each row's arrays have."""
    cur = df.select(F.col(id_col), *[F.col(m) for m in meta], F.col(doc).alias("_e_root"))
    parent, elems = F.col("_e_root"), []
    for lvl, (arr, cap) in enumerate(zip(spec.arrays, caps)):
        a = parent.getField(arr)
        n = F.size(a) if cap is None else F.least(F.size(a), F.lit(cap))
        cur = cur.withColumn(f"_p{lvl}", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
        parent = F.try_element_at(a, F.col(f"_p{lvl}") + 1)
        elems.append(parent)
    for pos in skip:
        cur = cur.filter(~reduce(lambda x, y: x & y, [F.col(f"_p{i}") == F.lit(v) for i, v in enumerate(pos)]))
    positions = [F.col("_p0").alias("pos"), (F.col("_p1") if len(spec.arrays) > 1 else F.lit(0)).alias("pos2")]
    out = cur.select(*_project(spec, id_col, elems, meta, on_error, positions))
    if spec.required:
        out = out.filter(F.col(spec.required).isNotNull())
    return out


def flatten_events(events: DataFrame, spec: EntitySpec, *, how: str = "coalesce", staging: bool = False,
                   caps=None, on_error: str = "null") -> DataFrame:
    """Flatten image rows (``id, data, op, event_time, seq``) of one entity.

    ``staging=True`` applies the staging mask of the spec (``staging_skip``).
    """
    skip = spec.staging_skip if staging else ()
    meta = [c for c in ("op", "event_time", "seq", "batch_id") if c in events.columns]
    return flatten(events, spec, caps=caps, skip=skip, on_error=on_error, meta=meta)


def _child_keys(spec: EntitySpec, doc: Column, on_error: str) -> Column:
    """The keys of all array elements of a parsed document, one text each."""
    leaves = [lf for k in spec.child_keys for lf in spec.leaves if lf.out == k]

    def walk(parent: Column, lvl: int, elems: list) -> Column:
        arr = parent.getField(spec.arrays[lvl])
        if lvl == len(spec.arrays) - 1:
            return F.transform(arr, lambda e: F.to_json(F.struct(*[
                cast_leaf(_leaf_text(spec, lf, [*elems, e]), lf.dtype, on_error).alias(lf.out) for lf in leaves])))
        inner = F.transform(arr, lambda e: walk(e, lvl + 1, [*elems, e]))
        return F.flatten(F.filter(inner, lambda x: x.isNotNull()))

    return F.coalesce(walk(doc, 0, []), F.array().cast("array<string>"))


def vanished_children(events: DataFrame, spec: EntitySpec, caps=None,
                      on_error: str = "null") -> DataFrame:
    """Synthetic ``d`` rows for children present in an event's before-image
    and absent from its after-image (an update that dropped array elements).

    ``events`` are decoded envelopes (``before``, ``after``, ``op``,
    ``event_time``, ``seq``). The keys of both images are compared inside the row,
    so nothing is shuffled, and only events that lost a child are exploded. The
    after-image counts whole; ``caps`` bounds the elements of the before-image.
    """
    if not spec.arrays:
        raise ValueError("vanished_children applies to array entities")
    schema = document_schema([spec])
    base = (events.filter((F.col("op") == "u") & F.col("before.data").isNotNull())
            .select(F.col("before.id").alias("id"), F.col("after.id").alias("_after_id"), "event_time", "seq",
                    F.from_json(F.col("before.data"), schema).alias(DOC),
                    F.from_json(F.col("after.data"), schema).alias("_after")))
    had, has = _child_keys(spec, F.col(DOC), on_error), _child_keys(spec, F.col("_after"), on_error)
    gone = F.when(F.col("id").eqNullSafe(F.col("_after_id")), F.array_except(had, has)).otherwise(had)
    lost = base.withColumn("_gone", gone).filter(F.size("_gone") > 0)
    rows = flatten(lost, spec, caps=caps, on_error=on_error, meta=["event_time", "seq", "_gone"])
    rows = rows.filter(F.array_contains("_gone", F.to_json(F.struct(*spec.child_keys))))
    cols = [c for c in rows.columns if c not in ("event_time", "seq", "pos", "pos2", "_gone")]
    return rows.select(*cols, F.lit("d").alias("op"), "event_time", "seq", "pos", "pos2")
