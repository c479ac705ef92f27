"""JSON access on document text.

``json_value`` follows SQL JSON_VALUE: the scalar at a path as text, NULL
for a missing path, a JSON null, or an object / array. The document is
parsed into a VARIANT so scalars are told apart from nested values by type
(a string that merely looks like an object is still returned).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.casts import cast_leaf


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def variant_text(v: Column) -> Column:
    """A scalar variant as text; NULL for a JSON null, an object or an array."""
    text = F.try_variant_get(v, "$", "string")
    # objects and arrays begin with a bracket; few other texts do, so the kind is seldom asked for
    return F.when(~(text.startswith("{") | text.startswith("[")), text).when(
        ~F.substring(F.schema_of_variant(v), 1, 5).isin("OBJEC", "ARRAY"), text)


def json_value(doc: Column | str, path: str, dtype: str = "string",
               on_error: str = "null") -> Column:
    v = F.try_variant_get(F.try_parse_json(_col(doc)), path, "variant")
    return cast_leaf(variant_text(v), dtype, on_error)


def json_values(df: DataFrame, doc: Column | str, paths: Mapping[str, str | tuple[str, str]],
                on_error: str = "null") -> DataFrame:
    """``df`` with a column per name: ``json_value`` of one document at many paths, each a path
    or (path, type). The document is parsed once, in a projection of its own, which
    Spark doesn't merge into the next as this reads it more than once. A name that ``df`` has
    already is replaced, as by ``withColumns``.
    """
    parsed = "_doc"
    while parsed in df.columns or parsed in paths:
        parsed += "_"
    of = {name: (p, "string") if isinstance(p, str) else p for name, p in paths.items()}
    return df.withColumn(parsed, F.try_parse_json(_col(doc))).withColumns({
        name: cast_leaf(variant_text(F.try_variant_get(parsed, path, "variant")), dtype, on_error)
        for name, (path, dtype) in of.items()}).drop(parsed)


def json_text(doc: Column | str, key: str) -> Column:
    """``data->>'key'``: the top-level member as text (objects as JSON)."""
    return F.get_json_object(_col(doc), f"$.{key}")


def json_patch(doc: Column | str, patch: Column | str) -> Column:
    """Shallow top-level merge ``doc || patch``: members of ``patch`` replace
    members of ``doc`` with the same name; nested values are kept whole."""
    a = F.from_json(_col(doc), "map<string,variant>")
    b = F.from_json(_col(patch), "map<string,variant>")
    keep = F.map_filter(a, lambda k, _v: ~F.array_contains(F.map_keys(b), k))
    return F.to_json(F.map_concat(keep, b))


def summary_json(*cols: Column) -> Column:
    """Build one JSON object from named columns (``json_build_object``)."""
    return F.to_json(F.struct(*cols))
