"""Paths of documents, and those that no entity names."""

import json

from changeflow.operators.drift import document_paths, named_paths, unnamed_paths
from tests.helpers import cov, doc


def test_paths_and_kinds(spark):
    docs = [{"a": 1, "b": [{"c": "x"}, {"c": None}, 5], "d": {}, "e": {"f.g": True}}, {"a": "1", "b": [[1.5, [2]]]}, [3], "text", None]
    rows = [(json.dumps(d),) for d in docs] + [(None,), ("{broken",)]
    got = {(r.path, r.kind): r.n for r in document_paths(spark.createDataFrame(rows, "data string"), depth=3).collect()}
    assert got == {("$.a", "number"): 1, ("$.a", "string"): 1, ("$.b[*].c", "string"): 1, ("$.b[*].c", "null"): 1, ("$.b[*]", "number"): 1,
                   ("$.e.f.g", "boolean"): 1, ("$.b[*][*]", "number"): 1, ("$.b[*][*]", "array"): 1, ("$[*]", "number"): 1,
                   ("$", "string"): 1, ("$", "null"): 1}


def test_known_documents_have_no_unnamed_paths(spark):
    assert "$.vehicles[*].drivers[*].license_number" in named_paths() and "$.policyholder.contact.address.city" in named_paths()
    d = doc(coverages=[cov("a")], vehicles=[{"vin": "v", "drivers": [{"name": "n", "license_number": "l", "is_primary": True}]}])
    new = {**d, "coverages": [{**cov("a"), "rate": 2}, {**cov("b"), "rate": "low"}]}
    frame = spark.createDataFrame([(json.dumps(x),) for x in (d, new)], "data string")
    assert sorted(map(tuple, unnamed_paths(frame).collect())) == [("$.coverages[*].rate", "number", 1), ("$.coverages[*].rate", "string", 1)]
