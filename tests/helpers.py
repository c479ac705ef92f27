import json

from changeflow.sources.seeds import envelope


def msgs(spark, rows):
    return spark.createDataFrame(rows, "value string, seq long")


def doc(**kw):
    base = {"policy_number": "P", "status": "active", "coverages": [], "vehicles": [], "claims_history": []}
    base.update(kw)
    return base


def cov(t, premium=1.0):
    return {"type": t, "limit": 10, "deductible": 1, "premium": premium}


def ev(op, ts, pid, seq, before=None, after=None):
    return (envelope(op, ts, before=(pid, before) if before is not None else None,
                     after=(pid, after) if after is not None else None), seq)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


__all__ = ["msgs", "doc", "cov", "ev", "rows", "json"]
