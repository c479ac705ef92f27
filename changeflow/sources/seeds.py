"""Seed policies and a live insert / update / delete scenario, as change events.

The documents are test fixtures; their values are fixed (they define the
expected row counts of the golden tests: 4 policies, 8 coverages, 6
vehicles, 8 drivers, 6 claims).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# The four seed documents and the scenario documents.
# ---------------------------------------------------------------------------


def _holder(first, last, dob, email, phone, street, city, state, zip_):
    return {"first_name": first, "last_name": last, "date_of_birth": dob,
            "contact": {"email": email, "phone": phone,
                        "address": {"street": street, "city": city, "state": state, "zip": zip_}}}


def _cov(t, limit, deductible, premium):
    return {"type": t, "limit": limit, "deductible": deductible, "premium": premium}


def _drv(name, lic, primary):
    return {"name": name, "license_number": lic, "is_primary": primary}


def _veh(vin, year, make, model, drivers):
    return {"vin": vin, "year": year, "make": make, "model": model, "drivers": drivers}


def _clm(cid, date, amount, status, desc):
    return {"claim_id": cid, "date": date, "amount": amount, "status": status, "description": desc}


SEED_DOCUMENTS = [
    {
        "policy_number": "POL-2024-00123", "status": "active",
        "effective_date": "2024-01-15", "expiration_date": "2025-01-15",
        "policyholder": _holder("Jane", "Doe", "1985-03-22", "jane.doe@example.com", "+1-555-0142",
                                "742 Evergreen Terrace", "Springfield", "IL", "62704"),
        "coverages": [_cov("liability", 500000, 1000, 1200.00), _cov("collision", 50000, 500, 800.00)],
        "vehicles": [_veh("1HGBH41JXMN109186", 2022, "Honda", "Civic",
                          [_drv("Jane Doe", "D400-1234-5678", True)])],
        "claims_history": [_clm("CLM-001", "2023-06-15", 4500.00, "closed", "Rear-end collision")],
    },
    {
        "policy_number": "POL-2024-00456", "status": "expired",
        "effective_date": "2023-03-01", "expiration_date": "2024-03-01",
        "policyholder": _holder("Robert", "Chen", "1978-11-08", "r.chen@example.com", "+1-555-0298",
                                "1600 Pennsylvania Ave", "Austin", "TX", "73301"),
        "coverages": [_cov("liability", 1000000, 2000, 1800.00), _cov("collision", 75000, 1000, 950.00),
                      _cov("comprehensive", 75000, 500, 600.00)],
        "vehicles": [_veh("5YJSA1DN5DFP14555", 2023, "Tesla", "Model S",
                          [_drv("Robert Chen", "C800-5678-9012", True), _drv("Linda Chen", "C800-9876-5432", False)]),
                     _veh("WBAPH5C55BA271443", 2021, "BMW", "328i", [_drv("Robert Chen", "C800-5678-9012", True)])],
        "claims_history": [_clm("CLM-002", "2023-09-20", 12000.00, "closed", "Side impact at intersection"),
                           _clm("CLM-003", "2024-01-05", 3200.00, "open", "Windshield damage from debris")],
    },
    {
        "policy_number": "POL-2024-00789", "status": "pending_renewal",
        "effective_date": "2024-06-01", "expiration_date": "2025-06-01",
        "policyholder": _holder("Maria", "Garcia", "1992-07-14", "maria.garcia@example.com", "+1-555-0376",
                                "456 Oak Boulevard", "Denver", "CO", "80202"),
        "coverages": [_cov("liability", 250000, 500, 750.00)],
        "vehicles": [_veh("JM1NDAL70R0100234", 2024, "Mazda", "MX-5 Miata",
                          [_drv("Maria Garcia", "G200-3456-7890", True), _drv("Carlos Garcia", "G200-6543-2109", False)])],
        "claims_history": [],
    },
    {
        "policy_number": "POL-2024-01050", "status": "active",
        "effective_date": "2024-04-01", "expiration_date": "2025-04-01",
        "policyholder": _holder("David", "Okafor", "1970-02-28", "david.okafor@example.com", "+1-555-0511",
                                "789 Maple Drive", "Portland", "OR", "97201"),
        "coverages": [_cov("liability", 750000, 1500, 1400.00), _cov("uninsured_motorist", 100000, 0, 350.00)],
        "vehicles": [_veh("1FTFW1ET5DFC10312", 2020, "Ford", "F-150", [_drv("David Okafor", "O100-7890-1234", True)]),
                     _veh("2HGFC2F59MH522145", 2021, "Honda", "Accord", [_drv("Sarah Okafor", "O100-4321-8765", True)])],
        "claims_history": [_clm("CLM-004", "2024-05-10", 8500.00, "closed", "Parking lot fender bender"),
                           _clm("CLM-005", "2024-08-22", 1500.00, "closed", "Hail damage"),
                           _clm("CLM-006", "2024-11-03", 22000.00, "open", "T-bone collision at red light")],
    },
]

LIVE_INSERT = {
    "policy_number": "POL-VERIFY-1", "status": "active",
    "effective_date": "2024-06-01", "expiration_date": "2025-06-01",
    "policyholder": _holder("Verify", "Script", "1990-01-01", "verify@test.com", "+1-555-0000",
                            "1 Verify Lane", "Testburg", "NY", "10001"),
    "coverages": [_cov("liability", 100000, 500, 600.00)],
    "vehicles": [_veh("VERIFY12345678901", 2024, "Toyota", "Camry",
                      [_drv("Verify Script", "V000-0000-0001", True)])],
    "claims_history": [],
}

# the update replaces the two arrays (top-level patch, right side wins)
LIVE_UPDATE_PATCH = {
    "coverages": [_cov("liability", 100000, 500, 600.00), _cov("collision", 50000, 1000, 475.00)],
    "vehicles": [_veh("VERIFY12345678901", 2024, "Toyota", "Camry", [_drv("Verify Script", "V000-0000-0001", True)]),
                 _veh("UPDATE98765432100", 2025, "Subaru", "Outback", [_drv("Verify Partner", "V000-0000-0002", True)])],
}

# ---------------------------------------------------------------------------


def envelope(op: str, ts_ms: int, before: tuple | None = None, after: tuple | None = None) -> str:
    """One change message as JSON text; images are ``(id, document dict)``."""
    def img(x):
        if x is None:
            return None
        return {"id": x[0], "data": json.dumps(x[1]), "created_at": None, "updated_at": None}
    return json.dumps({"before": img(before), "after": img(after), "op": op, "ts_ms": ts_ms})


def seed_messages(t0: int = 1_700_000_000_000) -> list[tuple[str, int]]:
    """The seeds as snapshot reads: ``(value, seq)`` rows, ids 1..4."""
    return [(envelope("r", t0 + i, after=(i + 1, d)), i + 1) for i, d in enumerate(SEED_DOCUMENTS)]


def scenario_messages(t0: int = 1_700_000_000_000) -> list[list[tuple[str, int]]]:
    """Four message batches: seeds, insert, update, delete (policy id 5)."""
    updated = {**LIVE_INSERT, **LIVE_UPDATE_PATCH}
    return [
        seed_messages(t0),
        [(envelope("c", t0 + 10_000, after=(5, LIVE_INSERT)), 5)],
        [(envelope("u", t0 + 20_000, before=(5, LIVE_INSERT), after=(5, updated)), 6)],
        [(envelope("d", t0 + 30_000, before=(5, updated)), 7)],
    ]


def messages_frame(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "value string, seq long")


def seed_policies(spark: SparkSession) -> DataFrame:
    """The source table rows ``(id, data)`` of the four seeds."""
    return spark.createDataFrame([(i + 1, json.dumps(d)) for i, d in enumerate(SEED_DOCUMENTS)],
                                 "id long, data string")
