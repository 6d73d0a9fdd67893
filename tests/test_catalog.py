"""One query of each kind against its DuckDB SQL on the smallest tables; skipped where these are not there. The driver compares all."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from loomline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def cells(rows, columns):
    out = []
    for r in rows:
        d = dict(zip(columns, r, strict=True))
        out.append(tuple(None if (v := d[c]) is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for c in sorted(columns)))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", [n for n in ("energy_backbone", "job_row_blend", "quantity_shadow_rows", "maintenance_trailing_counts", "readiness_taxonomy", "machine_opportunity", "weak_labels", "material_flow", "alias_resolution", "rule_risk_score", "risk_fallback_score", "candidate_scores", "hour_attribution", "attention_views", "audit_samples", "quality_flags") if n in catalog.ORACLES])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "customer", "nation", "lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), columns)


def test_quality_flags_count_no_job_where_every_hour_has_one(spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE events AS SELECT * FROM (VALUES (15, TIMESTAMP '2024-01-01 01:10:00', 0, 'purchase', 20.0), (16, TIMESTAMP '2024-01-01 01:20:00', 0, 'view', 5.0)) v(event_id, ts, user_id, event_type, value)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["quality_flags"](spark, str(tmp_path)).collect()]
    assert got == db.execute(catalog.ORACLES["quality_flags"]).fetchall() == [("no_job", 0)]
