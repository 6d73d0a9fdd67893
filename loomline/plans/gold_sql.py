"""DuckDB CTEs for the machine-hour fact, written from the definitions, for checking the Spark plans."""

from .bindings import DUCK

_O = "coalesce(setup_minutes,0) + coalesce(production_minutes,0) + coalesce(planned_stop_minutes,0) + coalesce(unplanned_stop_minutes,0)"
_BUSY = "greatest(coalesce(setup_minutes,0), coalesce(production_minutes,0), coalesce(planned_stop_minutes,0), coalesce(unplanned_stop_minutes,0)) > 0"

BACKBONE = DUCK + """,
bb AS MATERIALIZED (SELECT machine, hour_us, sum(kwh) FILTER (component = 'aggregate_total') AS tk, sum(cost) FILTER (component = 'aggregate_total') AS tc,
  sum(kwh) FILTER (component <> 'aggregate_total') AS pk, sum(cost) FILTER (component <> 'aggregate_total') AS pc,
  sum(kwh) FILTER (component = 'main') AS main_kwh, sum(kwh) FILTER (component = 'uv') AS uv_kwh, count(*) AS source_rows, list_sort(list(DISTINCT hash)) AS source_hashes
  FROM meters GROUP BY ALL),
backbone AS MATERIALIZED (SELECT machine, hour_us, CASE WHEN tk IS NOT NULL OR tc IS NOT NULL THEN tk ELSE pk END AS energy_kwh, CASE WHEN tk IS NOT NULL OR tc IS NOT NULL THEN tc ELSE pc END AS energy_cost, main_kwh, uv_kwh,
  CASE WHEN tk IS NOT NULL OR tc IS NOT NULL THEN 'aggregate_total_preferred' ELSE 'component_sum_fallback' END AS energy_method, source_rows, source_hashes FROM bb)"""

JOBS = BACKBONE + """,
pj AS MATERIALIZED (SELECT *, prep_end_us - changeover * 60000000 AS setup_us, prep_end_us AS from_us FROM jobs),
ov0 AS MATERIALIZED (SELECT b.machine, b.hour_us, pj.* EXCLUDE (machine),
  greatest(0, least(prep_end_us, b.hour_us + 3600000000) - greatest(setup_us, b.hour_us)) / 6e7 AS setup_overlap,
  greatest(0, least(prod_end_us, b.hour_us + 3600000000) - greatest(from_us, b.hour_us)) / 6e7 AS production_overlap,
  CASE WHEN prod_end_us > prep_end_us THEN (prod_end_us - prep_end_us) / 6e7 END AS win
  FROM backbone b JOIN pj ON pj.machine = b.machine AND pj.setup_us < b.hour_us + 3600000000 AND pj.prod_end_us > b.hour_us),
ov AS MATERIALIZED (SELECT *, setup_overlap + production_overlap AS total_overlap, coalesce(win IS NOT NULL AND prod_min + planned_min + unplanned_min - win <= greatest(5.0, win * 0.05), false) AS fractional FROM ov0 WHERE setup_overlap + production_overlap > 0),
om AS MATERIALIZED (SELECT *, CASE WHEN fractional THEN prod_min * (production_overlap / win) ELSE production_overlap END AS production,
  CASE WHEN fractional THEN planned_min * (production_overlap / win) END AS planned, CASE WHEN fractional THEN unplanned_min * (production_overlap / win) END AS unplanned FROM ov),
seg AS (SELECT machine, hour_us, greatest(setup_us, hour_us) AS s, least(prep_end_us, hour_us + 3600000000) AS e FROM om UNION ALL SELECT machine, hour_us, greatest(from_us, hour_us), least(prod_end_us, hour_us + 3600000000) FROM om),
pts AS (SELECT machine, hour_us, s AS p FROM seg WHERE e > s UNION SELECT machine, hour_us, e FROM seg WHERE e > s),
nxt AS (SELECT *, lead(p) OVER (PARTITION BY machine, hour_us ORDER BY p) AS q FROM pts),
cov AS MATERIALIZED (SELECT machine, hour_us, least(60.0, sum(q - p) / 6e7) AS coverage FROM nxt WHERE q IS NOT NULL AND EXISTS (SELECT 1 FROM seg WHERE seg.machine = nxt.machine AND seg.hour_us = nxt.hour_us AND seg.s <= nxt.p AND seg.e >= nxt.q) GROUP BY ALL),
blend0 AS (SELECT machine, hour_us, sum(setup_overlap) AS s, sum(production) AS p, coalesce(sum(planned), 0) AS l, coalesce(sum(unplanned), 0) AS u, count(*) AS n_jobs, bool_and(fractional) AS all_fractional FROM om GROUP BY ALL),
blend AS MATERIALIZED (SELECT machine, hour_us, n_jobs, all_fractional, coverage, s + p + l + u AS raw_minutes, CASE WHEN s + p + l + u > coverage + 1e-9 THEN coverage / (s + p + l + u) ELSE 1.0 END AS scale,
  CASE WHEN s + p + l + u > coverage + 1e-9 THEN 'multi_event_sum_capped_to_coverage_budget' WHEN n_jobs > 1 THEN 'multi_event_sum_within_coverage_budget' ELSE 'dominant_event_passthrough' END AS contract,
  CASE WHEN s + p + l + u > coverage THEN coverage * (s / (s + p + l + u)) ELSE s END AS setup_minutes, CASE WHEN s + p + l + u > coverage THEN coverage * (p / (s + p + l + u)) ELSE p END AS production_minutes, CASE WHEN s + p + l + u > coverage THEN coverage * (l / (s + p + l + u)) ELSE l END AS planned_stop_minutes, CASE WHEN s + p + l + u > coverage THEN coverage * (u / (s + p + l + u)) ELSE u END AS unplanned_stop_minutes FROM blend0 JOIN cov USING (machine, hour_us)),
dom AS MATERIALIZED (SELECT * FROM om QUALIFY row_number() OVER (PARTITION BY machine, hour_us ORDER BY total_overlap DESC, production_overlap DESC, hash) = 1),
fj0 AS (SELECT b.*, d.hash AS job_hash, d.order_id, d.suffix AS order_suffix, d.material, d.task, d.leader, d.production AS lead_production, d.fractional AS lead_fractional, d.job_good, d.job_scrap,
  n_jobs, all_fractional, coverage, raw_minutes, scale, contract, CASE WHEN abs(setup_minutes) >= 1e-9 THEN setup_minutes END AS setup_minutes, CASE WHEN abs(production_minutes) >= 1e-9 THEN production_minutes END AS production_minutes,
  CASE WHEN abs(planned_stop_minutes) >= 1e-9 THEN planned_stop_minutes END AS planned_stop_minutes, CASE WHEN abs(unplanned_stop_minutes) >= 1e-9 THEN unplanned_stop_minutes END AS unplanned_stop_minutes,
  CASE WHEN blend.setup_minutes > 0 THEN 'setup_changeover' WHEN blend.production_minutes > 0 THEN 'production' WHEN blend.planned_stop_minutes > 0 THEN 'planned_stop' WHEN blend.unplanned_stop_minutes > 0 THEN 'unplanned_stop' END AS machine_state
  FROM backbone b LEFT JOIN blend USING (machine, hour_us) LEFT JOIN dom d USING (machine, hour_us)),
fj AS MATERIALIZED (SELECT *, CASE WHEN machine_state IS NOT NULL THEN CASE WHEN n_jobs > 1 THEN 'medium' ELSE 'high' END END AS state_confidence, CASE WHEN n_jobs > 1 THEN 1 ELSE 0 END AS several_jobs FROM fj0)"""

QUANTITY = JOBS + f""",
fq0 AS (SELECT *, CASE WHEN lead_production > 0 THEN lead_production ELSE production_minutes END AS row_basis FROM fj),
fq1 AS (SELECT *, CASE WHEN job_hash IS NOT NULL THEN sum(CASE WHEN row_basis > 0 THEN row_basis END) OVER (PARTITION BY job_hash) END AS tot, CASE WHEN row_basis > 0 THEN row_basis END AS pb FROM fq0),
fq2 AS (SELECT *, job_good * pb / tot AS good_qty, job_scrap * pb / tot AS scrap_qty, pb / tot AS basis_share FROM fq1),
fq AS MATERIALIZED (SELECT *, CASE WHEN job_hash IS NULL THEN 'csi_qty_missing_source_row_hash' WHEN coalesce(row_basis, 0) <= 0 THEN 'csi_qty_no_positive_production_minutes' END AS qty_warning,
  CASE WHEN job_hash IS NULL THEN NULL WHEN production_minutes > 60 THEN 'production_minutes_gt_60' WHEN {_O} > 60.5 THEN 'operational_minutes_exceed_hour_budget' END AS budget_anomaly,
  production_minutes - row_basis AS basis_gap,
  CASE WHEN job_hash IS NULL THEN NULL WHEN coalesce(row_basis, 0) <= 0 THEN 'missing_positive_row_basis_minutes' WHEN production_minutes IS NULL THEN 'missing_row_production_minutes' WHEN good_qty IS NULL AND scrap_qty IS NULL THEN 'no_quantity_allocated' WHEN abs(production_minutes - row_basis) > 0.5 THEN 'material_misaligned' ELSE 'aligned' END AS alignment,
  CASE WHEN good_qty IS NOT NULL OR scrap_qty IS NOT NULL THEN CASE WHEN lead_fractional THEN 'high' ELSE 'medium' END END AS qty_confidence FROM fq2)"""

REPORTS = QUANTITY + """,
rep AS MATERIALIZED (SELECT f.machine, f.hour_us, r.report_us, r.hash AS report_hash, r.manpower FROM fq f JOIN reports r ON r.machine = f.machine AND r.order_id = f.order_id AND r.suffix = f.order_suffix AND r.report_us // 86400000000 = f.hour_us // 86400000000
  QUALIFY row_number() OVER (PARTITION BY f.machine, f.hour_us ORDER BY (r.manpower > 0) DESC, abs(r.report_us - f.hour_us - 3600000000), r.hash) = 1)"""

MAINTENANCE = REPORTS + """,
lastw AS MATERIALIZED (SELECT b.machine, b.hour_us, w.txn_us AS last_us, w.hash AS last_hash, w.work_type AS last_work_type FROM backbone b JOIN works w ON w.machine = b.machine AND w.txn_us < b.hour_us QUALIFY row_number() OVER (PARTITION BY b.machine, b.hour_us ORDER BY w.txn_us DESC, w.hash DESC) = 1),
trail AS MATERIALIZED (SELECT b.machine, b.hour_us,
  CASE WHEN count(DISTINCT work_order) FILTER (txn_us >= hour_us - 604800000000 AND txn_us < hour_us) > 0 THEN count(DISTINCT work_order) FILTER (txn_us >= hour_us - 604800000000 AND txn_us < hour_us) ELSE count(txn_us) FILTER (txn_us >= hour_us - 604800000000 AND txn_us < hour_us) END AS works_7d,
  CASE WHEN count(DISTINCT work_order) FILTER (txn_us >= hour_us - 2592000000000 AND txn_us < hour_us) > 0 THEN count(DISTINCT work_order) FILTER (txn_us >= hour_us - 2592000000000 AND txn_us < hour_us) ELSE count(txn_us) FILTER (txn_us >= hour_us - 2592000000000 AND txn_us < hour_us) END AS works_30d,
  CASE WHEN count(DISTINCT work_order) FILTER (txn_us < hour_us) > 0 THEN count(DISTINCT work_order) FILTER (txn_us < hour_us) ELSE count(txn_us) FILTER (txn_us < hour_us) END AS works_ever,
  CASE WHEN count(DISTINCT work_order) FILTER (txn_us >= hour_us AND txn_us < hour_us + 3600000000) > 0 THEN count(DISTINCT work_order) FILTER (txn_us >= hour_us AND txn_us < hour_us + 3600000000) ELSE count(txn_us) FILTER (txn_us >= hour_us AND txn_us < hour_us + 3600000000) END AS works_in_hour,
  list_sort(list(DISTINCT work_type) FILTER (txn_us >= hour_us AND txn_us < hour_us + 3600000000)) AS work_types
  FROM backbone b LEFT JOIN works w ON w.machine = b.machine GROUP BY b.machine, b.hour_us)"""

FACT = MAINTENANCE + f""",
fm AS (SELECT fq.*, report_us, report_hash, manpower, CASE WHEN manpower > 0 THEN round_even(manpower, 0) END AS team_size, last_us, last_hash, last_work_type, works_7d, works_30d, works_ever, works_in_hour, work_types,
  (hour_us - last_us) / 3.6e9 AS hours_since, CASE WHEN works_in_hour > 0 THEN 1 ELSE 0 END AS maintenance_in_hour
  FROM fq LEFT JOIN rep USING (machine, hour_us) LEFT JOIN lastw USING (machine, hour_us) LEFT JOIN trail USING (machine, hour_us)),
fi0 AS (SELECT *, {_O} AS assigned, CASE WHEN job_hash IS NULL THEN 'idle_missing_csi_source' WHEN maintenance_in_hour = 1 THEN 'idle_same_hour_maintenance' WHEN NOT all_fractional THEN 'idle_non_fractional_csi_minutes' WHEN coverage < 59.5 THEN 'idle_partial_csi_coverage' WHEN 60 - ({_O}) <= -0.5 THEN 'idle_negative_residual' END AS idle_skipped FROM fm),
fi1 AS (SELECT *, CASE WHEN idle_skipped IS NULL THEN CASE WHEN abs(60 - assigned) < 0.5 THEN 0.0 ELSE 60 - assigned END END AS idle_minutes, {_BUSY} AS busy FROM fi0),
fi AS (SELECT * REPLACE (CASE WHEN idle_minutes > 0 AND NOT busy THEN 'idle' ELSE machine_state END AS machine_state, CASE WHEN idle_minutes > 0 AND NOT busy THEN 'high' ELSE state_confidence END AS state_confidence) FROM fi1),
fr AS (SELECT *, CASE WHEN maintenance_in_hour = 0 THEN 'maintenance_state_no_same_hour_maintenance' WHEN several_jobs <> 0 THEN 'maintenance_state_multiple_csi_overlap' WHEN busy THEN 'maintenance_state_conflicting_operational_minutes'
  WHEN greatest(coalesce(good_qty, 0), coalesce(scrap_qty, 0)) > 0 THEN 'maintenance_state_conflicting_quantity' WHEN machine_state IS NOT NULL AND machine_state <> 'idle' THEN 'maintenance_state_existing_non_idle_state' WHEN job_hash IS NOT NULL AND coverage >= 1 THEN 'maintenance_state_existing_csi_overlap' END AS promotion_blocked FROM fi),
fact AS MATERIALIZED (SELECT * REPLACE (CASE WHEN promotion_blocked IS NULL THEN 'maintenance' ELSE machine_state END AS machine_state, CASE WHEN promotion_blocked IS NULL THEN 'low' ELSE state_confidence END AS state_confidence), make_timestamp(hour_us) AS hour_ts FROM fr)"""
