"""States, reasons and labels that readers of the fact table rely on, and thresholds."""

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US

#: State to the energy bucket it falls into.
STATES = ("setup_changeover", "production", "planned_stop", "unplanned_stop", "maintenance", "idle")
MINUTES = {"setup_changeover": "setup_minutes", "production": "production_minutes", "planned_stop": "planned_stop_minutes", "unplanned_stop": "unplanned_stop_minutes", "maintenance": "maintenance_minutes", "idle": "idle_minutes"}
COMPONENTS = ("main", "uv", "ir", "motor")

FRACTIONAL = "csi_fractional_minute_reconciliation"
WALL_CLOCK = "csi_wall_clock_overlap_fallback"
CAPPED = "multi_event_sum_capped_to_coverage_budget"
WITHIN = "multi_event_sum_within_coverage_budget"
PASSTHROUGH = "dominant_event_passthrough"

BUDGET_TOLERANCE = 0.5
MATERIAL_DIFFERENCE = 0.5
FULL_HOUR = 59.5

#: Labels of the largest part of an opportunity score, and of none.
OPPORTUNITY_DRIVERS = ["High kWh per good unit", "High non-productive share", "Long time since last maintenance", "Elevated scrap rate"]
NO_OPPORTUNITY = "No strong canonical opportunity signal"

#: How well a machine's history supports a job, best first, and the share of a changeover that it costs.
SUPPORT_TIERS = {"Material + task history": 0.00, "Material + task-difficulty history": 0.10, "Material history only": 0.20, "Task-difficulty history only": 0.28, "Machine-family fallback": 0.55}
#: Share of a changeover that a later slot costs, by urgency.
URGENCY = {"High": 1.00, "Medium": 0.65, "Low": 0.35}
#: Weight of a row in the review queue, by how its inputs came about.
SUPPORT_PATHS = {"Direct canonical row": 1.0, "Adapted row": 0.85, "Defaulted row": 0.65}
#: Speeds in pieces an hour that are taken for real, by machine family; the last pair is for all others.
SPEEDS = {"024": (1000, 50000), "035": (500, 30000), "166": (500, 25000), "1262": (100, 20000), "1042": (1000, 50000), "1099": (500, 30000), "": (100, 50000)}
#: Words that mark a task or order as maintenance.
MAINTENANCE_WORDS = ("保養", "保养", "維護", "维护", "維修", "维修")
