"""Schemas and the fixed values of the data model."""

from __future__ import annotations

SAMPLES = "ts timestamp_ntz, tag string, value double"
ALARMS = "ts timestamp_ntz, seq long, tag string, level string, priority string, state string, value double, incident_id string, description string, zone string"
TRANSITIONS = "ts timestamp_ntz, seq long, tag string, transition string, message string, severity string, alarm_class string, stage string, level string, priority string, zone string, description string"
EPISODES = "tag string, level string, priority string, zone string, description string, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_min double, implicit boolean, standing boolean"
META = "key string, value string"
CONFIRMATIONS = "id string, signature string, incident_id string, root_tag string, alarm_types array<string>, zone string, confirmed_cause string, action_taken string, operator string, engine_top_pick_correct boolean, confirmed_at timestamp_ntz"

INCIDENTS = "incident_id string, started_at timestamp_ntz, ended_at timestamp_ntz, unit string, alarm_count long, status string"
INCIDENT_ALARMS = "incident_id string, tag string, description string, priority string, occurred_at timestamp_ntz, operator_id string, sequence_rank int"
CANDIDATES = "incident_id string, tag string, method string, rank int, confidence double, explanation string"
ACCURACY_PARTS = "day timestamp_ntz, method string, correct_count long, total_count long"

# The order of priorities.
PRIORITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
# ISA-18.2 rationalisation target, in per cent.
TARGET_MIX = {"CRITICAL": 1.0, "HIGH": 4.0, "MEDIUM": 15.0, "LOW": 80.0}
# EEMUA-191, alarms per operator and ten minutes.
TARGET_RATE, MANAGEABLE_PEAK, STANDING_HOURS = 1.0, 10.0, 24

# Alarm types by the first pattern that the lower-case message matches, in this order.
TYPE_PATTERNS = [
    ("GAS", r"gas (leak|emergency)|gasm"),
    ("WATER_LEAK", r"water leak"),
    ("TRIP", r"trip alarm"),
    ("FIRE_SUPERVISORY", r"trouble|supervisory|alarm signal|fas"),
    ("SECURITY", r"door open|gate barrier"),
    ("OFFLINE", r"offline"),
    ("COMMS_FAULT", r"bacnet error|error|fully operative|device operations"),
    ("SPACE_TEMP", r"space temp"),
    ("SETPOINT", r"set ?point"),
    ("TEMP_HIGH", r"(high|hex high).*temp|temp.*high|high temp"),
    ("TEMP_LOW", r"low.*temp|temp.*low"),
    ("AIR_TEMP", r"(dis|ra|ma|return) (air )?temp"),
    ("FAN", r"\bfan\b"),
    ("CHILLER", r"chiller"),
    ("MANUAL_MODE", r"manual mode"),
    ("METER", r"consumption|meter"),
    ("POWER", r"battery"),
]
# Priorities by severity text; classes and types that are critical whatever their severity.
SEVERITY_PRIORITY = {"1 - high": "HIGH", "2 - medium": "MEDIUM", "3 - low": "LOW", "central battery system-medium": "MEDIUM"}
SAFETY_CLASSES, SAFETY_TYPES = ["lifesafety"], ["GAS", "TRIP", "FIRE_SUPERVISORY"]

# What an alarm type usually means.
CAUSE_HINTS = {
    "OFFLINE": "Controller or network segment lost — check gateway, power and BACnet trunk",
    "COMMS_FAULT": "Field-bus / device communication error",
    "SPACE_TEMP": "VAV cannot hold space setpoint — check damper, reheat and airflow",
    "SETPOINT": "Setpoint deviation — schedule, occupancy or operator override",
    "TEMP_HIGH": "Cooling shortfall — check chilled-water supply, valve and coil",
    "TEMP_LOW": "Over-cooling / heating loss — check valve and controller output",
    "AIR_TEMP": "AHU/MAU discharge temperature off target — coil, valve or sensor",
    "FAN": "Fan command/status mismatch — starter, VFD or airflow proving",
    "CHILLER": "Chiller start/stop transition",
    "GAS": "Gas detection — safety response required",
    "WATER_LEAK": "Leak detection — isolate and inspect",
    "FIRE_SUPERVISORY": "Fire-system supervisory / trouble condition",
    "SECURITY": "Access-control event",
    "TRIP": "Equipment trip",
    "MANUAL_MODE": "Point left in manual / override — alarm suppressed at source",
    "METER": "Metering fault or consumption threshold",
    "POWER": "Power / battery system fault",
    "GENERAL": "Uncategorised device alarm — review point configuration",
}
# The first response to an alarm type.
ACTIONS = {
    "OFFLINE": "Confirm the controller/gateway has power and its BACnet trunk is up; ping the device before assuming a field fault.",
    "COMMS_FAULT": "Check the field-bus segment and device address; a single noisy device can take down the trunk.",
    "SPACE_TEMP": "Verify the VAV damper travels and reheat responds; confirm upstream AHU is delivering air.",
    "SETPOINT": "Check for an active schedule change, occupancy override, or a setpoint left in manual.",
    "TEMP_HIGH": "Trace the chilled-water loop: supply temperature, valve command vs. position, coil ΔT.",
    "TEMP_LOW": "Check the heating/cooling valve isn't stuck open and the controller output matches demand.",
    "AIR_TEMP": "Inspect the AHU/MAU coil, valve and discharge sensor against setpoint.",
    "FAN": "Confirm fan command vs. status and airflow proving; suspect the starter/VFD or a stuck damper.",
    "CHILLER": "Review the chiller start/stop sequence and any lockout; check condenser and flow.",
    "GAS": "Treat as a safety event first: verify detector reading, follow the gas-response procedure, then investigate cause.",
    "WATER_LEAK": "Isolate the affected zone and inspect physically before clearing.",
    "FIRE_SUPERVISORY": "Check the fire panel for the supervisory/trouble source; do not silence without confirming.",
    "SECURITY": "Review the access-control event; correlate with door/gate status.",
    "TRIP": "Confirm the equipment trip is real, check interlocks and the trip cause before any restart.",
    "MANUAL_MODE": "A point is in manual/override — its alarm is suppressed at source. Return it to auto once safe.",
    "METER": "Check the meter/consumption channel for a fault or a genuine threshold breach.",
    "POWER": "Check the power/battery system and any UPS status.",
    "GENERAL": "Review the point configuration and recent changes; the alarm is uncategorised.",
}

# The sentences of the recommendation rules, in the parts that stand around tags, zones and numbers.
SAYS = {
    "apply": ("Apply the previously confirmed fix for ", "."),
    "confirmed": ("This failure signature has been confirmed ", "× before"),
    "resolved": ("; last resolved by ", " on ", "."),
    "inspect": ("Inspect ", " first — "),
    "ranked": ("highest-ranked candidate",),
    "widen": ("Widen the deadband / add on-delay on ", " before chasing a process cause."),
    "chatters": (" chatters (", "% of its activations repeat within 60 s) — the alarm load here is an instrument-tuning problem, not a plant upset."),
    "check": ("Check ", " in the same sweep — they alarm together with ", "."),
    "partners": ("These sources co-fire with the lead candidate, so they likely share a cause or a common feed.",),
    "clear": ("Clear or rationalise the standing alarm(s) in ", " — they mask new events."),
    "masks": ("A permanently-active alarm in this console trains operators to ignore the annunciator.",),
}

# The synthetic plant. Name, unit, setpoint, noise, limits.
PLANT_TAGS = [
    ("REACTOR_TEMP", "degC", 118.0, 0.6, {"LO": 108.0, "HI": 126.0, "HIHI": 132.0}),
    ("REACTOR_PRESS", "bar", 1.4, 0.03, {"HI": 1.7, "HIHI": 1.9}),
    ("NH3_FLOW", "m3/h", 42.0, 0.8, {"LO": 34.0, "HI": 50.0}),
    ("PHOS_ACID_FLOW", "m3/h", 60.0, 1.0, {"LO": 50.0, "HI": 70.0}),
    ("SLURRY_DENSITY", "kg/m3", 1520.0, 6.0, {"LO": 1470.0, "HI": 1570.0}),
    ("SCRUBBER_PH", "pH", 6.2, 0.05, {"LOLO": 5.2, "LO": 5.6}),
    ("DRYER_TEMP", "degC", 190.0, 1.5, {"LO": 170.0, "HI": 210.0, "HIHI": 225.0}),
    ("PRODUCT_MOISTURE", "%", 1.2, 0.08, {"HI": 1.8, "HIHI": 2.2}),
    ("GRANULATOR_AMPS", "A", 310.0, 4.0, {"LO": 260.0, "HI": 360.0, "HIHI": 390.0}),
    ("RECYCLE_RATIO", "-", 4.5, 0.1, {"LO": 3.8, "HI": 5.4}),
]
# Priorities of the synthetic plant's levels.
LEVEL_PRIORITY = {"LO": "LOW", "HI": "LOW", "LOLO": "HIGH", "HIHI": "CRITICAL"}
# Fault scenarios. Key, root cause, chain of (tag, level, delay in minutes).
SCENARIOS = [
    ("SCRUBBER_DEGRADATION", "Scrubber recirc pump fouling", [("SCRUBBER_PH", "LO", 0.0), ("SCRUBBER_PH", "LOLO", 6.0), ("REACTOR_PRESS", "HI", 9.0), ("REACTOR_PRESS", "HIHI", 14.0)]),
    ("FEED_IMBALANCE", "NH3/acid ratio controller drift", [("NH3_FLOW", "HI", 0.0), ("REACTOR_TEMP", "HI", 5.0), ("REACTOR_TEMP", "HIHI", 11.0), ("DRYER_TEMP", "HI", 16.0)]),
    ("GRANULATOR_OVERLOAD", "Wet product recycle buildup", [("RECYCLE_RATIO", "HI", 0.0), ("GRANULATOR_AMPS", "HI", 7.0), ("PRODUCT_MOISTURE", "HI", 12.0), ("GRANULATOR_AMPS", "HIHI", 18.0)]),
]
# Fixed value: the source that chatters.
CHATTERING_TAG = "PHOS_ACID_FLOW"
