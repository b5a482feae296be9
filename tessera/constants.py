"""Fixed values.  They must equal the published ones for results to agree."""

from __future__ import annotations

# Tokens that mean "null" in the hospital CSV files.
NULL_TOKENS = ("", "NULL", "NA", "N/A", "___")

# Flags, tube holds and durations that are recorded as laboratory types but
# carry no measurement; they never enter a video grid.
EXCLUDED_ITEMIDS = (
    50934,  # H, haemolysed flag
    51678,  # L, lipaemic flag
    50947,  # I, icteric flag
    50933,  # green top hold
    50955,  # light green top hold
    50887,  # blue top hold
    50979,  # red top hold
    51103,  # urine hold
    51107,  # urine tube, held
    52033,  # specimen type
    50919,  # EDTA hold
    51087,  # length of urine collection
)

# Right-skewed laboratory types that get log(1 + x) before scaling.
LOG_ITEMIDS = (
    50861,  # alanine aminotransferase
    50863,  # alkaline phosphatase
    50878,  # aspartate aminotransferase
    50885,  # bilirubin, total
    50910,  # creatine kinase
    50911,  # creatine kinase, MB
    50954,  # lactate dehydrogenase
    50956,  # lipase
    51003,  # troponin T
    51265,  # platelets
    51301,  # white blood cells
    52069,  # basophils, absolute
    52073,  # eosinophils, absolute
    52074,  # monocytes, absolute
    52075,  # neutrophils, absolute
)

CLIP = (-10.0, 10.0)
MIN_STD = 1e-8

VIDEO_SHAPE = (8, 8)
IMAGE_SHAPE = (16, 16)
WINDOW_HOURS = 24.0
BIN_HOURS = 1.0
LOOKBACK_HOURS = 24

PERCENTS = (5, 25, 50, 75, 95)
SWEEP_SIZES = (64, 100, 144, 256)

# (label, from hours, to hours), half open.
DURATION_BUCKETS = (
    ("<24h", 0.0, 24.0),
    ("24h–72h", 24.0, 72.0),
    ("72h–7d", 72.0, 168.0),
    ("7d–14d", 168.0, 336.0),
    (">14d", 336.0, 1e9),
)

MIN_SPECIMENS_STEPS = (4, 8, 16, 24, 32, 48, 64)
MIN_LABS_STEPS = (20, 30, 50, 80, 100)
