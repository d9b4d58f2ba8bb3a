"""Fixed values of the land-grading model."""

BIN_M = 0.6096
CY_PER_M3 = 1.30795061931439
FILL_RATIO = 1.2
M2_PER_ACRE = 4046.8564224
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
SPHERE_M = 6378137.0
NO_HEIGHT = -1000.0
NO_DATA = -9999.0
NEIGHBOURS = 64
SMOOTH_SIGMA = 3.0
SWELL = 1.3
SURVEY_SPACING_M = 3.048
RECUT_M = 3.0
MAX_SEGMENTS = 10
MIN_COVERAGE = 0.3
HEARTBEAT_MS = 60_000
THROTTLE_MS = 1000
STALE_MS = 2000
#: Thresholds of a GNSS receiver's state: Fix held, parked and stable for so long (ms), speed (mph) and jitter (mm) below.
RTK_MS, PARKED_MS, STABLE_MS, PARKED_MPH, JITTER_MM, FRAME_MS = 45_000, 5_000, 15_000, 0.2, 25.0, 60_000
RAIN_MM, CURVE_NUMBER = 50.0, 85.0
MASTER_ELEVATION_M = 30.48
#: Limits of a survey spike: rise, chord depth, slopes, spike height, shortest segment, longest run of points.
SPIKE_RISE_M, SPIKE_RUN_SLOPE, SPIKE_CHORD_M, SPIKE_SLOPE, SPIKE_HEIGHT_M, SPIKE_SEGMENT_M, SPIKE_RUN = 0.6096, 0.12, 0.3048, 0.08, 0.6096, 0.5, 12
#: The eight neighbours (dx, dy) in the order in which ties are decided.
AROUND = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
