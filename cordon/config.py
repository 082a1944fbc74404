"""Thresholds of the pipelines."""

#: Extent (min lon, min lat, max lon, max lat), seed search extent, tags, thresholds.
BBOX = (-0.681, 51.260, 0.423, 51.764)
CENTER_BBOX = (-0.267, 51.449, 0.009, 51.575)
ROAD_TYPES = "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link residential living_street".split()
PARK_TAGS = {"landuse": "park recreation_ground grass meadow forest nature_reserve cemetery".split(), "leisure": "park garden nature_reserve golf_course pitch common".split()}
WATER_TAGS = {"natural": "water wetland bay strait".split(), "landuse": "reservoir basin".split()}
PARK_MAX, WATER_MAX, WATER_SPURIOUS = 0.1, 0.1, 0.95
ROAD_BUFFER_M = 20.0
MAX_SPREAD_M = 1000.0
MAX_ETT_DIFF_S = 1000.0
SNAP_M = 100.0
SEED = 42
N_SEEDS, MAX_AREA_KM2, MAX_ITERATIONS, SA_ITERATIONS, SA_T_END = 5, 15.0, 300, 1000, 1.0
MIN_BLOCKS, CAP_MARGIN_KM2 = 20, 0.5
LOCAL_ZONE = "Europe/London"
