"""Fixed values. They must equal the published ones for results to match."""

import math

# --- fixed values: income classes (label, lower, midpoint, width) ---
INCOME_CLASSES = [
    ("No Employed Person", 0, 0, 0),
    ("Below $1,000", 0, 500, 1000),
    ("$1,000 - $1,999", 1000, 1500, 1000),
    ("$2,000 - $2,999", 2000, 2500, 1000),
    ("$3,000 - $3,999", 3000, 3500, 1000),
    ("$4,000 - $4,999", 4000, 4500, 1000),
    ("$5,000 - $5,999", 5000, 5500, 1000),
    ("$6,000 - $6,999", 6000, 6500, 1000),
    ("$7,000 - $7,999", 7000, 7500, 1000),
    ("$8,000 - $8,999", 8000, 8500, 1000),
    ("$9,000 - $9,999", 9000, 9500, 1000),
    ("$10,000 - $10,999", 10000, 10500, 1000),
    ("$11,000 - $11,999", 11000, 11500, 1000),
    ("$12,000 - $12,999", 12000, 12500, 1000),
    ("$13,000 - $13,999", 13000, 13500, 1000),
    ("$14,000 - $14,999", 14000, 14500, 1000),
    ("$15,000 - $17,499", 15000, 16250, 2500),
    ("$17,500 - $19,999", 17500, 18750, 2500),
    ("$20,000 & Over", 20000, 25000, 5000),
]

# --- fixed values: interpolation knots ---
PERCENTILE_KNOTS = [0, 20, 40, 60, 80, 100]
INCOME_KNOTS = [0, 1921.009795, 5744.422399, 9972.452913, 15623.84812, 25000]
EXPENDITURE_KNOTS = [0, 4149.4, 5381.3, 6985.6, 8257.2, 10820.1]
OWNERSHIP_MIDPOINTS = [500, 1500, 2500, 3500, 4500, 5500, 7000, 9000, 11000, 13500, 17500]
OWNERSHIP_VALUES = [1.3, 7.6, 18.5, 31.9, 44.0, 50.6, 63.2, 73.1, 76.7, 88.5, 87.7]
OWNERSHIP_EDGES = [0, 1000, 2000, 3000, 4000, 5000, 6000, 8000, 10000, 12000, 15000, 20000]
VEHICLE_EDGES = [0, 20, 40, 60, 80, 100]
VEHICLE_VALUES = [276.9, 381.2, 652.9, 812.4, 1243.2]

# --- fixed values: zone groups ---
CORE_AREAS = ["DOWNTOWN CORE", "STRAITS VIEW"]
CENTRAL_AREAS = [
    "DOWNTOWN CORE", "STRAITS VIEW", "ORCHARD", "ROCHOR", "OUTRAM",
    "SINGAPORE RIVER", "MUSEUM", "NEWTON", "RIVER VALLEY",
    "MARINA SOUTH", "MARINA EAST",
]

# --- fixed values: footprint matching ---
NAME_RADIUS_M = 50
NAME_THRESHOLD = 70
CATEGORY_TAG_RULES = {
    "mall": {"shop": ["mall"], "building": ["retail", "commercial"]},
    "hawker centre": {"amenity": ["food_court", "hawker_centre", "marketplace"]},
    "park": {"leisure": ["park"]},
}
# subtype -> (min, typical_min, typical_max, max), square metres
AREA_LIMITS = {
    "mall": (500, 2000, 100000, 200000),
    "lifestyle_street": (200, 1000, 50000, 100000),
    "hawker_centre": (300, 800, 5000, 15000),
    "museum": (100, 500, 20000, 50000),
    "theatre": (300, 1500, 15000, 25000),
    "historic_site": (100, 500, 10000, 50000),
    "monument": (50, 100, 3000, 10000),
    "park": (500, 2000, 500000, 1500000),
}
AREA_LIMITS_DEFAULT = (100, 500, 50000, 200000)

# --- fixed values: sampling around places ---
SAMPLING_PLAN = {  # subtype -> (buffer m, spacing m, source)
    "historic_site": (150, 30, "landmark_radial"),
    "monument": (150, 30, "landmark_radial"),
    "park": (50, 50, "park_near_edge"),
    "mall": (300, 40, "network_accessibility"),
    "hawker": (300, 40, "network_accessibility"),
    "museum": (300, 40, "network_accessibility"),
    "theatre": (300, 40, "network_accessibility"),
    "lifestyle_street": (80, 25, "street_corridor"),
}
LANDMARK_SUBTYPES = ["historic_site", "monument", "momument"]
RING_RADII_M = [50, 100, 150, 200]
RING_POINTS = 8
LAT_RANGE = (1.0, 2.0)
LON_RANGE = (103.0, 105.0)
EPS_BY_SOURCE = {"network_accessibility": 25, "landmark_radial": 10, "park_near_edge": 20}
EPS_DEFAULT = 20

# --- fixed values: image selection ---
MIN_IMAGES = {"1": 20, "2": 18, "3": 15, "5": 10, "6": 10, "7": 12, "8": 12, "9": 25}
MIN_IMAGES_DEFAULT = 15
CAPACITY = {"1": 50, "2": 45, "3": 40, "5": 30, "6": 30, "7": 35, "8": 35, "9": 60}
CAPACITY_DEFAULT = 40
FIRST_IMAGE_YEAR = 2019
PANORAMA_SHARE = 0.30
SCORE_WEIGHTS = {"recency": 0.40, "diversity": 0.30, "balance": 0.20, "panorama": 0.10}
PAIR_WEIGHTS = {"spatial": 0.6, "angular": 0.4}

# --- fixed values: perception features (feature -> mask classes, detector classes, weight) ---
FEATURE_SOURCES = {
    "greenery": (["vegetation", "terrain"], ["potted plant"], 0.10),
    "sky_visibility": (["sky"], [], 0.00),
    "building_frontage": (["building", "wall"], [], 0.00),
    "ground_surface": (["road", "sidewalk"], [], 0.00),
    "lighting_presence": (["traffic light"], ["traffic light"], 0.80),
    "pedestrian_presence": (["person", "rider", "bicycle"], ["person", "bicycle"], 0.50),
    "vehicle_presence": (["car", "truck", "bus", "train", "motorcycle"],
                         ["car", "motorcycle", "bus", "truck"], 0.40),
    "signage_density": (["traffic sign"], ["stop sign", "clock"], 0.90),
    "street_furniture": (["fence", "pole"], ["bench", "fire hydrant", "parking meter"], 0.70),
}
CONFIDENCE_MIN = 0.3
DETECTION_CAP = 5
ACTIVITY_OF_CLASS = {
    "bicycle": "transport", "car": "transport", "motorcycle": "transport", "bus": "transport",
    "truck": "transport", "person": "leisure", "bench": "leisure", "potted plant": "leisure",
    "sports ball": "leisure", "kite": "leisure", "skateboard": "leisure", "surfboard": "leisure",
    "stop sign": "commercial", "traffic light": "commercial", "parking meter": "commercial",
    "fire hydrant": "commercial", "dining table": "dining", "chair": "dining", "bottle": "dining",
    "cup": "dining", "fork": "dining", "knife": "dining", "spoon": "dining", "bowl": "dining",
}
ACTIVITY_KINDS = 4
HUE_BINS = 18
DIMENSION_WEIGHTS = {
    "vibrancy": {"pedestrian_presence": 0.45, "building_frontage": 0.30,
                 "signage_density": 0.20, "activity_diversity": 0.05},
    "pleasantness": {"greenery": 0.40, "sky_visibility": 0.30,
                     "architectural_variety": 0.20, "vehicle_presence": -0.30},
    "walkability": {"ground_surface": 0.35, "shading_coverage": 0.40,
                    "greenery": 0.15, "vehicle_presence": -0.10},
    "safety": {"lighting_presence": 0.30, "pedestrian_presence": 0.30,
               "sky_visibility": 0.20, "street_furniture": 0.20},
    "experiential": {"architectural_variety": 0.45, "activity_diversity": 0.10,
                     "signage_density": 0.25, "street_furniture": 0.20},
}
HALF_LIFE_DAYS = 365
DECAY_RATE = math.log(2) / HALF_LIFE_DAYS
PRIOR_MIX = 0.6
PRIOR_STRENGTH = 4
N_EFF_NORMAL = 5
PLAIN_VIEW_WEIGHT = 0.75

# --- fixed values: travel cost ---
VALUE_OF_TIME = 0.20
TRANSFER_PENALTY_MIN = 5.0
COST_PER_KM = 0.25
ROAD_CHARGE = {(0, 1): 2.0, (0, 2): 3.0, (1, 2): 1.5, (2, 2): 1.0, (1, 1): 0.5}
PARKING_FEE = {2: 6.0, 1: 4.0}
PARKING_FEE_DEFAULT = 1.5

# --- fixed values: flow model ---
BETA_COST = -0.0074
BETA_MEDIUM = 0.4485
BETA_LARGE = 0.6691
TRIP_RATE = 0.20
TRIP_RATE_CORE = 0.30
GAMMA_CAR = 0.3
CATEGORY_CODES = {
    "mall": 0, "lifestyle street": 0, "hawker centre": 2, "museum": 3,
    "theatre": 3, "monument": 4, "historic site": 5, "park": 5,
}
CATEGORY_DEFAULT = 5
SPARSE_COUNT = 10

# --- fixed values: survey coding ---
LEVEL_DELTAS = {
    "car_time": {0: -4, 1: 0, 2: 5, 3: 9, 4: 14},
    "car_cost": {0: -1, 1: 0, 2: 1, 3: 2, 4: 4},
    "pt_time": {0: -9, 1: 0, 2: 9, 3: 17, 4: 32},
    "pt_cost": {0: -1, 1: 0, 2: 0, 3: 0, 4: 1},
    "pt_transfer": {0: -1, 1: 0, 2: 0, 3: 0, 4: 1},
}
INCOME_CODE_MIDPOINTS = {
    1: 0, 2: 500, 3: 1500, 4: 2500, 5: 3500, 6: 4500, 7: 5500, 8: 6500, 9: 7500,
    10: 8500, 11: 9500, 12: 10500, 13: 11500, 14: 13500, 15: 17500, 16: 25000,
}
AGE_CODE_MIDPOINTS = {1: 24, 2: 35, 3: 45, 4: 55, 5: 65}
MIN_DURATION_SEC = 180
ATTENTION_VALUE = 4
RETEST_TASK = 3
FIRST_BLOCK_OFFSET = 3

# --- fixed values: published priors (mean, sd) for the count model ---
SIZE_PRIORS = {"beta_med": (0.4485, 0.1455), "beta_lrg": (0.6691, 0.1367)}
DISPERSION_PRIOR_SD = 2.0

# --- fixed values: sensitivity grid ---
BASE_PARAMETERS = {"half_life": 365, "kappa": 4, "alpha": 0.6}
PARAMETER_GRID = {"half_life": [270, 365, 730], "kappa": [2, 4, 15], "alpha": [0.0, 0.6, 1.0]}
