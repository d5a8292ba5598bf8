"""Fixed values that must equal the reference's for identical results.

Everything here is a plain literal, listed in its natural order.  Operators turn
these into column expressions or tiny literal dimensions; none of them grows
with the data.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: component weight model (kg for a 1000 kVA three-phase unit)
# component: (base_kg, exponent, large_unit_factor, voltage_adjust,
#             single_phase_factor, ultra_large_factor, priced_material)
# ---------------------------------------------------------------------------
COMPONENTS = [
    ("core", 1200.0, 0.60, 0.75, 0.05, 0.70, 1.00, "electrical_steel"),
    ("copper", 2300.0, 0.65, 0.70, 0.12, 0.80, 0.90, "copper"),
    ("insulation", 600.0, 0.55, 0.80, 0.25, 0.85, 0.85, "insulation_materials"),
    ("tank", 1000.0, 0.50, 0.75, 0.10, 0.75, 0.95, "steel"),
    ("oil", 900.0, 0.60, 0.80, 0.15, 0.70, 0.90, "mineral_oil"),
]
COMPONENT_NAMES = [c[0] for c in COMPONENTS]
LARGE_THRESHOLD_KVA = 5000.0
ULTRA_THRESHOLD_KVA = 50000.0
ULTRA_MAX_REDUCTION = 0.35
# power-density targets (kVA/kg): up to 100 MVA, up to 200 MVA, above
DENSITY_TARGETS = [(100000.0, 1.5), (200000.0, 1.8), (None, 2.2)]
DENSITY_SLACK = 0.9

# FIXED VALUES: phase spellings understood directly by the weight model
PHASE_SPELLINGS = {
    "single": "single", "three": "three",
    "Single-phase": "single", "Three-phase": "three",
    "single-phase": "single", "three-phase": "three",
    "SINGLE-PHASE": "single", "THREE-PHASE": "three",
    "Single phase": "single", "Three phase": "three",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: price book defaults (USD/Ton), in file order
# ---------------------------------------------------------------------------
PRICE_BOOK = [
    ("copper", 9500.0, "USD/Ton", "2025-03-19"),
    ("aluminum", 2400.0, "USD/Ton", "2025-03-19"),
    ("steel", 800.0, "USD/Ton", "2025-03-19"),
    ("zinc", 2600.0, "USD/Ton", "2025-03-19"),
    ("nickel", 16500.0, "USD/Ton", "2025-03-19"),
    ("lead", 2100.0, "USD/Ton", "2025-03-19"),
    ("electrical_steel", 3000.0, "USD/Ton", "2025-03-19"),
    ("mineral_oil", 1200.0, "USD/Ton", "2025-03-19"),
    ("insulation_materials", 4500.0, "USD/Ton", "2025-03-19"),
]
# FIXED VALUES: fallback material by keyword, tried in this order, else steel
MATERIAL_KEYWORD_RULES = [
    (["core"], "electrical_steel"),
    (["wind", "coil"], "copper"),
    (["insul"], "insulation_materials"),
    (["tank"], "steel"),
    (["oil"], "mineral_oil"),
]
MATERIAL_FALLBACK = "steel"
# FIXED VALUES: the lb -> metric ton factor
LB_PER_TON = 2204.62
# FIXED VALUES: metal names as printed on exchange pages
PAGE_METAL_LABELS = [("copper", "Copper"), ("aluminum", "Aluminium"), ("zinc", "Zinc"),
                     ("lead", "Lead"), ("nickel", "Nickel")]
STALE_DAYS = 2

# ---------------------------------------------------------------------------
# FIXED VALUES: listing text rules
# ---------------------------------------------------------------------------
EQUIPMENT_INCLUDE = [
    "transformer", "mvA ", "kva ",
    "power transformer", "distribution transformer",
    "onan", "onaf", "oil immersed", "dry type",
    "33kv", "11kv", "22kv", "132kv", "220kv", "400kv",
]
EQUIPMENT_EXCLUDE = [
    "beauty", "microwave", "hair dryer", "led", "power supply", "powersupply",
    "charger", "adapter", "toy", "heater", "fan", "motor", "bulb", "lamp",
    "toaster", "blender", "television", "tv", "remote", "speaker", "audio",
    "circuit board", "pcb",
]
# rating patterns on upper-cased text; first hit wins, MVA ones scale by 1000
NUM = r"(\d+(?:\.\d+)?)"
KVA_PATTERNS = [NUM + r"[\s-]*KVA", NUM + r"[\s-]*K\.?V\.?A", NUM + r"[\s-]*KILO\s*VOLT\s*AMPERE"]
MVA_PATTERNS = [NUM + r"[\s-]*MVA", NUM + r"[\s-]*M\.?V\.?A", NUM + r"[\s-]*MEGA\s*VOLT\s*AMPERE"]
# scraper variant, on lower-cased text, numbers may carry commas
SNUM = r"(\d+[\d\.,]*)"
KVA_PATTERNS_LOOSE = [SNUM + r"[\s-]*kva", SNUM + r"[\s-]*k\.?v\.?a",
                      SNUM + r"[\s-]*kilo\s*volt\s*ampere", SNUM + r"[\s-]*kilo\s*va"]
MVA_PATTERNS_LOOSE = [SNUM + r"[\s-]*mva", SNUM + r"[\s-]*m\.?v\.?a",
                      SNUM + r"[\s-]*mega\s*volt\s*ampere", SNUM + r"[\s-]*mega\s*va"]
FIRST_NUMBER_PATTERN = r"([\d,]+\.?\d*)"
# voltage patterns on upper-cased text: (primary, secondary, secondary unit)
VOLTAGE_PATTERNS = [
    NUM + r"\s*KV\s*[/\\-]?\s*" + NUM + r"\s*(KV|V)",
    NUM + r"/" + NUM + r"\s*(KV|V)",
    NUM + r"\s*KV\s*TO\s*" + NUM + r"\s*(KV|V)",
]
SINGLE_PHASE_TERMS = ["single phase", "single-phase", "1-phase", "1 phase"]
THREE_PHASE_TERMS = ["three phase", "three-phase", "3-phase", "3 phase"]
THREE_PHASE_HINTS = ["power transformer", "distribution transformer"]
TYPE_KEYWORDS = [
    ("power transformer", "Power"),
    ("distribution transformer", "Distribution"),
    ("auto transformer", "Auto"),
    ("instrument transformer", "Instrument"),
    ("current transformer", "Current"),
    ("voltage transformer", "Voltage"),
    ("potential transformer", "Potential"),
    ("dry type", "Dry-Type"),
    ("oil-filled", "Oil-Filled"),
    ("oil filled", "Oil-Filled"),
    ("step-up", "Step-Up"),
    ("step up", "Step-Up"),
    ("step-down", "Step-Down"),
    ("step down", "Step-Down"),
]
DEFAULT_TYPE = "Power"
FREQUENCY_PATTERN = r"(\d+\.?\d*)\s*(hz|hertz)"
SIXTY_HZ_HINTS = ["usa", "canada", "japan", "united states", "america"]
DESTINATION_URL_PATTERN = r"import-in-([a-z-]+)"
SCRAPER_KEYWORD = "transformer"

# ---------------------------------------------------------------------------
# FIXED VALUES: model-table defaults and display names
# ---------------------------------------------------------------------------
DEFAULT_RATING_KVA = 1000.0
DEFAULT_PRIMARY_KV = 11.0
DEFAULT_SECONDARY_KV = 0.433
DEFAULT_PHASE = "Three-phase"
DEFAULT_FREQUENCY = 50.0
MIN_POWER_RATING = 200.0
SOURCE_REAL = "Real (Market)"
SOURCE_SYNTHETIC = "Synthetic"

DISPLAY_NAMES = {
    "date": "Date",
    "hsn_code": "HSN Code",
    "description": "Description",
    "origin": "Origin",
    "destination": "Destination",
    "quantity": "Quantity",
    "unit_price_usd": "Unit Price (USD)",
    "power_rating_kva": "Power Rating (KVA)",
    "source_url": "Source URL",
    "primary_voltage_kv": "Primary Voltage (kV)",
    "secondary_voltage_kv": "Secondary Voltage (kV)",
    "is_transformer": "Is Transformer",
    "data_source": "Data Source",
    "original_unit_price_usd": "Original Unit Price (USD)",
    "phase": "Phase",
    "type": "Type",
    "frequency_hz": "Frequency (Hz)",
}
MODEL_COLUMNS = ["power_rating_kva", "primary_voltage_kv", "secondary_voltage_kv", "phase",
                 "type", "frequency_hz", "unit_price_usd", "description", "data_source"]

# FIXED VALUES: application field names -> model field names
APP_FIELD_MAP = [
    ("power_rating", "power_rating_kva"),
    ("primary_voltage", "primary_voltage_kv"),
    ("secondary_voltage", "secondary_voltage_kv"),
    ("phase", "phase"),
    ("installation_type", "type"),
    ("cooling_type", "cooling_type"),
    ("frequency", "frequency_hz"),
    ("tap_changer", "tap_changer"),
]
INSTALLATION_TO_TYPE = [("Indoor", "Power"), ("Outdoor", "Power"),
                        ("Pad Mounted", "Distribution"), ("Pole Mounted", "Distribution")]
THREE_PHASE_ALIASES = ["three", "3", "three phase", "3-phase"]
SINGLE_PHASE_ALIASES = ["single", "1", "single phase", "1-phase"]

# ---------------------------------------------------------------------------
# FIXED VALUES: rule-based price formula
# ---------------------------------------------------------------------------
# (upper kVA bound or None, base, per-kVA)
RULE_PRICE_BANDS = [(500.0, 5000.0, 25.0), (2000.0, 10000.0, 20.0),
                    (10000.0, 25000.0, 15.0), (None, 75000.0, 10.0)]
COOLING_PRICE_FACTOR = [("ONAF", 1.1), ("OFAF", 1.2), ("ODAF", 1.3)]
SINGLE_PHASE_PRICE_FACTOR = 0.7
# price composition for large units
LOP_MIN_PCT = 30.0
LOP_SCALE = 0.2

# ---------------------------------------------------------------------------
# FIXED VALUES: labelled spec price (per-kg material rates, adders, location)
# ---------------------------------------------------------------------------
LABEL_PER_KVA = 100.0
LABEL_KG_RATES = [("core", 5.0), ("copper", 15.0), ("insulation", 8.0), ("tank", 3.0), ("oil", 2.0)]
LABEL_EFFICIENCY_RATE = 20000.0
LABEL_COOLING_ADDER = [("ONAF", 5000.0), ("OFAF", 10000.0), ("ODAF", 15000.0)]
LABEL_TAP_ADDER = 7500.0
LABEL_THREE_PHASE_ADDER = 5000.0
LABEL_DRY_ADDER = 8000.0
LOCATION_FACTORS = [("North America", 1.2), ("Europe", 1.3), ("Asia", 0.85), ("South America", 0.95)]
LABEL_NOISE_SD = 0.05

# ---------------------------------------------------------------------------
# FIXED VALUES: synthetic-table choices
# ---------------------------------------------------------------------------
SPEC_RATINGS = [25, 50, 100, 250, 500, 750, 1000, 1500, 2000, 2500, 3000]
SPEC_PRIMARY_KV = [4.16, 12.47, 13.2, 13.8, 24.94, 34.5]
SPEC_SECONDARY_KV = [0.12, 0.208, 0.24, 0.277, 0.48, 0.6]
SPEC_PHASES = ["Single-phase", "Three-phase"]
SPEC_COOLING = ["ONAN", "ONAF", "OFAF", "ODAF"]
SPEC_FREQUENCY = [50, 60]
SPEC_INSTALLATION = ["Indoor", "Outdoor"]
SPEC_INSULATION = ["Oil", "Dry"]
SPEC_LOCATIONS = ["North America", "Europe", "Asia", "South America"]

MARKET_PRIMARY_KV = [6.6, 11, 22, 33, 66, 132, 220, 400]
MARKET_SECONDARY_KV = [0.22, 0.4, 0.433, 0.69, 3.3, 6.6, 11, 33]

# ---------------------------------------------------------------------------
# FIXED VALUES: model hyper-parameter grids
# ---------------------------------------------------------------------------
RF_GRID = {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20, 30],
           "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]}
GB_GRID = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2],
           "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]}
RIDGE_ALPHAS = [0.1, 1.0, 10.0, 100.0]
LASSO_ALPHAS = [0.001, 0.01, 0.1, 1.0]
SPLIT_SEED = 42
TEST_FRACTION = 0.2

# FIXED VALUES: placeholder metrics shown when none are stored (not results)
DEFAULT_METRICS = {"r2": 0.95, "mae": 5000.0, "rmse": 7500.0, "mape": 5.0}
