"""Fixed values of the planning domain.

Everything in this file is data: rates, calendars, word lists, formats and
messages that results depend on.  No logic lives here.  Each table keeps its
natural order.
"""

# --------------------------------------------------------------------------
# vocabularies
# --------------------------------------------------------------------------
EVENT_TYPES = (
    "wedding",
    "corporate_lunch",
    "college_canteen",
    "birthday_party",
    "festival_event",
    "hospital_canteen",
    "school_canteen",
    "dhaba_daily",
)
MENU_PROFILES = (
    "veg_simple",
    "veg_elaborate",
    "nonveg_simple",
    "nonveg_elaborate",
    "mixed_standard",
    "snacks_only",
    "biryani_special",
)
BUSINESS_SIZES = ("small", "medium", "large")

# --------------------------------------------------------------------------
# Rates per menu profile and per event type
# --------------------------------------------------------------------------
GAS_PER_100_GUESTS = {
    "veg_simple": 7.2,
    "veg_elaborate": 10.8,
    "nonveg_simple": 9.1,
    "nonveg_elaborate": 14.3,
    "mixed_standard": 11.5,
    "snacks_only": 4.8,
    "biryani_special": 8.6,
}
DEFAULT_GAS_PER_100_GUESTS = 11.5

COMMERCIAL_EFFICIENCY = 3.5
GAS_PER_SERVING = {
    "veg_simple": 0.012,
    "veg_elaborate": 0.0128,
    "nonveg_simple": 0.0148,
    "nonveg_elaborate": 0.0175,
    "mixed_standard": 0.0104,
    "snacks_only": 0.0118,
    "biryani_special": 0.0124,
}
DEFAULT_GAS_PER_SERVING = 0.012

DISHES_PER_MENU = {
    "veg_simple": 4,
    "veg_elaborate": 7,
    "nonveg_simple": 5,
    "nonveg_elaborate": 9,
    "mixed_standard": 6,
    "snacks_only": 3,
    "biryani_special": 3,
}
DEFAULT_DISHES = 5
DEFAULT_COOK_MINUTES = 30.0

PLANNER_WASTAGE_RATE = {
    "wedding": 0.12,
    "corporate_lunch": 0.07,
    "college_canteen": 0.09,
    "birthday_party": 0.14,
    "festival_event": 0.11,
    "hospital_canteen": 0.06,
    "school_canteen": 0.08,
    "dhaba_daily": 0.05,
}
BENCHMARK_WASTAGE_RATE = {
    "wedding": 0.12,
    "corporate_lunch": 0.07,
    "college_canteen": 0.09,
    "birthday_party": 0.1,
    "festival_event": 0.11,
    "hospital_canteen": 0.06,
    "school_canteen": 0.08,
    "dhaba_daily": 0.05,
}
DEFAULT_WASTAGE_RATE = 0.09

# --------------------------------------------------------------------------
# supply
# --------------------------------------------------------------------------
DELIVERY_LEAD_DAYS = {"Chennai": 1, "Coimbatore": 2, "Madurai": 2, "Trichy": 2}
DEFAULT_LEAD_DAYS = 3
USABLE_KG_PER_CYLINDER = 17.5
CYLINDER_PRICE_INR = 1910

# --------------------------------------------------------------------------
# Calendar by month
# (month, wedding season, festival, festival name, demand multiplier,
#  mean temperature in C, rain in mm)
# --------------------------------------------------------------------------
CALENDAR = (
    (1, 1, 1, "Pongal", 1.45, 24.8, 9.0),
    (2, 1, 0, "None", 1.30, 26.2, 5.0),
    (3, 0, 0, "None", 0.85, 28.4, 8.0),
    (4, 0, 1, "Tamil New Year", 1.20, 31.2, 17.0),
    (5, 0, 0, "None", 0.80, 33.1, 53.0),
    (6, 0, 0, "None", 0.75, 32.4, 53.0),
    (7, 0, 0, "None", 0.80, 31.0, 88.0),
    (8, 0, 1, "Onam", 1.15, 30.8, 111.0),
    (9, 0, 0, "None", 0.85, 30.2, 119.0),
    (10, 1, 1, "Navratri", 1.50, 28.9, 305.0),
    (11, 1, 1, "Diwali", 1.55, 26.3, 351.0),
    (12, 1, 1, "Dec Weddings", 1.40, 24.9, 188.0),
)
MONSOON_MONTHS = (6, 7, 8, 9)

# (first year, first month, last year, last month, demand factor)
DEMAND_SHOCKS = (
    (2020, 3, 2020, 8, 0.35),
    (2020, 9, 2020, 12, 0.60),
    (2021, 1, 2021, 6, 0.70),
)

# --------------------------------------------------------------------------
# Price anchors (date, rupees per 19 kg cylinder) and the values
# used for a month the price series does not cover
# --------------------------------------------------------------------------
PRICE_ANCHORS = (
    ("01-Apr-18", 1176.5),
    ("01-Apr-19", 1305.5),
    ("01-Apr-20", 1285.5),
    ("01-Apr-21", 1641.0),
    ("01-Apr-22", 2253.0),
    ("01-Apr-23", 2028.0),
)
PRICE_GRID = ("2018-04-01", "2024-03-01")
PRICE_MISS = {
    "commercial_price_inr": 1500.0,
    "price_lag1_inr": 1480.0,
    "price_lag2_inr": 1460.0,
    "price_mom_change_inr": 20.0,
}
PRICE_INDEX_BASE = 1500.0

# Header text of the price source (header -> short name)
PRICE_SOURCE_HEADERS = {
    "Date Effective From": "date_str",
    "RSP of Domestic LPG (Rs./14.2Kg Cylinder)": "domestic_price_inr",
    "RSP of Commercial LPG (Rs./19Kg Cylinder)": "commercial_price_inr",
}
WASTAGE_SOURCE_HEADERS = {
    "Type of Food": "food_type",
    "Number of Guests": "guests",
    "Event Type": "event_type_raw",
    "Quantity of Food": "quantity_of_food",
    "Wastage Food Amount": "wastage_amount",
    "Preparation Method": "preparation",
    "Seasonality": "seasonality",
}
RECIPE_SOURCE_HEADERS = {
    "RecipeName": "recipe_name",
    "TranslatedIngredients": "ingredients",
    "CookTimeInMins": "cook_time_mins",
    "Servings": "servings",
    "Course": "course",
    "Diet": "diet",
    "Cuisine": "cuisine",
}

# --------------------------------------------------------------------------
# Category maps of the wastage records (raw -> own, default)
# --------------------------------------------------------------------------
EVENT_TYPE_OF_RAW = {
    "Wedding": "wedding",
    "Corporate": "corporate_lunch",
    "Birthday": "birthday_party",
    "Social Gathering": "festival_event",
}
DEFAULT_EVENT_TYPE = "festival_event"
INTENSITY_OF_PREPARATION = {
    "Buffet": "high",
    "Sit-down Dinner": "medium",
    "Finger Food": "low",
}
DEFAULT_INTENSITY = "medium"
SEASON_OF_RAW = {"Winter": "winter", "Summer": "summer", "All Seasons": "all"}
DEFAULT_SEASON = "all"

# --------------------------------------------------------------------------
# Recipe word lists
# --------------------------------------------------------------------------
HIGH_HEAT_WORDS = (
    "deep fry", "deep-fry", "dalda", "vanaspati", "refined oil", "sunflower oil",
    "groundnut oil", "hydrogenated", "poori", "bhatura", "pakora", "vada",
)
MEDIUM_HEAT_WORDS = (
    "ghee", "butter", "cream", "coconut oil", "mustard oil", "oil", "tadka", "tempering",
)
LOW_HEAT_WORDS = ("steam", "boil", "pressure cook", "idli", "sambhar", "rasam", "poach")

# kg of gas per hour
HIGH_HEAT_RATE = 0.35
LOW_HEAT_RATE = 0.18
MEDIUM_HEAT_RATE = 0.28
COURSE_RATES = (
    (("snack", "appetizer"), 0.30),
    (("dessert",), 0.22),
    (("breakfast",), 0.20),
)
DEFAULT_HEAT_RATE = 0.26

NONVEG_DIET_MARKS = ("non vegeterian", "high protein non")
MAIN_COURSE_MARKS = ("main course", "dinner", "lunch")
SNACK_COURSE_MARKS = ("snack", "appetizer")
NONVEG_ELABORATE_WORDS = ("cream", "butter", "ghee", "tikka", "makhani")
VEG_ELABORATE_WORDS = ("cream", "butter", "paneer", "ghee", "cashew", "makhani")

# --------------------------------------------------------------------------
# Ordering behaviour by experience
# --------------------------------------------------------------------------
# order accuracy range per experience tier (years <=2, <=5, <=10, more)
FIRST_LABEL_ACCURACY = ((0.70, 0.90), (0.82, 0.96), (0.90, 1.00), (0.95, 1.05))
TRAINING_LABEL_ACCURACY = ((0.88, 1.00), (0.92, 1.05), (0.96, 1.08), (0.98, 1.10))
# lead day range per five years of experience
LEAD_DAY_RANGES = ((1, 4), (2, 6), (4, 10), (5, 12))

# --------------------------------------------------------------------------
# ranges
# --------------------------------------------------------------------------
EVENT_RANGES = {
    "headcount": (10, 5000),
    "consumption_kg": (0.5, 500),
    "cylinders_needed": (1, 29),
    "duration_hrs": (0.5, 16),
    "wastage_kg": (0, None),
    "order_lead_days": (0, 30),
}
REQUEST_RANGES = {
    "experience_yrs": (1, 40),
    "num_burners": (1, 30),
    "headcount": (10, 5000),
    "num_dishes": (1, 20),
    "duration_hrs": (0.5, 16.0),
}
REQUEST_DEFAULTS = {
    "caterer_id": "CAT001",
    "caterer_name": "Murugan Catering",
    "experience_yrs": 8,
    "num_burners": 8,
    "business_size": "medium",
    "event_type": "wedding",
    "headcount": 300,
    "num_dishes": 6,
    "duration_hrs": 5.0,
    "menu_profile": "mixed_standard",
    "is_festival_season": False,
}
EXPERIENCE_TIERS = ((2, "novice"), (5, "intermediate"), (10, "experienced"), (30, "expert"))
KG_PER_GUEST_BAND = (0.08, 0.15)
CONSUMPTION_LIMITS = (1.5, 500.0)

# --------------------------------------------------------------------------
# Column lists of the modelling table
# --------------------------------------------------------------------------
TARGETS = ("consumption_kg", "cylinders_needed", "wastage_kg", "order_lead_days")
UNSCALED = (
    "year", "month", "day", "wedding_season", "festival_flag", "is_monsoon", "covid_period",
    "heat_stress", "price_surge_flag", "novice_peak_season", "ran_out_of_gas", "month_sin",
    "month_cos", "consumption_kg", "cylinders_needed", "wastage_kg", "order_lead_days",
    "cylinders_ordered", "wastage_rate",
)
NOT_FEATURES = (
    "consumption_kg", "cylinders_needed", "wastage_kg", "order_lead_days", "ran_out_of_gas",
    "year", "month", "day", "wastage_rate", "cylinders_ordered", "experience_tier_enc",
)
LABEL_INPUTS = ("experience_yrs", "novice_peak_season")
TARGET_DERIVED = ("kg_per_guest", "kg_per_burner_hr")
ENCODED = ("event_type", "menu_profile", "business_size", "festival_name", "experience_tier")

# --------------------------------------------------------------------------
# Messages of a plan
# --------------------------------------------------------------------------
ACTION_HIGH_RISK = "Order %d cylinders (add 1 safety buffer — high risk event)"
ACTION_NOVICE = "Consider ordering 2–3 days earlier — novice buffer recommended"
ACTION_WASTAGE = "Wastage high for %s events — track actual usage post-event"
ACTION_FESTIVAL = "Festival season: dealer supply pressure likely — order at least 5 days early"
ACTION_LARGE = "Large event for inexperienced caterer — add 20% buffer to cylinder order"
ACTION_DEFAULT = "Procurement on track — follow recommended order date"
NOTE_RULE = "Rule-based: %.1fkg | Final: %.1fkg"
NOTE_BLENDED = "Rule-based: %.1fkg | ML prediction: %.1fkg | Blended: %.1fkg"
NOTE_SHIFTED = " | Shifted %dd earlier (demand smoothing)"
BATCH_OPTIMAL = "optimal"
BATCH_OVER_BUDGET = "fallback"
BATCH_EMPTY = "no events"
BATCH_UNLISTED = "not listed"
