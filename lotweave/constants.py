"""Word lists, patterns and tables whose content decides results."""

# --- fixed values: record fields -----------------------------------------------------------
STRING_FIELDS = [
    "vin", "make", "model", "color", "body_style", "transmission", "engine", "fuel_type",
    "drivetrain", "dealer_name", "dealer_phone", "dealer_address", "location", "listing_title",
]
INT_FIELDS = ["year", "price", "mileage", "owners"]
ARRAY_FIELDS = ["features", "images"]

# Order of keys in a goal document.
GOAL_KEYS = [
    "vin", "goal", "price", "dealer", "location", "features", "color", "mileage", "accidents",
    "dealer_rating", "make", "model", "year", "body_style", "transmission", "engine", "fuel_type",
    "drivetrain", "images", "listing_title",
]

# --- fixed values: VIN and search ----------------------------------------------------------
VIN_CLASS = "[A-HJ-NPR-Z0-9]"
SUPPORTED_DOMAINS = ["cars.com", "carfax.com", "capitalone.com", "autotrader.com", "toyota.com"]
SEARCH_TEMPLATE = "{vin} site:cars.com OR site:carfax.com OR site:capitalone.com OR site:autotrader.com"
SEARCH_MAX_RESULTS = 10
TOP_URLS = 5

# --- fixed values: page checks -------------------------------------------------------------
ERROR_PHRASES = [
    "404 not found", "page not found", "error 404", "access denied", "forbidden",
    "internal server error", "500 error",
]
VEHICLE_WORDS = [
    "vin", "mileage", "miles", "price", "dealer", "make", "model", "year", "vehicle", "car",
]
DOMAIN_MARKS = {
    "cars.com": ["cars.com", "cars-photos"],
    "carfax.com": ["carfax", "vehicle history"],
    "autotrader.com": ["autotrader", "at-listing"],
    "capitalone.com": ["capital one auto"],
}

# --- fixed values: site layout selectors ---------------------------------------------------
DETAIL_NAMES = {
    "exterior color": "color",
    "color": "color",
    "transmission": "transmission",
    "engine": "engine",
    "fuel type": "fuel_type",
    "drivetrain": "drivetrain",
    "body style": "body_style",
    "body type": "body_style",
}

# --- fixed values: scoring -----------------------------------------------------------------
GENERIC_POINTS = {  # hundredths
    "vin": 40, "price": 30, "make": 10, "model": 10, "year": 10, "mileage": 5, "dealer_name": 5,
    "images": 5,
}
MODEL_POINTS = {  # hundredths
    "vin": 15, "make": 15, "model": 15, "year": 15, "price": 15,
    "mileage": 10, "dealer_name": 10, "location": 10,
    "color": 5, "transmission": 5, "features": 5, "images": 5,
}
SITE_CONFIDENCE = 0.9
MIN_CONFIDENCE = 0.7
SIMILARITY_WEIGHTS = {
    "vin": 3.0, "price": 2.5, "year": 2.0, "make": 2.0, "model": 2.0, "mileage": 1.5,
    "color": 1.0, "dealer_name": 1.0, "dealer_phone": 1.0,
}
EXPECTED_FIELDS = [
    "vin", "year", "make", "model", "price", "mileage", "color", "dealer_name", "dealer_phone",
    "features", "images", "description",
]
FIELD_ORDER = ["vin", "price", "year", "make", "model", "mileage"]
CRITICAL_FIELDS = ["vin", "price", "year", "make", "model"]

# --- fixed values: field dictionary (field, description, type, pattern, keywords) -----------
FIELD_DICTIONARY = [
    ("vin", "Vehicle Identification Number (17 characters)", "string",
     r"[A-HJ-NPR-Z0-9]{17}", ["vin", "vehicle identification"]),
    ("year", "Vehicle year (4 digits)", "integer", r"(19|20)\d{2}", ["year", "model year"]),
    ("make", "Vehicle manufacturer", "string", None, ["make", "brand", "manufacturer"]),
    ("model", "Vehicle model name", "string", None, ["model", "series"]),
    ("trim", "Vehicle trim level", "string", None, ["trim", "package", "edition"]),
    ("price", "Vehicle price in dollars", "integer", r"\$?[\d,]+",
     ["price", "cost", "msrp", "asking"]),
    ("mileage", "Vehicle mileage in miles", "integer", r"[\d,]+\s*mi",
     ["mileage", "miles", "odometer"]),
    ("color", "Vehicle exterior color", "string", None, ["color", "exterior", "paint"]),
    ("dealer_name", "Dealership or seller name", "string", None,
     ["dealer", "dealership", "seller"]),
    ("dealer_phone", "Dealer contact phone number", "string",
     r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", ["phone", "contact", "call"]),
    ("features", "List of vehicle features", "array", None,
     ["features", "options", "equipment"]),
    ("images", "Vehicle image URLs", "array", None, ["image", "photo", "picture"]),
    ("description", "Vehicle description text", "string", None,
     ["description", "details", "summary"]),
]

# --- fixed values: whitespace stripped around text (Unicode White_Space and separators) -----
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: patterns of facts in free text, in the order in which they are tried --------------
VIN_PATTERNS = [
    rf"(?iU)VIN:?\s*({VIN_CLASS}{{17}})",
    rf"(?iU)Vehicle\s*ID:?\s*({VIN_CLASS}{{17}})",
    rf"(?iU)Stock:?\s*({VIN_CLASS}{{17}})",
    rf"(?iU)\b({VIN_CLASS}{{17}})\b",
]
PRICE_PATTERNS = [
    r"(?U)\$\s*([\d,]+)(?:\.\d{2})?",
    r"(?iU)Price:?\s*\$?\s*([\d,]+)",
    r"(?iU)MSRP:?\s*\$?\s*([\d,]+)",
    r"(?iU)Sale:?\s*\$?\s*([\d,]+)",
]
MILEAGE_PATTERNS = [r"(?iU)([\d,]+)\s*miles?", r"(?iU)Mileage:?\s*([\d,]+)", r"(?iU)Miles:?\s*([\d,]+)"]
