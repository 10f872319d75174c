"""Fixed values.

Everything in this module must stay equal to the behaviour being matched
(word lists, unit dictionaries, patterns, thresholds), so it is kept here,
plainly and in one place.  Patterns are Java regular expressions as Spark
uses them; ``(?i)`` marks case-insensitive ones, ``(?d)`` makes ``\\n`` the
only line terminator (Python semantics for ``^``/``$``/``.``).
"""

# ---- fixed values: unit-of-measure codes --------------------------------
UOM_CODES = ["EA", "CS", "PK", "BX", "DZ", "PR", "SET", "RL", "SH", "M", "KG", "L", "UNK"]

# ---- fixed values: unit alias -> code (27 entries) ----------------------
UOM_ALIASES = {
    "EA": "EA", "EACH": "EA",
    "CS": "CS", "CASE": "CS",
    "PK": "PK", "PACK": "PK", "PKG": "PK",
    "BX": "BX", "BOX": "BX",
    "DZ": "DZ", "DOZEN": "DZ", "DOZ": "DZ",
    "PR": "PR", "PAIR": "PR",
    "SET": "SET",
    "RL": "RL", "ROLL": "RL",
    "SH": "SH", "SHEET": "SH",
    "M": "M", "METER": "M", "MTR": "M",
    "KG": "KG", "KILOGRAM": "KG",
    "L": "L", "LITER": "L", "LITRE": "L",
}

# ---- fixed values: units per pack; every other code (and UNK) is 1 -------
UOM_MULTIPLIERS = {
    "EA": 1, "PR": 2, "DZ": 12, "CS": 1, "PK": 1, "BX": 1,
    "SET": 1, "RL": 1, "SH": 1, "M": 1, "KG": 1, "L": 1,
}

# ---- fixed values: pack-size patterns, tried in this order ---------------
# (name, pattern of the whole match, confidence).  The quantity is the
# leading / trailing digit run of the match, the unit the letter run.
PACK_SLASH = r"(?i)\d+\s*/\s*[A-Z]{2,4}"          # 25/CS        conf .9
PACK_PREFIX = r"(?i)[A-Z]{2,4}\s*\d+"             # PK10         conf .85
PACK_SUFFIX = r"(?i)\d+\s+[A-Z]{2,4}"             # 1000 EA      conf .8
PACK_BARE = r"(?i)\b(?:EA|CS|PK|BX|DZ|PR|SET|RL|SH|M|KG|L|EACH|CASE|PACK|BOX|DOZEN)\b"  # conf .7
PACK_CONFIDENCE = {"slash": 0.9, "prefix": 0.85, "suffix": 0.8, "bare": 0.7}

# ---- fixed values: part-number patterns, tried in this order -------------
MPN_EXPLICIT = r"(?i)(?:MPN|Part\s*#?|P/N|Model)[:\s]*([A-Z0-9\-_]+)"
MPN_EMBEDDED = r"\b([A-Z]{2,4}-?[0-9]{3,8}(?:-[A-Z0-9]{1,4})?)\b"
MPN_ALNUM = r"\b([A-Z0-9]{6,15})\b"
MPN_MIN_LENGTH = 4

# ---- fixed values: HSN / SAC code ----------------------------------------
TAX_CODE = r"\b(\d{4,8})\b"
SAC_MIN_LENGTH = 6

# ---- fixed values: amounts ------------------------------------------------
AMOUNT_CURRENCY = r"(?:₹|INR|Rs\.?|USD|EUR|GBP)\s?([0-9,.]+)"
AMOUNT_NUMERIC = r"\b(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b"
AMOUNT_NUMERIC_MIN = 0.01
AMOUNT_NUMERIC_MAX = 1000000.0

# ---- fixed values: line splitting and description -------------------------
PART_SPLIT = r"\s{2,}|\t"
DESC_NUMERIC_ONLY = r"^[\d,.₹]+$"
DESC_CODE_LIKE = r"^[A-Z0-9\-/]+$"

# ---- fixed values: table detection (lower-cased substring tests) ----------
TABLE_HEADER_WORDS = ["s.no", "s no", "sr.no", "sr no", "item", "description",
                      "particulars", "product", "service"]
TABLE_FOOTER_WORDS = ["subtotal", "sub total", "total before tax", "taxable amount",
                      "cgst", "sgst", "igst", "grand total"]
LINE_SKIP_WORDS = ["s.no", "s no", "item", "description", "qty", "rate",
                   "amount", "total", "uom", "unit"]
LINE_MIN_LENGTH = 5

# ---- fixed values: supplier detection --------------------------------------
SUPPLIER_HEADER_LINES = 30
SUPPLIER_LABELLED = [
    r"(?id)(?:sold\s*by|vendor|supplier|from|bill\s*from|ship\s*from)[:\s]+([A-Z][A-Za-z0-9\s&,.\-']+?)(?:\n|$)",
    r"(?id)(?:company|business\s*name)[:\s]+([A-Z][A-Za-z0-9\s&,.\-']+?)(?:\n|$)",
]
SUPPLIER_LEGAL_LINE = (
    r"(?imd)^([A-Z][A-Z0-9\s&,.\-']{3,50}(?:LLC|INC|CORP|LTD|LIMITED|CO\.?|COMPANY|"
    r"ENTERPRISES|TRADING|DISTRIBUTORS|SUPPLIES|SUPPLY)\.?)\s*$"
)
SUPPLIER_TIER3_LINES = 10
SUPPLIER_TIER3_SKIP = r"(?i)(?:invoice|bill|date|address|phone|fax|email|www\.|http|@|\d{5,})"
SUPPLIER_TIER3_MARKERS = ["LLC", "INC", "CORP", "LTD", "CO.", "CO ", "COMPANY", "ENTERPRISES",
                          "TRADING", "DISTRIBUTORS", "SUPPLIES", "SUPPLY", "INDUSTRIES",
                          "SOLUTIONS", "SERVICES", "GROUP"]
SUPPLIER_TIER4_LINES = 5
SUPPLIER_TIER4_SKIP = ["invoice", "bill", "receipt", "order", "purchase", "tax", "gst", "date"]
SUPPLIER_LEGAL_WORDS = r"(?i)\b(?:LTD|LIMITED|PVT|PRIVATE|CORP|CORPORATION|INC|INCORPORATED)\b"
SUPPLIER_COMMON_WORDS = r"(?i)\b(?:CO|COMPANY|ENTERPRISES|TRADERS|SUPPLIERS)\b"

# ---- fixed values: text cleaning -------------------------------------------
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
CLEAN_MIN_LENGTH = 5
CLEAN_MIN_ALNUM_RATIO = 0.4
RAW_CONFIDENCE_CAP = 0.8
RAW_CONFIDENCE_FACTOR = 1.2

# ---- fixed values: confidence scoring --------------------------------------
SCORE_SUPPLIER = (5, 0.8, 0.5)            # len > 5 -> .8 else .5, absent 0
SCORE_DESCRIPTION = ((20, 0.9), (10, 0.7), 0.5)
SCORE_UOM_ONLY = 0.6
SCORE_BASE_PRICE = 0.8
SCORE_UNIT_PRICE = 0.6
SCORE_MPN = 0.9
ESCALATE_BELOW = 0.5
AMBIGUOUS_PACK_BELOW = 0.6

# ---- fixed values: escalation reasons ---------------------------------------
MISSING_UOM = "missing_uom"
LOW_CONFIDENCE = "low_confidence"
INVALID_PRICE = "invalid_price"
AMBIGUOUS_PACK = "ambiguous_pack"

# ---- fixed values: lookup sources -------------------------------------------
SOURCE_PATTERN = "pattern_matched"
SOURCE_ONLINE = "online_lookup"
SOURCE_LLM = "llm_inferred"

# ---- fixed values: lookup thresholds -----------------------------------------
LOOKUP_SKIP_ABOVE = 0.7          # pack confidence above this: keep as is
LOOKUP_GATE_BELOW = 0.6          # worker gate: pack confidence below this
CATALOG_ACCEPT_ABOVE = 0.6       # catalogue answer accepted only above this
APPLY_ABOVE = 0.3                # answer applied to the item above this
LOOKUP_ESCALATE_BELOW = 0.5      # escalate when the answer is below this
CONFIDENCE_LEVELS = [(0.8, "high"), (0.5, "medium"), (0.2, "low")]  # else very_low

# ---- fixed values: search terms -----------------------------------------------
SEARCH_NOISE_WORDS = ["invoice", "bill", "item", "product", "service"]
SEARCH_WORD = r"\b[a-z0-9]{3,}\b"
SEARCH_MAX_WORDS = 5

# ---- fixed values: keyword catalogue (priority order) ---------------------------
DEFAULT_RULES = [
    # priority, keywords, uom, pack_quantity, confidence, reasoning, tag
    (1, ["screw", "bolt", "nut", "washer"], "EA", 1, 0.8,
     "Hardware items typically sold by each", "hardware"),
    (2, ["paper", "sheet", "form"], "PK", 100, 0.7,
     "Paper products often sold in packs of 100", "paper"),
    (3, ["box", "case", "carton"], "CS", 24, 0.6,
     "Box/case items often contain 24 units", "packaging"),
]

# ---- fixed values: messages -------------------------------------------------------
MSG_NO_TERMS = "No suitable search terms found"
MSG_NO_RULE = "No matching patterns in product database"
MSG_ALL_FAILED = "All lookup methods failed or unavailable"
MSG_ALL_FAILED_REASON = "Could not resolve UOM through available methods"
MSG_KEEP = "Already has high-confidence UOM information"
MSG_BAD_UOM = "LLM answer has an invalid uom"
MSG_NO_ANSWER = "No structured response from LLM"
MSG_NO_TEXT = "No text extracted from PDF"
MSG_OCR_FAILED = "All advanced methods failed"

# ---- fixed values: OCR ------------------------------------------------------------
OCR_METHODS = ["tesseract_layout", "tesseract_multi_psm", "paddle_ocr", "openai_vision", "tesseract_raw"]
# method -> (minimum text length (exclusive), minimum confidence (exclusive) or None)
OCR_ACCEPT = {
    "tesseract_layout": (100, 0.6),
    "tesseract_multi_psm": (100, 0.5),
    "paddle_ocr": (50, 0.7),
    "openai_vision": (50, None),
}
TOKEN_MIN_CONF = 40              # layout assembly keeps conf > 40
DETECTED_MIN_CONF = 0.5          # detected-line assembly keeps conf > .5
PSM_ORDER = [6, 4, 3]
PSM_MIN_LENGTH = 50
PSM_WEIGHTS = (0.3, 2000.0, 50.0)  # length, alnum ratio, line count
PSM_CONF_DIVISOR = 3000.0
PSM_CONF_CAP = 0.9
TOKEN_LOW_BELOW = 60
TOKEN_HIGH_ABOVE = 80
TOKEN_BUCKETS = (40, 60, 80)

# ---- fixed values: page joins --------------------------------------------------------
PAGE_BREAK_WORKER = "\n\n--- PAGE BREAK ---\n\n"
PAGE_BREAK_CLI = "\n\n"

# ---- fixed values: paging ---------------------------------------------------------------
PAGE_SIZE_DEFAULT = 20
PAGE_SIZE_MAX = 100

# ---- fixed values: job statuses -----------------------------------------------------------
JOB_STATUSES = ["pending", "processing", "completed", "failed", "partial"]

# ---- fixed values: file watching ------------------------------------------------------------
FILE_READY_TIMEOUT_S = 30
