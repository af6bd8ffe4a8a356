"""Vocabularies and tunable constants.

Fixed values: these must equal the filing rules' own enumerations and limits for
results to be right, so they are stated here once, in their natural order.
"""

from decimal import Decimal

# --- enumerations ---------------------------------------------------------
BEVERAGE_TYPES = ("WINE", "DISTILLED_SPIRITS", "MALT_BEVERAGE")
PRODUCT_SOURCES = ("DOMESTIC", "IMPORTED")
APPLICATION_TYPES = ("LABEL_APPROVAL", "EXEMPTION", "DISTINCTIVE_BOTTLE", "RESUBMISSION")
STATUSES = ("RECEIVED", "PROCESSING", "READY_FOR_REVIEW", "IN_REVIEW", "DECIDED")
DISPOSITIONS = ("APPROVED", "NEEDS_CORRECTION", "REJECTED")
DISPOSITIONS_NEEDING_NOTES = ("NEEDS_CORRECTION", "REJECTED")
EVENT_TYPES = (
    "SEEDED", "OCR_STARTED", "OCR_COMPLETED", "ANALYSIS_COMPLETED",
    "READY", "OPENED", "DECIDED", "UNDONE",
)
MATCH_STATUSES = ("MATCH", "MISMATCH", "MISSING", "UNVERIFIABLE")
CHECK_TYPES = ("DETERMINISTIC", "FIELD_MATCH", "HYBRID", "MANUAL")
IMAGE_VARIANTS = ("ORIGINAL", "ENHANCED", "BINARIZED")
IMAGE_ROLES = ("BRAND", "BACK", "NECK", "STRIP", "OTHER")
ROW_STATUSES = ("OK", "ERROR")

# --- verdicts -------------------------------------------------------------
PASS, REVIEW, FAIL, NA = "PASS", "REVIEW", "FAIL", "NA"
MATCH, MISMATCH, MISSING, UNVERIFIABLE = MATCH_STATUSES

# --- comparison limits ----------------------------------------------------
NUMERIC_FIELDS = ("alcohol_content", "net_contents")
TOLERANCE = {"alcohol_content": Decimal("0.3"), "net_contents": Decimal("0")}
SIMILARITY_FLOOR = 0.85
CONFIDENCE_FLOOR = 0.50
#: Fields whose per-source FAIL is reported as REVIEW, with the note shown.
SOFT_FIELDS = {
    "brand_name": "brand and fanciful names often differ; left to a person",
    "applicant_name_address": "address lines read unreliably; left to a person",
    "country_of_origin": "origin statements read unreliably; left to a person",
}
SCORED_FIELDS = (
    "alcohol_content", "applicant_name_address", "brand_name",
    "class_type_designation", "net_contents",
)
COMPARED_FIELDS = (
    "brand_name", "class_type_designation", "alcohol_content", "net_contents",
    "applicant_name_address", "country_of_origin",
)
MAX_IMAGES = 10

# --- required statement ---------------------------------------------------
STATEMENT_CITATION = "27 CFR 16.21"
STATEMENT_HEADER = "GOVERNMENT WARNING:"
STATEMENT_BODY = (
    "(1) According to the Surgeon General, women should not drink alcoholic beverages "
    "during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or "
    "operate machinery, and may cause health problems."
)
STATEMENT_CAPITALS = ("Surgeon", "General")
STATEMENT_ANCHORS = (
    "surgeon general", "during pregnancy", "birth defects",
    "operate machinery", "health problems", "impairs your ability",
)
STATEMENT_ANCHORS_NEEDED = 2
STATEMENT_END_ANCHORS = ("cause health problems", "health problems")
STATEMENT_DISPLAY_MARGIN = 80

# --- policies -------------------------------------------------------------
ABV_POLICY = {
    "DISTILLED_SPIRITS": "ABV_ALWAYS_REQUIRED",
    "MALT_BEVERAGE": "ABV_OPTIONAL_UNLESS_TRIGGER",
    "WINE": "ABV_REQUIRED_ABOVE_14_PCT",
}
WINE_ABV_THRESHOLD = Decimal("14")
ABV_WORDS = ("alc", "vol", "by volume", "abv")
ABV_CUES = ("alc", "vol", "abv", "alcohol")
NET_CUES = ("net",)
CUE_REACH = 24
STANDARD_SIZES_ML = (1800, 1750, 1000, 900, 750, 720, 700, 500, 375, 355, 200, 100, 50)
SIZE_CITATION = "27 CFR 5.203"
PROOF_PER_ABV = Decimal("2")
PROOF_TOLERANCE = Decimal("0.6")
RESPONSIBILITY_PHRASES = (
    "bottled by", "distilled by", "produced by", "produced and bottled by",
    "distilled and bottled by", "blended by", "blended and bottled by",
    "manufactured by", "imported by", "bottled for", "packed by", "prepared by", "made by",
)
FIELD_OF_VISION = ("brand_name", "class_type_designation", "alcohol_content")
FIELD_OF_VISION_CITATION = "27 CFR 5.63"

# --- keyword catalog: keyword -> exclusive group ----------------------------
CLASS_KEYWORDS = {
    "bourbon": "whisky", "rye whisky": "whisky", "rye whiskey": "whisky",
    "corn whisky": "whisky", "corn whiskey": "whisky", "scotch": "whisky",
    "single malt": "whisky", "whiskey": "whisky", "whisky": "whisky",
    "gin": "gin", "cognac": "brandy", "brandy": "brandy", "rum": "rum",
    "tequila": "agave", "mezcal": "agave", "vodka": "vodka",
    "liqueur": "liqueur", "cordial": "liqueur",
}
NON_EXCLUSIVE_GROUPS = ("liqueur",)
CLASS_CITATION = "27 CFR 5.141"

# --- display vocabularies ---------------------------------------------------
FILTER_LABELS = {"wine": "WINE", "spirits": "DISTILLED_SPIRITS", "beer": "MALT_BEVERAGE"}
ENGINE_LABELS = {
    "paddleocr": "PaddleOCR (PP-OCRv5)", "paddle": "PaddleOCR (PP-OCRv5)",
    "tesseract": "Tesseract 5",
}
VARIANT_LABELS = {
    "ORIGINAL": "original photo", "ENHANCED": "enhanced (preprocessed)",
    "BINARIZED": "binarized (preprocessed)",
}
READING_INDICATORS = {
    "MATCH": "matches", "MISMATCH": "differs",
    "MISSING": "not found", "UNVERIFIABLE": "can’t verify",
}
PREFERRED_VARIANT = {"tesseract": "BINARIZED", "paddleocr": "ENHANCED"}
STEP_OF_CHECK = {
    "brand_name": "Identity", "class_type_designation": "Identity", "name_address": "Identity",
    "grape_varietal": "Identity", "fanciful_name": "Identity",
    "alcohol_content": "Mandatory text", "net_contents": "Mandatory text",
    "abv_format": "Mandatory text", "standards_of_fill": "Mandatory text",
    "proof_abv_consistency": "Mandatory text",
    "government_warning": "Gov. Warning",
}
STEP_CAPTIONS = {
    "deskew": "deskew", "normalize_illumination_glare": "glare",
    "clahe_contrast": "contrast", "denoise": "denoise", "perspective_correct": "perspective",
}
