"""Patterns, keywords and labels that results depend on word for word."""

# Headings: numbered, lettered, Roman, bracketed
HEADING_PATTERNS = [r"^\d+(\.\d+)+\s+", r"^[A-Z]\.\d+\s+", r"^[IVX]+\.\d+\s+", r"^\d+\.\d+\([a-z]\)\s+", r"^\d+\s+[A-Z]"]

# Names of sections about instructions and manuals
MANUAL_SECTION_PATTERNS = [
    r"instructions?\s+for\s+use",
    r"information\s+for\s+use",
    r"content\s+of\s+the\s+instructions?",
    r"requirements?\s+for\s+manuals?",
    r"marking\s+and\s+instructions?",
    r"user\s+information",
    r"accompanying\s+documents?",
    r"documentation",
    r"requirements?\s+for\s+the\s+requirements?",
    r"^\d+\.\d+\.\d+\.?\d*\s+instructions?",
    r"operating\s+instructions?",
    r"safety\s+instructions?",
]

# Any numbered heading
GENERIC_HEADING_PATTERNS = [
    r"^\d+(\.\d+)+\s+[A-Z]",
    r"^\d+(\.\d+)*\.[a-z]\s",
    r"^\d+\.\d+\([a-z]\)\s",
    r"^[A-Z](\.\d+)+\s",
    r"^[IVX]+\.[a-z]",
    r"^[IVX]+\.\d+",
    r"^[A-Z]\)\s+[A-Z]",
    r"^\d+\)\s+[A-Z]",
    r"^\([a-z]\)\s+[A-Z]",
    r"^\(\d+\)\s+[A-Z]",
    r"^[A-Z\s]{10,80}$",
]

CLAUSE_NUMBER_PATTERNS = [r"^\d+(\.\d+)*", r"^[A-Z]\.\d+(\.\d+)*", r"^[IVX]+\.\d+", r"^\d+\.\d+\([a-z]\)"]
BROAD_CLAUSE_NUMBER = r"^([A-Z0-9IVX]+[\.\(\)a-z0-9]*)"

# Table-of-contents lines, page numbers, references to standards
TOC_LINE, PAGE_NUMBER, STANDARD_REFERENCE = r"\.{3,}\s*\d+\s*$", r"^\d+\s*$", r"^EN\s+\d+:"

# Phrases that mark a clause about manuals anywhere
CLAUSE_KEYWORD_PATTERNS = [
    r"shall\s+accompany",
    r"shall\s+be\s+supplied\s+with",
    r"shall\s+be\s+included\s+with\s+the\s+product",
    r"shall\s+be\s+included\s+in\s+the\s+instruction\s+manual",
    r"shall\s+be\s+provided\s+to\s+the\s+user",
    r"instructions?\s+shall",
    r"information\s+shall\s+be\s+made\s+available",
    r"user\s+instructions?",
    r"operating\s+instructions?",
    r"safety\s+instructions?",
    r"\bWARNING\b",
    r"\bCAUTION\b",
    r"\bDANGER\b",
    r"marking\s+and\s+instructions?",
    r"instruction\s+manual",
    r"included\s+with\s+the\s+packaged\s+unit",
]

# Warning devices, and manual operation: not what is looked for
WARNING_EXCLUSION_PATTERNS = [r"warning\s+device", r"warning\s+signal", r"warning\s+light", r"warning\s+bell", r"audible\s+warning", r"visual\s+warning", r"warning\s+system"]
MANUAL_EXCLUSION_PATTERNS = [r"manual\s+(or|and|vs)\s+automatic", r"manual\s+operation", r"manual\s+control", r"manual\s+transmission", r"manual\s+adjustment", r"manually\s+operated"]

HARD_REQUIREMENT_PATTERNS = [
    r"shall\s+accompany\s+(the\s+)?product",
    r"shall\s+be\s+supplied\s+with\s+(the\s+)?product",
    r"shall\s+be\s+included\s+with\s+(the\s+)?product",
    r"shall\s+be\s+included\s+in\s+the\s+instruction\s+manual",
    r"instructions?\s+shall\s+be\s+provided\s+to\s+the\s+user",
    r"shall\s+be\s+provided\s+with",
]
SOFT_REQUIREMENT_PATTERNS = [r"shall\s+be\s+made\s+available", r"information\s+for\s+the\s+user", r"may\s+be\s+provided", r"should\s+be\s+available"]
WARNING_PATTERNS = [r"\bWARNING\b", r"\bCAUTION\b", r"\bDANGER\b", r"\bNOTE\b"]
SCOPE_PATTERNS = {
    "battery": [r"\bbattery\b", r"\bbattery\s+pack\b", r"\baccumulator\b", r"\bcell\b"],
    "charger": [r"\bcharger\b", r"\bcharging\s+equipment\b", r"\bcharging\b"],
    "ebike": [r"\be-bike\b", r"\bebike\b", r"\bpedelec\b", r"\belectric\s+bicycle\b", r"\belectric\s+bike\b"],
    "bicycle": [r"\bbicycle\b", r"\bbike\b"],
}
FORMATTING_PATTERNS = [
    r"shall\s+be\s+in\s+capital\s+letters",
    r"shall\s+be\s+clearly\s+legible",
    r"shall\s+be\s+in\s+the\s+official\s+language",
    r"""shall\s+bear\s+the\s+words\s+["']Original\s+instructions["']""",
    r"shall\s+be\s+indelible",
    r"shall\s+be\s+permanent",
    r"minimum\s+font\s+size",
    r"shall\s+be\s+visible",
]
PRINT_REQUIREMENT_PATTERNS = [r"shall\s+be\s+printed", r"printed\s+manual", r"paper\s+copy", r"physical\s+copy", r"in\s+print"]

# Validation
PLACEHOLDERS = ["N/A", "NA", "NOT APPLICABLE", "NONE", "-"]
EXTRACTION_NOTES = ["gpt extraction", "ai extraction", "automated extraction"]
REQUIRED_KEYWORDS = ["shall", "must", "required", "instructions", "instruction", "marking", "label", "warning", "caution", "danger", "manual", "document", "information", "provide", "include", "contain", "state", "indicate"]
PREAMBLE_PATTERNS = [r"^This clause of .+ is applicable\.?$", r"^This section of .+ applies\.?$", r"^Not applicable\.?$", r"^See .+\.$"]
TEST_PATTERNS = [r"Test T\.\d+:", r"Number of samples?:", r"Test equipment:", r"Measurement procedure:", r"Connect .+ and measure", r"Apply .+ and observe"]
SAFETY_KEYWORDS = [
    "injury", "injuries", "harm", "hazard", "hazards", "danger", "dangerous", "fire", "explosion", "burn", "electric shock", "electrocution",
    "death", "fatal", "fatality", "risk", "unsafe", "safety", "entrapment", "crush", "cut", "laceration", "toxic", "poisoning", "asphyxiation",
    "radiation", "electromagnetic",
]
MANUAL_KEYWORDS = [
    "instruction", "instructions", "manual", "documentation", "warning", "warnings", "caution", "notice", "marking", "label", "labeling", "labelling",
    "pictogram", "symbol", "icon", "user information", "information to user", "owner manual", "operating instructions", "maintenance instructions",
    "assembly instructions", "installation instructions",
]

# References to figures, notices of danger
IMAGE_PATTERNS = [
    r"[Ff]igure\s+[\dA-Z]+\.?\d*",
    r"[Ff]ig\.?\s+[\dA-Z]+\.?\d*",
    r"[Ii]llustration\s+[\dA-Z]+\.?\d*",
    r"[Dd]iagram\s+[\dA-Z]+\.?\d*",
    r"[Pp]ictogram\s+[\dA-Z]+\.?\d*",
    r"[Ss]ymbol\s+shown",
    r"see\s+image",
    r"as\s+shown\s+in",
    r"[Tt]able\s+[\dA-Z]+\.?\d*",
]
NOTICES = ["DANGER", "WARNING", "HAZARD", "CAUTION"]

# Garbage lines: parts of reversed words, whole reversed words, reversed phrases
SUBSECTION_MARK = r"^\d+\.\d+(?:\.\d+)*\s+(?:Addition|Replacement|Amendment|Modification|Isolating)"
REVERSED_AFTER_DOT = r"\.(oN|redrO|sresu|thgirypoc|ot|tcejbus|era|sdradnatS)"
REVERSED_WORDS = [
    "redrO", "sresu", "thgirypoc", "tcejbus", "sdradnatS", "noitasidradnatS", "ertneC", "nainotsE", "sgnoleb", "etubirtsid", "ecudorper", "kerT",
    "cinortcele", "tnemucod", "esiU", "esU", "rof", "ecnecil", "resu", "itluM", "ot", "era", "dna", "eht", "thgir", "siht", "fo",
]
REVERSED_PHRASES = r"(rof ecnecil|resu itluM|ot tcejbus|era sdradnatS|thgir eht)"
GARBAGE_PATTERNS = [r"–\s+\d+\s+–\s*(EVS-EN|IEC|EN\s+IEC)?", r"^[\d.,\s]+[a-zA-Z]{2,}$", r"^\.\d{4}\.\d{2}\.\d{2}", r"^,\d+", r"^[.,]\w{2,5}$"]

# Categories in order of precedence, with their keywords and titles
DOCUMENT_KEYWORDS = [
    "instructions for use", "user manual", "instruction manual", "user instructions", "shall be stated in the instructions", "information shall be provided",
    "marking in the instructions", "included with the product", "operating instructions", "safety instructions",
]
CHARGING_KEYWORDS = ["charging temperature", "charge temperature", "storage temperature", "store the battery", "charging procedure", "charger use", "outdoor or indoor charging"]
CATEGORY_KEYWORDS = {
    "labeling_and_warnings": ["shall be marked", "marking", "warning", "caution", "danger", "symbol", "label", "rating plate", "marking on the battery", "marking on the product"],
    "mechanical_and_abuse_tests": ["drop test", "impact test", "shock test", "vibration", "mechanical strength", "crush test", "compression", "abuse test", "rollover", "torsion", "bending", "mechanical damage"],
    "electrical_safety_and_insulation": ["insulation resistance", "dielectric strength", "dielectric withstand", "clearance", "creepage distance", "leakage current", "electric shock", "short-circuit", "short circuit", "overcurrent", "earth connection", "protective bonding"],
    "battery_design_and_construction": ["battery pack", "battery system", "cells and batteries", "cell arrangement", "battery enclosure", "venting", "thermal runaway", "protective circuit", "protection circuit", "bms", "battery management system", "overcharge protection", "overdischarge protection"],
    "protection_circuits_and_bms": ["protection circuit", "protection device", "battery management system", "bms", "overcharge", "over-discharge", "overcurrent protection", "temperature cut-off", "fault detection"],
    "environmental_conditions": ["ambient temperature", "temperature range", "relative humidity", "environmental conditions", "ingress protection", "ip code", "dust and water", "altitude", "storage temperature", "transport temperature"],
    "definitions_and_scope": ["is defined as", "for the purposes of this standard", "definition", "this standard applies to", "scope", "does not apply to", "this part of", "normative references"],
}
CATEGORY_TITLES = {
    "user_documentation_and_instructions": "User Documentation Requirements",
    "battery_charging_and_storage": "Battery Charging and Storage Requirements",
    "mechanical_and_abuse_tests": "Mechanical and Abuse Test Requirements",
    "electrical_safety_and_insulation": "Electrical Safety and Insulation Requirements",
    "environmental_conditions": "Environmental Condition Requirements",
    "labeling_and_warnings": "Labeling and Warning Requirements",
    "definitions_and_scope": "Definitions and Scope",
    "battery_design_and_construction": "Battery Design and Construction Requirements",
    "protection_circuits_and_bms": "Protection Circuit and BMS Requirements",
    "miscellaneous_or_uncategorized": "Miscellaneous Safety Requirements",
}

# Requirement types in order of precedence, with their keywords
REQUIREMENT_TYPE_KEYWORDS = {
    "disposal_recycling": ["disposal", "dispose of", "disposed of", "recycle", "recycling", "end-of-life", "end of life", "waste electrical and electronic equipment", "weee"],
    "packaging_transport": ["packaging", "package shall", "packaged batteries", "transport", "transportation", "shipping", "shipment", "carriage", "packing group"],
    "charging_storage": ["charging", "charge the battery", "recharge", "charger", "charging temperature", "storage temperature", "store the battery", "storage conditions", "state of charge"],
    "sample_size": ["sample size", "samples shall be", "number of samples", "at least three samples", "at least 3 samples", "shall be tested in groups of"],
    "test_setup": ["test setup", "test set-up", "mounted on", "mounted in", "fixed to", "arranged as in normal use", "arranged in normal use", "preconditioning", "pre-conditioning", "conditioned at", "placed in a chamber"],
    "test_method": ["test method", "test procedure", "the following test shall be carried out", "the following test shall be conducted", "the test is carried out", "the test is performed", "is subjected to the following", "is tested as follows"],
    "test_acceptance": ["no rupture shall occur", "no fire shall occur", "no explosion shall occur", "no leakage shall occur", "shall not rupture", "shall not explode", "shall not catch fire", "shall remain within the specified limits", "criteria are fulfilled", "compliance is checked by", "the test is considered satisfactory if"],
    "protective_devices": ["protection device", "protective device", "protective devices", "fuse", "fuses", "thermal cut-out", "thermal cutoff", "resettable device", "circuit breaker", "protective circuit"],
    "bms_behavior": ["battery management system", "bms", "protection circuit", "protection circuitry", "overcharge protection", "over-discharge protection", "overdischarge protection", "overcurrent protection", "short-circuit protection", "cell balancing", "cut-off device", "cutoff device", "monitoring of cell voltage", "monitoring of temperature"],
    "thermal_behavior": ["temperature rise", "surface temperature", "max temperature", "maximum temperature", "overheating", "thermal runaway", "flammable gas", "venting", "venting mechanism"],
    "mechanical_stress": ["drop test", "impact test", "shock test", "vibration test", "crush test", "mechanical abuse", "mechanical shock", "falling mass", "free fall", "torsion", "bending", "compression force"],
    "electrical_requirements": ["short circuit", "short-circuit", "internal resistance", "insulation resistance", "dielectric strength", "clearance", "creepage distance", "protective earth", "earthing", "insulation"],
    "construction_requirements": ["shall be constructed", "shall be so constructed", "mechanical construction", "enclosure shall", "enclosures shall", "enclosure material", "fixing means", "mechanical strength", "degree of protection", "ingress protection", "ip code"],
    "performance_limits": ["rated voltage", "rated capacity", "rated current", "current rating", "maximum charge current", "maximum discharge current", "maximum continuous current", "limits shall not be exceeded", "operating range", "specified range"],
    "labeling": ["shall be marked", "marking", "markings", "label", "labels", "rating plate", "symbol", "symbols", "pictogram"],
    "warnings": ["warning:", "warnings shall", "caution:", "risk of", "hazard", "danger of", "to reduce the risk"],
    "user_instructions": ["instructions for use", "instructions shall", "user instructions", "the instructions shall", "instruction manual", "accompanying documents", "information for the user"],
    "environmental": ["ambient temperature", "relative humidity", "humidity", "altitude", "environmental conditions", "pollution degree"],
    "general_safety_requirements": ["shall not present a risk", "shall not present any risk", "shall not cause injury", "shall not cause fire", "shall not constitute a hazard", "shall not be hazardous", "safe use", "safe operation", "safety of the user", "protection against", "protection of persons", "reduce the risk of injury", "reduce the risk of fire"],
    "procedural_general": ["applies to all", "applies to the following", "unless otherwise specified", "except as specified", "as specified in", "as described in", "in accordance with", "according to", "shall comply with", "compliance shall be checked", "compliance is determined by", "compliance is verified by", "compliance is achieved when"],
    "administrative_requirements": ["technical documentation", "documentation shall", "shall be documented", "test report", "test reports", "type test report", "records shall be kept", "record shall be kept", "record of", "manufacturer shall provide", "information to be provided", "data sheet", "datasheet"],
}

# Columns of the export, with the values of missing ones
EXPORT_DEFAULTS = {
    "Requirement ID": "", "Description": "", "Standard/Reg": "", "Clause/Requirement": "", "Requirement scope": "", "Formatting required?": "N/A",
    "Required in Print?": "n", "Parent Section": "Unknown", "Sub-section": "N/A", "Comments": "", "Contains Image?": "N", "Safety Notice Type": "None",
    "Clause_Type": "Requirement", "Mandate_Level": "Informative", "Safety_Flag": "n", "Manual_Flag": "n",
}
