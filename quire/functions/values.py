"""Word lists, maps and patterns that results depend on, in their natural order."""

from __future__ import annotations

#: Years that recognition gets wrong; all become 2011.
WRONG_YEARS = ("2041", "20ll", "20I1", "20l1", "201l", "2O11", r"20\|1")
MONTHS_31 = ("January", "March", "May", "July", "August", "October", "December")
MONTHS_30 = ("April", "June", "September", "November")

CHARACTERS = {"|": "I", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}

PHRASES = {
    "baiance sheet": "balance sheet", "income statment": "income statement", "cash fiow statement": "cash flow statement", "profit and ioss": "profit and loss",
    "statment of operations": "statement of operations", "sold notlfication": "sold notification", "sold notilication": "sold notification", "notification detalls": "notification details",
    "net galn analysis": "net gain analysis", "net proceads analysis": "net proceeds analysis", "net proceeds analysls": "net proceeds analysis",
    "accounts receivabie": "accounts receivable", "accounts payabie": "accounts payable", "retained earings": "retained earnings", "shareholders equiy": "shareholders equity",
    "total assests": "total assets", "total liabilites": "total liabilities", "net incme": "net income", "gross proft": "gross profit", "operating expnses": "operating expenses",
    "pre-tax net galn": "pre-tax net gain", "percent net galn": "percent net gain", "broker commlssion": "broker commission", "attorney fess": "attorney fees",
    "rent cost basls": "rent cost basis", "sale prlce": "sale price",
    "real esate": "real estate", "property manageent": "property management", "property managernent": "property management", "lease agrrement": "lease agreement",
    "lease agreernent": "lease agreement", "security deposlt": "security deposit", "rental incone": "rental income", "tenant improvments": "tenant improvements",
    "investment propertles": "investment properties", "investment propertles group": "investment properties group", "multisite portfollo": "multisite portfolio",
    "purchase prlce": "purchase price", "sale proceds": "sale proceeds", "closing csts": "closing costs", "earnest mony": "earnest money", "down paymet": "down payment",
    "above referenced": "above-referenced", "on behalf of": "on behalf of", "was sold on": "was sold on", "please be advlsed": "please be advised",
    "please let me know": "please let me know", "please see the detalls": "please see the details", "has closed and funded": "has closed and funded",
    "wire confirmatlons": "wire confirmations", "closing statment": "closing statement",
    "university drlve": "university drive", "ross streel": "ross street", "corsicana streel": "corsicana street", "south streel": "south street", "midland drlve": "midland drive",
    "main streel": "main street", "main sfreet": "main street", "bell streel": "bell street", "andrews hlghway": "andrews highway", "gause bouievard": "gause boulevard",
}

BROKEN_WORDS = {
    "MuItisite": "Multisite", "MuIti": "Multi", "NotIfication": "Notification", "CapItal": "Capital", "FInance": "Finance", "AnaiysIs": "Analysis", "AddItional": "Additional",
    "InformatIon": "Information", "ConfIrmation": "Confirmation", "CommIssion": "Commission",
    "finaIIy": "finally", "usualIy": "usually", "actualIy": "actually", "originalIy": "originally", "realIy": "really", "totalIy": "totally", "generalIy": "generally",
    "normalIy": "normally", "fulIy": "fully", "informatlon": "information", "notificatlon": "notification", "confirmatlons": "confirmations",
    "rnanagement": "management", "agreenent": "agreement", "staternent": "statement", "propertles": "properties", "lnvestment": "investment", "cornmission": "commission", "analysls": "analysis",
}
STATES = ((" lX ", " TX "), (" 1X ", " TX "), ("|TX", " TX"), (" lA ", " LA "), (" 1A ", " LA "), (" M0 ", " MO "))

MONEY = r"(?i)(?:INR|Rs\.?|USD|EUR|GBP|₹|\$|€|£)\s?\d[\d,]*(?:\.\d+)?"
DATES = r"(?i)\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4})\b"

EXT_TO_MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppt": "application/vnd.ms-powerpoint",
    "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}
MIME_TO_EXT = {v: k for k, v in EXT_TO_MIME.items() if k != "jpeg"}

COUNTRIES = {
    "united states": "USA", "usa": "USA", "u.s.a.": "USA", "u.s.": "USA", "america": "USA", "united kingdom": "GBR", "great britain": "GBR", "uk": "GBR", "england": "GBR",
    "germany": "DEU", "deutschland": "DEU", "france": "FRA", "india": "IND", "china": "CHN", "japan": "JPN", "canada": "CAN", "australia": "AUS", "brazil": "BRA", "mexico": "MEX",
    "italy": "ITA", "spain": "ESP", "netherlands": "NLD", "holland": "NLD", "switzerland": "CHE", "sweden": "SWE", "norway": "NOR", "denmark": "DNK", "finland": "FIN",
    "ireland": "IRL", "singapore": "SGP", "hong kong": "HKG", "south korea": "KOR", "korea": "KOR", "taiwan": "TWN", "indonesia": "IDN", "malaysia": "MYS", "thailand": "THA",
    "philippines": "PHL", "vietnam": "VNM", "south africa": "ZAF", "nigeria": "NGA", "egypt": "EGY", "saudi arabia": "SAU", "uae": "ARE", "united arab emirates": "ARE",
    "israel": "ISR", "turkey": "TUR", "russia": "RUS", "poland": "POL", "belgium": "BEL", "austria": "AUT", "portugal": "PRT", "czech republic": "CZE", "czechia": "CZE",
    "romania": "ROU", "hungary": "HUN", "greece": "GRC", "argentina": "ARG", "chile": "CHL", "colombia": "COL", "peru": "PER", "new zealand": "NZL", "luxembourg": "LUX",
    "bermuda": "BMU", "cayman islands": "CYM", "puerto rico": "PRI", "scotland": "GBR", "wales": "GBR",
}
CURRENCIES = {"USD": "USA", "GBP": "GBR", "INR": "IND", "JPY": "JPN", "CAD": "CAN", "AUD": "AUS", "CHF": "CHE", "SGD": "SGP", "HKD": "HKG", "BRL": "BRA", "MXN": "MEX", "ZAR": "ZAF", "KRW": "KOR", "SEK": "SWE", "NOK": "NOR", "DKK": "DNK", "PLN": "POL"}

BUSINESS_UNITS = {
    "Treasury": ["treasury", "cash management", "liquidity", "fx", "foreign exchange", "hedging", "debt", "capital markets", "funding", "interest rate swap", "money market", "bond", "fixed income", "debt issuance"],
    "Americas": ["americas", "north america", "south america", "latin america", "latam", "us operations", "american operations", "north american"],
    "Real Estate": ["real estate", "real estate property", "physical property", "commercial real estate", "cre", "lease", "tenant", "mortgage", "appraisal", "landlord", "building management", "property management", "real property"],
    "GE Capital International": ["ge capital international", "geci", "international operations", "emea", "apac", "asia pacific", "european operations", "global operations", "international lending"],
    "GECC HQ": ["gecc", "ge capital", "headquarters", "corporate", "enterprise", "general electric capital", "ge corporate", "corporate headquarters"],
}

RECORD_TYPES = {
    "FIN210": ["ledger", "general ledger", "chart of accounts", "trial balance", "accounting"],
    "FIN200": ["journal entry", "journal entries", "posting"],
    "FIN100": ["accounts payable", "ap", "invoice payable", "payable invoice"],
    "FIN110": ["accounts receivable", "ar", "invoice receivable", "receivable invoice"],
    "TAX140": ["tax", "tax return", "vat", "gst", "withholding", "1099", "w-2", "tax filing", "excise", "duty", "tariff"],
    "HR120": ["employee file", "personnel file", "employee record"],
    "HR160": ["payroll", "salary", "compensation planning", "wages"],
    "HR180": ["employee", "recruitment", "termination", "onboarding", "performance review", "human resources", "hr"],
    "LEG120": ["contract", "agreement", "nda", "memorandum of understanding", "mou", "service agreement", "master agreement", "covenant"],
    "AUD110": ["audit", "internal audit", "sox", "control testing", "audit finding", "audit observation", "remediation", "sox audit"],
    "INS120": ["insurance", "policy", "claim", "premium", "underwriting", "actuarial", "loss ratio", "reinsurance"],
    "FIN180": ["treasury", "cash management", "liquidity", "hedging", "debt management", "capital markets", "fx", "foreign exchange", "money market"],
    "LEG160": ["legal advice", "legal opinion", "attorney-client", "legal memorandum", "legal memo", "counsel opinion"],
    "REG140": ["regulatory", "compliance", "examination", "supervisory", "consent order", "regulatory filing"],
    "RSK120": ["risk assessment", "credit risk", "operational risk", "risk management", "exposure", "mitigation"],
    "FIN160": ["financial report", "financial statement", "balance sheet", "income statement", "profit and loss", "p&l"],
    "CAD150": ["correspondence", "letter", "memo", "memorandum", "communication"],
    "CAD180": ["policy", "procedure", "guideline", "standard operating", "sop"],
    "CAD100": ["report", "analysis", "summary", "review", "findings"],
    "CAD120": ["meeting", "minutes", "agenda", "action items", "board meeting"],
    "CAD190": ["project", "project plan", "milestone", "deliverable", "timeline", "project proposal"],
    "SOU110": ["vendor", "supplier", "procurement", "purchase order", "rfp", "request for proposal"],
    "CAD230": ["customer", "client", "account holder", "borrower", "counterparty"],
    "MKT100": ["marketing", "campaign", "brand", "advertising", "market research"],
    "TEC100": ["information technology", "system", "application", "server", "database", "network", "software", "infrastructure", "it"],
    "FM110": ["facility", "building", "maintenance", "hvac", "office space", "space planning", "security"],
    "RIM100": ["record", "retention", "disposition", "archive", "records management", "information governance"],
    "CAD110": ["budget", "budget proposal", "budgeting", "forecast", "spending"],
    "TEC120": ["technical specification", "tech spec", "user manual", "training materials", "software development", "sdlc", "specification"],
    "BDV110": ["product development", "business strategy", "roadmap", "strategic planning"],
    "CAD210": ["training records", "course materials", "training guide"],
}
CATEGORY_OF_PREFIX = {
    "FIN": "Finance & Accounting", "TAX": "Tax", "HR": "Human Resources", "LEG": "Legal", "AUD": "Audit & Controls", "INS": "Insurance", "REG": "Regulatory & Compliance", "RSK": "Risk Management",
    "CAD": "Corporate Administration", "SOU": "Sourcing & Procurement", "MKT": "Marketing", "TEC": "Information Technology", "FM": "Facilities Management", "RIM": "Records & Information Management", "BDV": "Business Development",
}

SYNONYMS = (
    ("contract", "agreement", "deal"), ("invoice", "bill", "receipt"), ("revenue", "income", "earnings"), ("expense", "cost", "expenditure"), ("employee", "staff", "worker", "personnel"),
    ("client", "customer", "account"), ("terminate", "cancel", "end", "discontinue"), ("budget", "forecast", "allocation"), ("memo", "memorandum", "note"), ("report", "analysis", "summary"), ("meeting", "conference", "discussion"),
)

#: field, label, aliases, keywords, priority of the built-in taxonomy, and the default label of each field.
TAXONOMY = (
    ("category", "General", ("general",), ("document", "file"), 1),
    ("category", "Invoice", ("invoice", "bill"), ("invoice", "amount", "payment"), 3),
    ("category", "Contract", ("contract", "agreement"), ("contract", "agreement", "term"), 2),
    ("department", "Operations", ("ops",), ("process", "system", "operation"), 1),
    ("department", "Finance", ("fin",), ("finance", "payment", "amount", "invoice"), 3),
    ("department", "HR", ("human resources",), ("employee", "candidate", "leave"), 2),
    ("purpose", "Reference", ("reference",), ("record", "reference", "information"), 1),
    ("purpose", "Payment", ("payment",), ("payment", "due", "invoice"), 3),
    ("purpose", "Policy", ("policy",), ("policy", "guideline", "procedure"), 2),
)
TAXONOMY_DEFAULTS = {"category": "General", "department": "Operations", "purpose": "Reference"}

KNOWN_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "json", "xml", "html", "htm", "jpg", "jpeg", "png", "gif", "bmp", "tiff", "zip", "msg", "eml")
SLASH_MODES = (
    ("uid", ("uid",)), ("ext", ("ext", "type")), ("person", ("p", "person", "people", "name")), ("location", ("l", "loc", "location")), ("date", ("d", "date")),
    ("confidentiality", ("c", "conf", "confidentiality")), ("category", ("cat", "category")), ("department", ("dept", "department", "dep")), ("purpose", ("purp", "purpose")),
)

#: Fixed values of metadata sheets: names of columns by the tag or key they give, first name first; patterns of columns that are
#: kept besides, of columns and of sheets that are not; cells that say nothing.
TAG_ALIASES = {
    "category": ("category", "document category", "doc category", "business category", "record category", "record category name", "document type", "type"),
    "department": ("department", "dept", "domain", "business unit", "business unit name", "function", "owner department"),
    "purpose": ("purpose", "intent", "use case", "business purpose", "business function", "business function name", "objective"),
    "confidentiality": ("confidentiality", "classification", "data classification", "data classification name", "sensitivity", "security classification", "privacy"),
}
JOIN_ALIASES = {
    "smart_id": ("smart id", "smart_id"),
    "file_key": ("file key", "file_key", "file hash", "file_hash"),
    "file_name": ("file name", "filename", "name", "document name", "doc name", "folder/app name"),
    "file_path": ("file path", "filepath", "path", "document path", "source path", "staging file path location", "original file path name"),
    "doc_id": ("doc id", "document id", "doc_id", "id"),
}
EXTENDED_PATTERNS = (
    "metadata.*level.*code", "record.*class.*name", "record.*category.*name", "sub.*business.*unit", "business.*unit", "record.*type.*code", "record.*type.*description", "record.*type.*desc", "record.*class", "commentary",
    "business.*function.*name", "document.*type.*name", "iso.*country", "country.*name", "transaction.*number", "transaction.*name", "transaction.*type.*name", "customer.*number", "customer.*name", "record.*format.*name",
    "original.*record.*location.*type.*name", "record.*source.*name", "data.*classification.*name", "divestiture.*deal.*name", "creation.*date", "last.*modified.*date", "creator.*name", "disposition", "status",
    "staging.*file.*path.*location", "original.*file.*path.*name", "effective.*time", "preservation.*hold", "tax.*related", "divestiture", "record.*format", "original.*record.*location", "record.*source", "staging.*file.*path",
)
EXCLUDED_COLUMNS = (
    "^non-metadata$", "^metadata.*element.*name$", "^mandatory.*optional.*indicator$", "^mandatory.*metadata.*requirements$", "^optional.*metadata.*elements$", "^definition$", "^allowable.*values", "^metadata.*element.*format$",
    "^data.*owner.*documentation", "^irm.*checklist$",
)
EXCLUDED_SHEETS = (r"metadata\s*definition", r"copy\s*ticket", r"valid\s*values")
PLACEHOLDERS = ("na", "n/a", "none", "null", "unknown", "not available", "not_applicable", "-", "--")
