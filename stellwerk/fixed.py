"""Fixed values.

Everything here is data that results depend on literally: header order, word
lists, portal constants, patterns. No logic lives in this module.
"""

# Column order of every delimited sink.
HEADERS = [
    "relevance_score",
    "search_criteria",
    "provider",
    "title",
    "company",
    "location",
    "work_location_type",
    "employment_type",
    "matching_skills",
    "missing_skills",
    "detected_languages",
    "matched_roles",
    "salary_hint",
    "posted_at_relative",
    "link",
    "scraped_at",
]

# Portal registry in lookup order
# (key, display name, domain pattern, default result limit).
PROVIDERS = [
    ("linkedin", "LinkedIn", "linkedin.com", 25),
    ("hays", "Hays", "hays.de", 20),
    ("solcom", "SOLCOM", "solcom.de", 20),
    ("freelancermap", "Freelancermap", "freelancermap.de", 20),
    ("xing", "XING", "xing.com", 15),
    ("gulp", "GULP", "gulp.de", 15),
    ("freelance_de", "Freelance.de", "freelance.de", 15),
    ("ferchau", "FERCHAU", "ferchau.com", 10),
]
FALLBACK_PROVIDER = "linkedin"
FORCED_PROVIDER_LIMIT = 20

# Link prefix per portal.
DOMAINS = {
    "hays": "https://www.hays.de",
    "solcom": "https://www.solcom.de",
    "freelancermap": "https://www.freelancermap.de",
    "xing": "https://www.xing.com",
    "gulp": "https://www.gulp.de",
    "freelance_de": "https://www.freelance.de",
    "ferchau": "https://touch.ferchau.com",
}

# Search locations as each portal spells them, and the spelling
# used for a location that is not listed.
LOCATION_NAMES = {
    "solcom": {"Germany": "Deutschland", "Austria": "Österreich", "Switzerland": "Schweiz", "Remote": "Remote"},
    "freelancermap": {"Germany": "Deutschland", "Austria": "Österreich", "Switzerland": "Schweiz", "Remote": "Remote"},
    "gulp": {
        "Germany": "Deutschland",
        "Austria": "Österreich",
        "Switzerland": "Schweiz",
        "Remote": "Remote",
        "Slovakia": "Andere Länder",
        "Europe": "Andere Länder",
    },
    "freelance_de": {"Germany": "Deutschland", "Austria": "Österreich", "Switzerland": "Schweiz", "Remote": "Remote"},
    "ferchau": {
        "Germany": "Deutschland",
        "Austria": "Österreich",
        "Switzerland": "Schweiz",
        "Poland": "Polen",
        "Remote": "Remote",
    },
}
LOCATION_DEFAULTS = {
    "solcom": "Deutschland",
    "freelancermap": "",
    "gulp": "Deutschland",
    "freelance_de": "Deutschland",
    "ferchau": "Deutschland",
}

# Search defaults when a profile leaves them out.
DEFAULT_QUERIES = ["Software Engineer"]
DEFAULT_LOCATIONS = ["Remote"]
NO_LOCATION_FILTER = "All Locations"

# Function words of the language vote.
GERMAN_WORDS = ["der", "die", "das", "und", "mit", "von", "den", "auf", "ist"]
ENGLISH_WORDS = ["the", "and", "with", "from", "for", "that", "this", "is", "are"]

# Profile lists that feed matching skills, and list cuts.
MATCHING_LISTS = ["programming", "testing", "embedded", "ai_ml", "ai_tools"]
ROLE_LIST = "roles"
MAX_MATCHING = 15
MAX_MISSING = 10

# Candidates matched as plain substrings.
SUBSTRING_CANDIDATES = ["c++", "c#", ".net"]

# Scored categories (weight key, profile list), default weights,
# and the weight assumed for a key missing from a non-empty weight map.
SCORED_CATEGORIES = [
    ("programming_languages", "programming"),
    ("testing_skills", "testing"),
    ("embedded_firmware", "embedded"),
    ("ai_ml_skills", "ai_ml"),
]
DEFAULT_WEIGHTS = {
    "programming_languages": 20,
    "testing_skills": 20,
    "embedded_firmware": 15,
    "ai_ml_skills": 20,
    "known_companies": 10,
    "seniority_level": 15,
}
MISSING_CATEGORY_WEIGHT = 20
MISSING_COMPANY_WEIGHT = 10
MISSING_SENIORITY_WEIGHT = 15
POINTS_PER_SKILL = 4
POINTS_PER_ROLE = 5
UNMENTIONED_SHARE = 0.25

# Lexicon categories that stand for each scored profile list.
MAPPED_CATEGORIES = {
    "programming": ["programming_languages"],
    "testing": ["testing_qa"],
    "embedded": ["embedded_hardware"],
    "ai_ml": ["ai_ml_data"],
}

# Salary pattern (Java syntax; i = any case, u/U = Unicode classes).
SALARY_PATTERN = (
    r"(?iuU)(?:Salary|Gehalt|Stundensatz|Vergütung):?\s*"
    r"([€$]\s?\d{2,3}[kK]|\d{2,3}[.,]\d{3}\s?[€$]|EUR)"
)

# Words that decide the work location during enrichment.
ENRICH_REMOTE_WORDS = ["remote", "home office", "homeoffice", "ortsunabhängig", "telearbeit", "mobil", "100%"]
ENRICH_HYBRID_WORDS = ["hybrid"]

# Words that decide work and employment type in free text.
TEXT_REMOTE_WORDS = ["remote", "home office", "home-office", "wfh", "telecommute", "mobil", "ortsunabhängig"]
TEXT_HYBRID_WORDS = ["hybrid", "mischform", "flexibel"]
TEXT_CONTRACT_WORDS = ["contract", "freelance", "freiberuflich", "project", "befristet", "projektbasiert"]
TEXT_INTERN_WORDS = ["intern", "praktikant", "student", "thesis", "werkstudent"]
HAYS_REMOTE_WORDS = ["remote", "home office", "mobil"]

# Phrases that mark a blocked page.
BLOCK_PHRASES = ["Kundeninformation", "Customer Information", "Ihrem Land aktuell nicht"]

# Word lists of the two stand-alone row filters.
TITLE_WORDS = [
    "tester",
    "test",
    "verification",
    "testingenieur",
    "automation",
    "QA",
    "Assurance",
    "Quality",
    "testautomatisierung",
]
CITY_WORDS = ["vienna", "graz", "linz", "munchen"]

# Template of a posting injected by link.
MANUAL_TEMPLATE = {
    "title": "Pending Extraction...",
    "company": "Pending Extraction...",
    "location": "Remote",
    "description": "",
    "posted_at_relative": "N/A",
    "work_location_type": "Remote",
    "employment_type": "Freelance",
}

# What a portal writes when the page does not say.
CARD_DEFAULTS = {
    "linkedin": {},
    "hays": {"company": "Hays Client", "location": "Germany"},
    "solcom": {"title": "Unknown", "company": "SOLCOM Client", "location": "Germany"},
    "freelancermap": {"company": "Freelancermap Client", "location": "Germany"},
    "xing": {"company": "XING Employer", "location": "Germany/Remote"},
    "gulp": {"company": "GULP Client", "location": "Germany"},
    "freelance_de": {"company": "Freelance.de Client", "location": "Germany/Remote"},
    "ferchau": {"company": "FERCHAU"},
}
POSTED_DEFAULT = "Recent"

# File names of a run folder, preferred first, and retention.
RUN_FILES = ["jobs.json", "all_jobs_raw.json"]
RAW_CSV = "all_jobs_raw.csv"
MASTER_RETENTION_DAYS = 180
RUN_RETENTION_DAYS = 14
TOP_REPORT_ROWS = 5
SHEET_NAME_LENGTH = 30
