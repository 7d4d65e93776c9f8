"""Patterns, word lists, weights and bounds that decide results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One detector: what it reports and the regular expression that finds it."""

    pii_type: str
    category: str
    weight: int
    pattern: str
    # Case-folded literals, one of which occurs in every text with a match.
    needs: tuple[str, ...] = ()
    # A short pattern around digits that occurs in every text with a match.
    gate: str = ""


# Detector name, category, weight and pattern (matched without regard to case).
RULES = (
    Rule("Aadhaar", "identity", 20, r"\b\d{4}\s\d{4}\s\d{4}\b", gate=r"\p{Nd}{4}\P{Nd}\p{Nd}{4}"),
    Rule("SSN", "identity", 20, r"\b\d{3}-\d{2}-\d{4}\b", gate=r"\p{Nd}-\p{Nd}{2}-\p{Nd}"),
    Rule("CreditCard", "financial", 18, r"\b\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b", gate=r"\p{Nd}{4}\P{Nd}\p{Nd}{4}\P{Nd}\p{Nd}{4}"),
    Rule("Email", "contact", 8, r"\b[\w.-]+@[\w.-]+\.\w+\b", needs=("@",)),
    Rule("Phone", "contact", 10, r"\b(?:\+?91[\s-]?)?[6-9]\d{9}\b", gate=r"\p{Nd}{9}"),
    Rule("PAN", "identity", 15, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", gate=r"[0-9]{4}[^0-9]"),
    Rule(
        "BankAccount",
        "financial",
        12,
        r"\b(?:account|acct|bank_account_num)[^\d\n]{0,80}\d{8,18}\b|(?<=,)\d{8,18}(?=,[A-Z]{4}0[A-Z0-9]{6}\b)",
        gate=r"\p{Nd}{8}",
    ),
    Rule("RoutingCode", "financial", 10, r"\b(?:(?:routing(?:_code)?|ifsc)\D{0,40})?[A-Z]{4}0[A-Z0-9]{6}\b", gate=r"\p{L}0[\p{L}\p{Nd}]{6}"),
    Rule("Secret", "credentials", 16, r"\b[A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|API_KEY)[A-Z0-9_]*\s*[:=]\s*\S+", needs=("secret", "token", "password", "api_key")),
    Rule("APIKey", "credentials", 16, r"\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16})\b", needs=("sk-", "akia")),
    Rule(
        "Medical",
        "medical",
        5,
        r"\b(?:patient|diagnosed|diagnosis|prescribed|prescription|hospital|doctor|dr\.|asthma|diabetes|surgery)\b",
        needs=("patient", "diagnos", "prescri", "hospital", "doctor", "dr.", "asthma", "diabetes", "surgery"),
    ),
)

# Entity types of the name model, their category and weight.
ENTITY_TYPES = {"Name": ("identity", 5), "Organization": ("contact", 5), "Location": ("location", 5)}

# Model label ids and the entity each label group stands for.
LABELS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")
ENTITY_OF_LABEL = {"PER": "Name", "ORG": "Organization", "LOC": "Location"}

CATEGORY_BY_TYPE = {r.pii_type: r.category for r in RULES} | {t: c for t, (c, _) in ENTITY_TYPES.items()}
WEIGHT_BY_TYPE = {r.pii_type: r.weight for r in RULES} | {t: w for t, (_, w) in ENTITY_TYPES.items()}

# Scoring.
DEFAULT_CATEGORY = "other"
DEFAULT_WEIGHT = 5
REGEX_CONFIDENCE = 0.95
SCORE_CATEGORIES = ("identity", "financial", "contact", "credentials", "medical", "location", "other")
SCORE_CAP = 100
SCORE_ORANGE, SCORE_YELLOW = 70, 30
BONUS_WEIGHT = 2
BONUS_LOCATIONS = ("downloads", "appdata")
OLD_FILE_SECONDS = 365 * 24 * 60 * 60

# Line shapes that mark noise.
ROUTING_SHAPE = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
MIN_CSV_COMMAS = 3
MAX_DOTS = 2
MAX_PUNCTUATION = 6
EXCERPT_RADIUS = 50
CHUNK_CHARS = 1800

# Inventory name lists.
SKIPPED_EXTENSIONS = (
    ".exe", ".dll", ".so", ".bin", ".iso", ".dmg",
    ".zip", ".tar", ".gz", ".rar",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp",
    ".mp3", ".mp4", ".mov", ".avi", ".mkv",
)
TEXT_EXTENSIONS = (".txt", ".log", ".csv", ".local", ".env")
CHAT_EXTENSIONS = (".txt", ".json")
CHAT_NAME_MARKERS = ("whatsapp chat", "whatsapp", "telegram", "chat_history", "chat export", "result.json")
CONFIG_NAME_MARKERS = ("config", "credentials", "secrets", "password")
BROWSER_MARKERS = ("chrome", "firefox")
HIGH_RISK_LOCATIONS = ("appdata", "library/application support", ".config", "chrome", "firefox")
MEDIUM_RISK_LOCATIONS = ("downloads", "desktop", "onedrive")

# Default bounds of a scan and of a text extract.
MAX_DEPTH = 5
MAX_FILE_SIZE_MB = 25
EXTRACT_CHARS = 5000
CSV_ROWS = 100
TABLE_ROWS = 50
CHAT_MESSAGES = 500
CHAT_RAW_CHARS = 50000
CHAT_SAMPLE = 10

# Chat header line, bracket form or dash form.
CHAT_HEADER = (
    r"^(?:\[\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\]\s*"
    r"|\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\s+-\s*)([^:]+):\s*(.*)$"
)

# Presence patterns of the audit view, in report order; only the last ignores case.
VIEW_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("aadhaar", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("phone", r"\b(?:\+?91|0)?[6-9]\d{9}\b"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("password", r"(?i)password|secret|token|api[_-]?key|access[_-]?key|jwt|stripe"),
)

# Literals one of which occurs in every text the last pattern matches.
VIEW_SECRET_WORDS = ("password", "secret", "token", "key", "jwt", "stripe")

# Audit-view category keywords, in the order they are tried.
VIEW_CATEGORIES = (
    ("identity", ("name", "aadhaar", "pan", "ssn", "passport", "license", "person", "per")),
    ("financial", ("account", "card", "credit", "bank", "routing", "swift", "iban", "salary")),
    ("contact", ("phone", "email", "address", "zip", "postcode")),
    ("medical", ("medical", "health", "patient", "doctor", "prescription", "diagnosis", "hospital")),
    ("location", ("address", "city", "state", "country", "latitude", "longitude", "loc")),
    ("credentials", ("password", "api_key", "token", "secret", "key", "credential", "jwt", "stripe")),
)
VIEW_FALLBACK = (("browser_db", "credentials"), ("spreadsheet", "financial"), ("pdf", "identity"))
VIEW_SEVERE = r"password|secret|token|key|credit_card|card|ssn|aadhaar|pan|iban|account"
VIEW_RAISED = r"medical|patient|passport|phone"
SEVERITY_LABELS = ("Info", "Low", "Medium", "High")
VIEW_TOP_PII, VIEW_EXCERPT = 3, 220
TOP_N_FILES = 3000
GROUP_VISIBLE = 12
TONE_CRITICAL, TONE_ELEVATED = 70, 35

# Remediation.
REDACTION_MARK = "[REDACTED]"
ENCRYPTED_SUFFIX = ".enc"
NOT_REDACTABLE = ("pdf", "zip", "archive", "binary", "image")
