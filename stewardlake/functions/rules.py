"""Fixed rule tables. These values must equal the reference's for equal results.

FIXED VALUES: patterns, vocabularies and thresholds, stated in their natural
order. Order matters wherever a rule list is "first match wins".
"""

# --- column sensitivity (name prefix, case-insensitive) -------------------
PII_NAME_PREFIX = r"^(ssn|social_security|dob|date_of_birth|birth_date|email|phone|address|bank_account|credit_card|salary|compensation|wage)"
CONFIDENTIAL_NAME_PREFIX = r"^(cost_center|approver|budget_code|account_number|internal_id)"
ELEVATED_PII_NAME = r"ssn|dob|date_of_birth|birth|bank|credit_card"
SENSITIVITY_TAG_NAMES = ["sensitivity_level", "sensitivity"]  # first present wins
SENSITIVITY_LEVELS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "PII"]

# --- domain inference on "catalog schema" (lower case), first match wins --
DOMAIN_RULES = [
    (r"finance|budget|payroll|revenue|billing|accounting|expenditure", "Finance"),
    (r"hr|human.resource|employee|headcount|workforce|hris", "HR"),
    (r"health|clinical|patient|medical|pharma", "Healthcare"),
    (r"fire|police|ems|safety|emergency|incident|911", "Public Safety"),
    (r"sales|customer|crm|marketing|retail|ecommerce", "Sales & Marketing"),
    (r"geo|gis|spatial|map|location|address", "Geospatial"),
    (r"weather|forecast|climate|accuweather", "Weather"),
    (r"tax|property|assessment|parcel", "Property Tax"),
    (r"supply|inventory|logistics|warehouse|procurement", "Operations"),
    (r"nyctaxi|transit|transport|trip|vehicle", "Transportation"),
    (r"bakehouse|restaurant|food|hospitality|hotel|wander", "Hospitality"),
    (r"audit|compliance|risk|governance", "Compliance"),
]
DOMAIN_DEFAULT = "Other"

# --- roles -----------------------------------------------------------------
ADMIN_ROLE_ALIASES = ["admin", "steward", "data_steward", "data steward"]
# one-off migration: users / groups
USER_ROLE_MIGRATION = {"steward": "admin", "data_steward": "admin", "manager": "analyst"}
GROUP_ROLE_MIGRATION = {"steward": "admin", "data_steward": "admin", "manager": "admin"}

# --- freshness thresholds in days by refresh frequency ----------------------
FRESHNESS_DAYS = [("Daily", 1.5), ("Weekly", 8.0), ("Monthly", 32.0), ("Annual", 370.0)]
FRESHNESS_DEFAULT_DAYS = 3.0
# backfill span of last_refreshed by frequency, in days
BACKFILL_SPAN_DAYS = [("Daily", 1), ("Weekly", 7), ("Monthly", 30)]
BACKFILL_DEFAULT_SPAN_DAYS = 365

# --- natural-language question heuristic ----------------------------------
QUESTION_START = r"^(show|find|what|which|how|give|get|list|compare|who|why|tell|analyze|summarize|break|top|total|average|trend|where)\b"
QUESTION_PHRASE = r"\b(by department|by team|over time|last year|this year|vs |versus|trend|breakdown|summary|analysis|compared to)\b"

# --- assistant intents on the lower-cased text, first match wins ----------
INTENT_RULES = [
    ("approvals", r"approval|waiting on me|pending approval|queue|review|need.*approve"),
    ("status", r"status|check.*request|my request|pending|approved|denied"),
    ("nudge", r"nudge|remind|follow.?up|ping|chase|hasn.?t|haven.?t heard"),
    ("access", r"what.*access|my.*data|can.*access|have access|library|approved"),
    ("owner", r"who.*approve|who.*own|data steward|data owner|approver|contact"),
    ("find", r"find|search|look for|do we have|is there|data about|dataset"),
    ("how_to", r"how.*request|request.*access|get access|apply|submit"),
    ("greeting", r"^(hi|hello|hey|help|what can you|what do you)"),
]
INTENT_DEFAULT = "fallback"
# phrases removed before keyword search; keywords must be longer than 2 chars
FIND_STOP_PHRASES = r"find|search|look for|do we have|is there|data about|dataset|any"
FIND_MIN_KEYWORD_LEN = 3

# --- product type taxonomy, in display order --------------------------------
PRODUCT_TYPES = ["Dashboard", "AI/BI Dashboard", "Genie Space", "Dataset", "Report", "App", "ML Model", "Power BI", "Tableau"]
DASHBOARD_TYPES = ["Dashboard", "AI/BI Dashboard", "Genie Space"]
FACET_TAG_EXCLUDED = "UC Import"

# --- metadata browsing --------------------------------------------------------
INTERNAL_TABLE_PREFIXES = ["__materialization_mat_", "__apply_changes_", "event_log_", "__dlt_"]
HIDDEN_CATALOGS = ["system", "__databricks_internal", "hive_metastore"]
HIDDEN_SCHEMAS = ["information_schema"]
PLACEHOLDER_NAME_LIKE = "your_catalog.%"

# --- catalog page ------------------------------------------------------------
PAGE_SIZE = 6

# --- grants ------------------------------------------------------------------
NO_TABLE_GRANT_COMMENT = "-- No UC table linked for {name} (set uc_full_name on the product to enable automatic grants)"
NO_TABLE_REVOKE_COMMENT = "-- No UC table linked; manual revocation required"
CATALOG_GRANT_PRIVILEGES = ["USE CATALOG", "USE SCHEMA", "SELECT"]
APPROVAL_VALID_DAYS = 90
DEFAULT_REVOKE_REASON = "Access revoked by administrator"

# --- notifications -----------------------------------------------------------
EXPIRING_WITHIN_DAYS = 14
EXPIRING_LIMIT = 5
RECENT_WITHIN_DAYS = 7
RECENT_LIMIT = 10
RECENT_STATUSES = ["Approved", "Denied", "Revoked"]

# --- product defaults, import texts and spend labels -----------------------------
DEFAULT_SOURCE_TYPE = "Databricks"
IMPORT_SOURCE_SYSTEM = "Unity Catalog"
IMPORT_DESCRIPTION_PREFIX = "Imported from Unity Catalog: "
DISCOVER_DESCRIPTION_PREFIX = "Auto-discovered from Unity Catalog: "
IMPORT_OWNER_DEFAULT = "datasteward@example.org"
# spend: resource label by SKU patterns, first match wins (after the app tag);
# the row filter keeps the app tag and these patterns (not all label patterns)
SPEND_TAG_LABEL = "Warehouse"
SPEND_RESOURCE_RULES = [
    ("Lakebase (Postgres)", ["%LAKEBASE%"]),
    ("Ask AI (FMAPI)", ["%FOUNDATION_MODEL%", "%LLAMA%", "%PREMIUM_SERVING%"]),
]
SPEND_FILTER_PATTERNS = ["%LAKEBASE%", "%FOUNDATION_MODEL%", "%PREMIUM_SERVING%"]
SPEND_OTHER_LABEL = "Other"

# --- feature requests ----------------------------------------------------------
FEATURE_STATUSES = ["open", "on_roadmap", "done", "declined"]

# --- request-policy table: (method or '*', anchored path regex, level) --------
# First matching rule decides; an unmatched path requires admin.
POLICY_RULES = [
    ("GET", r"^/api/health$", "public"),
    ("GET", r"^/api/portal/config$", "public"),
    ("GET", r"^/api/portal/identity$", "public"),
    ("*", r"^/api/portal/admin/", "admin"),
    ("PUT", r"^/api/portal/settings$", "admin"),
    ("GET", r"^/api/portal/audit$", "admin"),
    ("GET", r"^/api/portal/requests/pending$", "admin"),
    ("PUT", r"^/api/portal/requests/[^/]+/(approve|deny|revoke)$", "admin"),
    ("GET", r"^/api/portal/products/pending$", "admin"),
    ("GET", r"^/api/portal/products/debug$", "admin"),
    ("PUT", r"^/api/portal/products/[^/]+/(publish|reject)$", "admin"),
    ("PUT", r"^/api/portal/products/[^/]+$", "admin"),
    ("DELETE", r"^/api/portal/products/[^/]+$", "admin"),
    ("PUT", r"^/api/portal/feature-requests/[^/]+/status$", "admin"),
    ("POST", r"^/api/portal/demo-(seed|reset)$", "admin"),
    ("GET", r"^/api/portal/products$", "user"),
    ("POST", r"^/api/portal/products$", "user"),
    ("GET", r"^/api/portal/products/[^/]+/(schema|preview|granted-access)$", "user"),
    ("GET", r"^/api/portal/requests$", "user"),
    ("POST", r"^/api/portal/requests$", "user"),
    ("POST", r"^/api/portal/requests/[^/]+/nudge$", "user"),
    ("GET", r"^/api/portal/notifications$", "user"),
    ("GET", r"^/api/portal/library$", "user"),
    ("GET", r"^/api/portal/settings$", "user"),
    ("GET", r"^/api/kpis$", "user"),
    ("POST", r"^/api/portal/ask-catalog$", "user"),
    ("GET", r"^/api/portal/feature-requests$", "user"),
    ("POST", r"^/api/portal/feature-requests$", "user"),
    ("POST", r"^/api/portal/feature-requests/[^/]+/vote$", "user"),
]
POLICY_DEFAULT_LEVEL = "admin"
