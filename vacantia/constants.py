"""Fixed values that results depend on.

Every list below is data, not logic: it must equal the published behaviour for the results
to match. All of them are defaults of parameters.
"""

# Marker for a field that was not on the page.
MISSING = "N/A"

# Company suffixes, compared in lower case; at most one is removed.
COMPANY_SUFFIXES = (
    ", inc.", " inc.", " inc", ", llc", " llc", ", ltd.", " ltd.", " ltd",
    ", corp.", " corp.", " corp", ", corporation", " corporation", " limited",
    ", co.", " co.",
)

# Currency symbols in order of precedence.
CURRENCY_SYMBOLS = (("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY"))
DEFAULT_CURRENCY = "USD"

# Pattern of one salary figure; group 1 is the number.
SALARY_NUMBER = r"[\$£€¥]?\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*[Kk]?"
SALARY_NUMBER_PLAIN_DIGITS = r"[\$£€¥]?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*[Kk]?"

# Substrings that set a flag.
EQUITY_KEYWORDS = ("equity", "stock options", "rsu", "options", "stock")
REMOTE_KEYWORDS = (
    "remote", "work from home", "wfh", "distributed", "anywhere",
    "fully remote", "remote-first", "remote work", "work remotely",
)
VISA_KEYWORDS = (
    "visa sponsorship", "h1b", "h-1b", "work authorization", "sponsorship available",
    "sponsor visa", "visa support", "eligible for visa", "can sponsor",
)

# Skill patterns, matched as whole words in any case.
SKILL_PATTERNS = (
    r"Python", r"Java", r"C\+\+", r"Go", r"Rust", r"JavaScript", r"TypeScript", r"Scala",
    r"Kotlin", r"TensorFlow", r"PyTorch", r"Keras", r"scikit-learn", r"Hugging\s*Face",
    r"LangChain", r"OpenAI", r"AWS", r"GCP", r"Google\s*Cloud", r"Azure", r"PostgreSQL",
    r"MySQL", r"MongoDB", r"Redis", r"SQLite", r"Cassandra", r"Docker", r"Kubernetes",
    r"Terraform", r"Git", r"CI/CD", r"Jenkins", r"GitHub\s*Actions", r"Spark", r"Airflow",
    r"Kafka", r"dbt", r"Pandas", r"NumPy",
)

# Requirement patterns.
YEARS_PATTERN = r"(?i)(\d+)\+?\s*years?\s*(of\s*)?(experience|exp)"
DEGREE_PATTERNS = (
    r"(?i)(MS|Master|PhD|Doctorate|Bachelor|BS|BA)\s*(degree)?",
    r"(?i)(Graduate|Undergraduate)\s*degree",
)

# Verbs that open a responsibility line (case-sensitive).
RESPONSIBILITY_VERBS = (
    "Build", "Design", "Develop", "Lead", "Manage", "Deploy", "Create", "Implement",
)

# Application states, in report order.
APPLICATION_STATUSES = ("applied", "interviewing", "rejected", "offered", "accepted")
NOT_APPLIED = "not_applied"

# Profile domains and defaults.
PROFILE_DISTANCES = (10, 25, 35, 50, 75, 100)
MIN_REFRESH_SECONDS = 3600
PROFILE_DEFAULTS = {
    "distance": 25, "time_filter": "r86400", "refresh_interval": 3600, "enabled": True,
}

# Posting fields whose edits are logged.
TRACKED_FIELDS = ("salary", "number_of_applicants", "raw_description")

# Fields covered by the text index.
INDEXED_FIELDS = ("title", "company", "raw_description", "skills")

# Prefix of a posting's resource name; its id is the last part.
POSTING_URN_PREFIX = "urn:li:jobPosting:"
