"""Fixed values.

Everything in this module must equal the published pricing rules for results to be right: rates, percentages,
thresholds, word lists and patterns. Nothing here is tuned by us.
"""

# The priced service.
COMPUTE_SERVICE_NAME = "Compute Engine"
COMPUTE_SERVICE_ID = "6F81-5844-456A"

# Rates used when the catalog has no price (USD).
VCPU_HOUR_RATE = 0.0475
MEMORY_GB_HOUR_RATE = 0.0063
DISK_GB_MONTH_RATES = {"pd-ssd": 0.17, "pd-balanced": 0.10, "pd-standard": 0.04}
OTHER_DISK_GB_MONTH_RATE = 0.04
EXTERNAL_IP_HOUR_RATE = 0.004
HOURS_PER_MONTH = 730

# Discounts, in percent of compute plus GPU cost.
SPOT_DISCOUNT = 60
COMMITTED_DISCOUNTS = {"cud-1-year": 25, "cud-3-year": 37}
SUSTAINED_AFTER_HOURS = 183
SUSTAINED_STEP_HOURS = 73
SUSTAINED_STEP_DISCOUNT = 5
SUSTAINED_MAX_DISCOUNT = 30
SUSTAINED_PATTERN = "continuous"

# Pricing models and the usage type they are priced by.
SPOT_MODELS = ["spot", "preemptible"]
COMMITTED_MODELS = ["cud-1-year", "cud-3-year"]

# Words that make a price-feed record relevant, and words that rule it out.
RELEVANT_WORDS = [
    "instance", "vm", "virtual machine", "disk", "storage", "persistent", "gpu", "nvidia", "tesla",
    "ip address", "network", "memory", "cpu", "core",
]
EXCLUDED_WORDS = [
    "license", "support", "premium support", "api", "monitoring", "logging", "backup", "snapshot transfer",
]
ADHOC_WORDS = ["instance", "disk", "gpu"]

# Machine families known to each profile.
DAILY_FAMILIES = ["n1", "n2", "n2d", "e2", "c2", "c2d", "m1", "m2", "f1", "g1", "a2", "t2d", "t2a"]
ADHOC_FAMILIES = ["n1", "n2", "n2d", "e2", "c2", "c2d", "m1", "m2", "f1", "g1"]

# Commitment terms, how they are written in a description, and their discount.
COMMITMENT_TERMS = [
    ("1-year", ["1 year", "1-year"], 25.0),
    ("3-year", ["3 year", "3-year"], 37.0),
]

# Catalog housekeeping and report sizes.
PRICING_SOURCE = "cloud-billing-api"
CALCULATION_VERSION = "1.0"
CATALOG_KEEP_DAYS = 90
RESULTS_KEEP_DAYS = 365
HISTORY_DAYS = 30
CATALOG_TTL_HOURS = 24
RESOURCE_PAGE_SIZE = 50
RESULT_PAGE_SIZE = 50
CATALOG_PAGE_SIZE = 100
DEFAULT_WEB_REQUESTER = "web-app-user"

# Declared machine classes and cost-center budgets (USD).
MACHINE_CLASSES = {
    "general_purpose": ["n1", "n2", "n2d", "e2"],
    "compute_optimized": ["c2", "c2d"],
    "memory_optimized": ["m1", "m2"],
    "accelerator_optimized": ["a2"],
}
COST_CENTER_BUDGETS = {
    "engineering": 10000.0,
    "data-analytics": 15000.0,
    "platform": 8000.0,
    "research": 5000.0,
}

# Back-dating of sample rows, by end of the resource id, in days.
BACKDATE_DAYS = {"-001": 30, "-002": 7}
