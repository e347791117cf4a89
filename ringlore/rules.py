"""Closed vocabularies and rule data.  Values here are fixed: results must match them exactly."""

from __future__ import annotations

# --- fixed values ---
MOBILE_PREFIXES = (
    "032", "033", "034", "035", "036", "037", "038", "039", "086", "096", "097", "098", "070", "076", "077", "078", "079", "089", "090", "093",
    "081", "082", "083", "084", "085", "088", "091", "094", "052", "056", "058", "092", "059", "099", "087",
)
MAIN_AREAS = ("24", "28")
PHONE_PATTERN = r"(\+?84|0)(?:[\s.\-]?[0-9]){8,10}|1[89]00(?:[\s.\-]?[0-9]){4,7}"
PHONE_KEYWORDS = ("hotline", "đt", "đường dây", "liên hệ", "sđt", "tel", "phone", "gọi")
COMPANY_PATTERN = r"(Công ty|Cty|Doanh nghiệp)[^.,:;\n]{2,60}"
COMPANY_FLAGS = ("công ty", "cty", "doanh nghiệp")
CONNECTOR_PATTERN = r"[\s\-:]+(đt|sđt|hotline|tel|liên hệ)?\s*$"
HOTLINE_KEYWORDS = ("hotline", "tổng đài", "đường dây nóng")
CATEGORY_RULES = (
    ("BANK", ("ngân hàng", "bank")),
    ("INSURANCE", ("bảo hiểm", "insurance")),
    ("TELECOM", ("viễn thông", "telecom", "mobifone", "vinaphone", "viettel")),
    ("HOSPITAL", ("bệnh viện", "phòng khám", "hospital", "clinic")),
    ("GOVERNMENT", ("uỷ ban", "ủy ban", "sở ", "bộ ", "chính phủ", "government")),
    ("DELIVERY", ("giao hàng", "ship", "delivery", "vận chuyển")),
    ("ECOMMERCE", ("thương mại điện tử", "ecommerce", "sàn tmđt")),
    ("REAL_ESTATE", ("bất động sản", "real estate", "chung cư", "căn hộ")),
    ("TELEMARKETING", ("telesale", "tư vấn viên", "quảng cáo", "marketing")),
    ("SCAM", ("lừa đảo", "scam", "chiếm đoạt")),
    ("SPAM", ("spam", "làm phiền", "rác")),
)
URL_RULES = (
    (100, ("lien-he", "contact")),
    (95, ("hotline", "cham-soc-khach-hang", "customer-service", "customer-care")),
    (90, ("support",)),
    (80, ("chi-nhanh", "branch", "branches")),
    (75, ("location", "locations")),
    (70, ("store", "stores", "office", "offices")),
    (40, ("about", "gioi-thieu")),
    (35, ("company", "cong-ty")),
)
URL_DENY = ("wp-admin", "login", "cart", "checkout", "/api/", ".pdf", ".jpg", ".png", ".zip")
URL_DEFAULT = 10
PHONE_COLUMNS = ("phone", "telephone", "tel", "mobile", "hotline", "sdt", "so_dt", "so_dien_thoai", "dien_thoai", "contact_phone", "phone_number")
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemapindex.xml")
OFFICIAL_TYPES = ("OFFICIAL_WEBSITE", "GOVERNMENT")
SPAM_CATEGORIES = ("SPAM", "SCAM", "TELEMARKETING", "DEBT_COLLECTION", "OTHER")
JOB_STATUSES = ("PENDING", "RUNNING", "RETRY", "SUCCESS", "FAILED", "CANCELLED")
ACTIVE_STATUSES = ("PENDING", "RUNNING", "RETRY")
FREQUENCY_DAYS = {"DAILY": 1, "WEEKLY": 7, "MONTHLY": 30}
HORIZON_HOURS = (1, 3, 6, 9, 12, 24)
CONTEXT_CHARS = 80
RULES, USER_CONFIRMED = "rule_based_aggregation_v1", "user_confirmed_v1"
WINDOW_HOURS = {"6h": 6, "24h": 24, "72h": 72}
JOB_TYPES = ("CRAWL_URL", "CRAWL_SOURCE", "RECRAWL", "DISCOVER_DOMAIN", "DISCOVER_SITEMAP", "INGEST_DATASET", "NORMALIZE")
MAX_ACTIVE_JOBS, MAX_JOBS_PER_PASS = 5, 10
STALE_MINUTES, BACKOFF_SECONDS, MAX_ATTEMPTS = 30, 30, 5
JOB_PRIORITY, DISCOVERY_PRIORITY = 100, 150
# --- end of fixed values ---
