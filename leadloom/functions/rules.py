"""Word lists, patterns and thresholds the results depend on."""

# ---- fixed values: name, domain and handle keys ----------------------------
LEGAL_SUFFIXES = [
    "ltd", "limited", "llc", "llp", "lp", "inc", "incorporated", "plc", "corp",
    "corporation", "gmbh", "pty", "co", "company", "cic", "cio", "sarl", "sa", "ag", "bv",
]
DROPPED_SUBDOMAINS = ["www", "m", "shop", "blog", "news", "careers", "jobs"]
COMPOUND_TLDS = [
    "co.uk", "org.uk", "ltd.uk", "plc.uk", "me.uk", "net.uk", "ac.uk", "gov.uk",
    "co.jp", "co.nz", "co.za", "com.au", "com.sg", "com.br",
]
SOCIAL_STOPWORDS = [
    "share", "sharer", "intent", "home", "explore", "login", "signup", "about",
    "tv", "reel", "reels", "tag", "tags", "search",
]
GENERIC_MAILBOXES = [
    "info", "contact", "hello", "hi", "enquiries", "enquiry", "admin", "support", "help",
    "sales", "marketing", "press", "bookings", "reception", "noreply", "no-reply", "donotreply",
]
IMAGE_SUFFIXES = [".png", ".jpg", ".webp", ".gif", ".svg"]

# ---- fixed values: registry rules ------------------------------------------
ACCOUNTS_ALLOWED = ["small", "medium", "full", "unaudited-abridged", "audited-abridged"]
DORMANT_TYPES = ["DORMANT", "AA02", "MICRO_DORMANT", "DORMANT_LBG"]
NOMINEE_FRAGMENTS = [
    "20-22 wenlock road, london",
    "kemp house, 152-160 city road",
    "kemp house, 124 city road",
    "office 7338, 182-184 high street north",
    "27 old gloucester street, london",
    "85 great portland street",
    "5 brayford square",
    "71-75 shelton street",
    "international house, 24 holborn viaduct",
    "international house, 776-778 barking road",
    "international house, 142 cromwell road",
    "international house, 12 constance street",
    "58 peregrine road",
    "office 11528, po box 6945",
    "1 mayfair place",
    "37th floor, one canada square",
    "salatin house",
    "suite 305 griffin house",
    "the maltings, east tyndall street",
    "third floor, 207 regent street",
    "5 jupiter house",
]
BOARD_ROLES = ["director", "llp-member"]
ACTIVE_CHARGE_STATUSES = ["outstanding", "part-satisfied"]
OFFICE_MOVE_PATTERN = "(?i)change.*registered.*office"
CAPITAL_EVENT_PATTERN = "(?i)allotment|increase.*capital|share.*allotment"
ANNIVERSARY_YEARS = [5, 10, 15, 20, 25, 30]
PRE_SCORE_FLOOR = 30

# ---- fixed values: places payloads -----------------------------------------
BLOCKED_PLACE_TYPES = [
    "supermarket", "department_store", "shopping_mall", "convenience_store",
    "warehouse_store", "discount_store", "gas_station",
]

# ---- fixed values: website checks ------------------------------------------
PARKED_DOMAINS = [
    "sedoparking.com", "bodis.com", "hugedomains.com", "afternic.com", "dan.com",
    "godaddy.com/domainfind", "namecheap.com", "register.com", "parkingcrew.net",
    "domainmarket.com", "undeveloped.com", "1and1.com", "ionos.com",
]
SOCIAL_HOSTS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linktr.ee",
    "linktree.com",
]
PARKED_PHRASES = [
    "this domain is for sale", "domain is parked", "buy this domain", "domain has expired",
    "this site is under construction", "parked by", "domain parking", "godaddy.com/domainfind",
]

# ---- fixed values: page extraction -----------------------------------------
EMAIL_PATTERN = r"(?i)(?:mailto:)?([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"
TEL_PATTERN = r"(?i)tel:([+\d][\d\s().-]{6,})"
PAGE_POSTCODE_PATTERN = r"\b[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}\b"
# network -> (pattern, capture group taken, stop words apply to group 1)
SOCIAL_PATTERNS = {
    "instagram": (r"""(?i)instagram\.com/([A-Za-z0-9_.]+)(?:/|["'?#])""", 1, True),
    "linkedin": (r"(?i)linkedin\.com/(?:company|in|school)/([A-Za-z0-9\-_%]+)", 0, False),
    "facebook": (r"""(?i)facebook\.com/([A-Za-z0-9.\-_]+)(?:/|["'?#])""", 0, True),
    "twitter": (r"""(?i)(?:twitter|x)\.com/([A-Za-z0-9_]+)(?:/|["'?#])""", 1, True),
    "tiktok": (r"(?i)tiktok\.com/@([A-Za-z0-9_.]+)", 1, False),
    "youtube": (r"(?i)youtube\.com/(?:@|c/|channel/|user/)([A-Za-z0-9_\-]+)", 0, False),
}
LD_BLOCK_PATTERN = (
    r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
)
LD_ORG_TYPES = [
    "Organization", "LocalBusiness", "ProfessionalService", "RealEstateAgent", "Dentist",
    "HomeAndConstructionBusiness", "AutomotiveBusiness", "Store", "Corporation",
]
PEOPLE_ROLES = [
    "Founder", "Co-Founder", "Co Founder", "Owner", "Director", "Managing Director", "MD",
    "CEO", "COO", "Chief Operating Officer", "Operations Director", "Head of Operations",
    "Operations Manager", "Commercial Director", "Sales Director", "Head of Sales",
    "Principal", "Partner", "Senior Partner", "Managing Partner", "Practice Manager",
    "Practice Principal",
]
SUBPAGE_WEIGHTS = [
    (r"/contact(?:-us)?/?$", 100),
    (r"/contact", 90),
    (r"/get-in-touch", 85),
    (r"/about(?:-us)?/?$", 80),
    (r"/about", 70),
    (r"/our-story", 65),
    (r"/team/?$", 75),
    (r"/our-team", 75),
    (r"/meet-(?:the-)?team", 75),
    (r"/staff", 70),
    (r"/people", 60),
    (r"/directors?", 75),
    (r"/management", 70),
    (r"/partners", 70),
    (r"/founder", 85),
    (r"/owner", 80),
    (r"/leadership", 70),
    (r"/press", 40),
    (r"/partnerships?", 45),
]
ASSET_PATTERN = r"(?i)\.(pdf|jpg|jpeg|png|webp|gif|svg|mp4|mp3|zip|css|js)(\?|$)"
SITEMAP_WORDS = [
    "contact", "about", "team", "founder", "owner", "staff", "people", "leadership",
    "services", "what-we-do", "meet", "management", "directors", "careers", "jobs",
    "case-studies", "clients",
]
VAT_LABELLED_PATTERN = r"(?i)\bVAT[^A-Za-z0-9]{0,40}((?:GB)?\s*\d[\d\s]{7,14}\d)"
VAT_BARE_PATTERN = r"\bGB\s*(\d{9})\b"

# ---- fixed values: filed accounts ------------------------------------------
ACCOUNTS_TAGS = {
    "turnover": [
        "Turnover", "TurnoverRevenue", "TurnoverGrossOperatingRevenue", "Revenue",
    ],
    "employees": [
        "AverageNumberEmployeesDuringPeriod", "AverageNumberEmployees",
        "AverageNumberOfEmployees", "EmployeesTotal",
    ],
    "profit": [
        "ProfitLoss", "ProfitLossOnOrdinaryActivitiesBeforeTax", "ProfitLossBeforeTax",
        "ProfitLossAfterTax", "OperatingProfitLoss",
    ],
}
ACCOUNTS_MIN_CHARS = 1000

# ---- fixed values: inbound mail --------------------------------------------
BOUNCE_SENDER_PATTERNS = [r"(?i)^(postmaster|mailer-daemon|mail-daemon|no-?reply)@"]
BOUNCE_SUBJECT_PATTERNS = [
    r"(?i)^(undeliverable|delivery (status notification|has failed)|mail delivery (failed|system))",
    r"(?i)failure notice",
    r"(?i)returned mail",
]
AUTO_SUBJECT_PATTERNS = [
    r"(?i)^(auto(matic)?[- ]?(reply|response)|out of (the )?office|ooo\b|away from)",
    r"(?i)\bauto[- ]?reply\b",
    r"(?i)\bon holiday\b",
    r"(?i)\bannual leave\b",
]
AUTO_BODY_PATTERNS = [
    r"(?i)currently (out of the office|on annual leave|on holiday)",
    r"(?i)i (am|'m) (currently )?(out of (the )?office|away|on leave)",
    r"(?i)thank you for (your email|reaching out|contacting us).{0,80}"
    r"(will (get back|respond|reply)|within \d+ (hours|business days))",
    r"(?i)this is an automated (reply|response|message)",
    r"(?i)(we'll|we will|someone will) be (in touch|with you) (within|shortly|soon)",
]
BOUNCED_ADDRESS_PATTERNS = [
    r"(?i)Original-Recipient:\s*rfc822;\s*([^\s;]+)",
    r"(?i)Final-Recipient:\s*rfc822;\s*([^\s;]+)",
    r"(?i)(?:to|for)\s+<?([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})>?\s+(?:because|failed|could not)",
    r"(?i)<([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})>",
]
AWAITING_REPLY = ["outreach_sent", "follow_up_queued", "follow_up_sent"]

# ---- fixed values: lead status machine --------------------------------------
# (event, status it is accepted in or '*', status it leads to or '=')
LEAD_STATUSES = [
    "new_lead", "enriching", "verifying", "verified", "verification_failed",
    "waiting_concierge", "outreach_sent", "follow_up_queued", "follow_up_sent", "interested",
    "not_interested", "needs_review", "rejected", "exclude", "suppressed",
]
LEAD_TRANSITIONS = [
    ("subsidiary_found", "new_lead", "needs_review"),
    ("start_enrichment", "new_lead", "enriching"),
    ("research_failed", "enriching", "new_lead"),
    ("research_given_up", "enriching", "needs_review"),
    ("scrape_failed", "enriching", "new_lead"),
    ("no_email", "enriching", "exclude"),
    ("found_duplicate", "enriching", "exclude"),
    ("start_verification", "enriching", "verifying"),
    ("verification_passed", "verifying", "verified"),
    ("verification_low", "verifying", "verification_failed"),
    ("low_tier", "verified", "exclude"),
    ("routed", "verified", "waiting_concierge"),
    ("approve_tier", "waiting_concierge", "outreach_sent"),
    ("approve_blocked", "waiting_concierge", "="),
    ("reject_tier1", "waiting_concierge", "rejected"),
    ("reject_tier2", "*", "rejected"),
    ("queue_follow_up", "outreach_sent", "follow_up_queued"),
    ("approve_follow_up", "follow_up_queued", "follow_up_sent"),
    ("reject_follow_up", "follow_up_queued", "outreach_sent"),
    ("sent_item", "waiting_concierge", "outreach_sent"),
    ("sent_item", "follow_up_queued", "follow_up_sent"),
    ("bounce", "*", "verification_failed"),
    ("reply_positive", "outreach_sent", "interested"),
    ("reply_positive", "follow_up_queued", "interested"),
    ("reply_positive", "follow_up_sent", "interested"),
    ("reply_hard_no", "outreach_sent", "not_interested"),
    ("reply_hard_no", "follow_up_queued", "not_interested"),
    ("reply_hard_no", "follow_up_sent", "not_interested"),
    ("reply_other", "outreach_sent", "needs_review"),
    ("reply_other", "follow_up_queued", "needs_review"),
    ("reply_other", "follow_up_sent", "needs_review"),
    ("auto_reply", "outreach_sent", "="),
    ("auto_reply", "follow_up_queued", "="),
    ("auto_reply", "follow_up_sent", "="),
]
