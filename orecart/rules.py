"""Word lists, patterns and weights that results depend on, as plain data."""

from __future__ import annotations

import re

# Query parameters that normalisation drops.
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid"]

# Second-level names of a plain rule: with any country's two letters they are no domain of their own.
SECOND_LEVELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org"]

# Public suffixes below the countries that discovery runs meet most, as the public list has them. A host elsewhere
# ends in its last label; a whole list comes in as a table (operators/domains.py).
COUNTRY_SUFFIXES = {
    "in": ["ac", "co", "edu", "firm", "gen", "gov", "ind", "mil", "net", "nic", "org", "res"],
    "uk": ["ac", "co", "gov", "ltd", "me", "net", "nhs", "org", "plc", "police", "*.sch"],
    "au": ["asn", "com", "edu", "gov", "id", "net", "org"],
    "nz": ["ac", "co", "cri", "geek", "gen", "govt", "health", "iwi", "kiwi", "maori", "mil", "net", "org", "parliament", "school"],
    "za": ["ac", "agric", "alt", "co", "edu", "gov", "law", "mil", "net", "ngo", "nom", "org", "school", "web"],
    "jp": ["ac", "ad", "co", "ed", "go", "gr", "lg", "ne", "or"],
    "kr": ["ac", "co", "go", "ne", "or", "pe", "re"],
    "br": ["com", "edu", "gov", "net", "org"],
    "cn": ["ac", "com", "edu", "gov", "mil", "net", "org"],
    "tw": ["club", "com", "ebiz", "edu", "game", "gov", "idv", "mil", "net", "org"],
    "hk": ["com", "edu", "gov", "idv", "net", "org"],
    "sg": ["com", "edu", "gov", "net", "org"],
    "my": ["com", "edu", "gov", "mil", "name", "net", "org"],
    "id": ["ac", "biz", "co", "go", "mil", "my", "net", "or", "sch", "web"],
    "th": ["ac", "co", "go", "in", "mi", "net", "or"],
    "il": ["ac", "co", "gov", "idf", "k12", "muni", "net", "org"],
    "tr": ["com", "edu", "gov", "net", "org"],
    "mx": ["com", "edu", "gob", "net", "org"],
    "ar": ["com", "edu", "gob", "gov", "int", "mil", "net", "org", "tur"],
    "pk": ["com", "edu", "gov", "net", "org"],
    "ke": ["ac", "co", "go", "info", "me", "mobi", "ne", "or", "sc"],
    "ng": ["com", "edu", "gov", "i", "mil", "mobi", "name", "net", "org", "sch"],
}
SUFFIX_RULES = [*(f"{'*.' if x.startswith('*.') else ''}{x.removeprefix('*.')}.{c}" for c, own in COUNTRY_SUFFIXES.items() for x in own), "*.bd", "*.np", "*.kh", "*.mm", "*.ck", "!www.ck"]

# Domains that are never a customer, with their subdomains.
BLOCKED_DOMAINS = [
    "linkedin.com", "facebook.com", "justdial.com", "indiamart.com", "tradeindia.com", "sulekha.com", "tracxn.com", "zaubacorp.com", "tofler.in",
    "clutch.co", "goodfirms.co", "g2.com", "capterra.com", "getapp.com", "yourstory.com", "inc42.com", "indiatimes.com", "rediff.com",
    "entrepreneur.com", "theaisoftwarereport.com", "wellfound.com", "glassdoor.com", "indeed.com", "naukri.com", "upwork.com", "reddit.com",
    "substack.com", "medium.com", "quora.com", "saasboomi.org", "practicalfounders.com", "softwaresuggest.com", "geeksforgeeks.org", "scribd.com",
    "pdfcoffee.com", "theirstack.com", "sapstack.com", "erpresearch.com", "saurenergy.com", "insidesap.asia", "zoominfo.com", "builtwith.com", "6sense.com",
]
BLOCKED_SUFFIXES = [".edu", ".gov", ".mil", ".ac.in", ".edu.in", ".gov.in", ".ac.uk", ".edu.au"]

# Listicle titles.
LISTICLE_TITLES = [
    r"\b(?:top\s+\d+|best\s+\d+|list\s+of|lists?\s+of|rank(?:ing|ed)?|vs\.?|versus)\b",
    r"\btop\s+\d+\b",
    r"\bbest\s+\d+\b",
    r"\b\d+\s+(?:best|top|leading|largest|biggest)\b",
    r"\blists?\s+of\b",
    r"\b\d+\s+companies\b",
    r"\b\d+\s+(?:agencies|firms|vendors|providers|tools|platforms|software|solutions)\b",
    r"\b(?:leading|largest|biggest)\s+(?:companies|agencies|firms|vendors|providers)\b",
]
# URLs of result lists, files, pagination, and system pages.
SEARCH_RESULT_URLS = [r"/search/?", r"/(search|results|find)/?", r"/s\?"]
ASSET_EXTENSIONS = "jpg|jpeg|png|gif|webp|svg|ico|avif|bmp|tif|tiff|css|js|map|json|xml|woff2?|ttf|eot|otf|mp3|mp4|webm|ogg|zip|rar|7z|gz|tar|bz2|pdf|docx?|xlsx?|pptx?|ppt|epub|csv"
CANDIDATE_EXTENSIONS = ASSET_EXTENSIONS + "|exe|dmg|apk"
PAGINATION_PATH = r"/(page|p)/\d+"
PAGINATION_QUERY = r"[?&](page|p|paged|start|offset|from|limit)=\d+"
USELESS_BRANCH = r"/(wp-admin|wp-login|wp-content|wp-includes|api|cdn|static|assets|uploads|feed|rss|comments|tag|tags|author|category)/"
USELESS_PAGE = r"/(cart|checkout|account|my-account|basket|wishlist|admin|wp-login)/?$"

# Link keywords by archetype.
ARCHETYPE_KEYWORDS = {
    "about": ["about", "about-us", "about-the-company", "company", "our-story", "who-we-are", "overview"],
    "team": ["team", "people", "our-team", "our-people", "meet-the-team"],
    "leadership": ["leadership", "leadership-team", "management", "executive-team", "executives"],
    "founders": ["founder", "founders", "founding-team"],
    "contact": ["contact", "contact-us", "get-in-touch"],
    "careers": ["careers", "jobs", "job", "opportunities", "work-with-us", "join-us", "openings", "vacancies"],
    "pricing": ["pricing", "plans", "price"],
    "blog": ["blog", "articles", "news", "insights", "resources"],
    "press": ["press", "media", "newsroom", "press-releases"],
    "product": ["product", "products", "solution", "solutions", "services"],
    "privacy": ["privacy", "privacy-policy"],
    "terms": ["terms", "terms-of-service", "terms-and-conditions", "tos"],
    "cookie": ["cookie", "cookies", "cookie-policy"],
    "login": ["login", "log-in", "signin", "sign-in", "signup", "sign-up", "register", "logout"],
    "legal": ["legal", "disclaimer", "gdpr", "compliance"],
    "archives": ["archive", "archives"],
}
# Tiers, their order and scores, precedence of archetypes, bonuses, penalties, limits.
TIERS = {"high": ["about", "team", "leadership", "founders", "contact", "careers"], "medium": ["pricing", "blog", "press", "product"], "low": ["privacy", "terms", "cookie", "login", "legal", "archives"]}
TIER_RANK = {"high": 1, "medium": 2, "low": 3, "generic": 4}
TIER_SCORE = {"high": 100, "medium": 60, "low": 10, "generic": 5}
PRECEDENCE = {"founders": 90, "leadership": 80, "team": 70, "about": 60, "contact": 50, "careers": 40, "pricing": 30, "product": 25, "blog": 20, "press": 20, "privacy": 10, "terms": 10, "cookie": 10, "login": 10, "legal": 10, "archives": 10}
HIT_BONUS = {"url": 4, "anchor": 12, "title": 8}
DEPTH_PENALTY, SEGMENT_PENALTY = 5, 3
LINKS_PER_PAGE, NEXT_FETCHES = 20, 8

# Page kinds in rule order, by patterns of the url and of title with first heading.
PAGE_RULES = [
    ("job_posting", [r"/(job|jobs|careers?|position|opening|vacanc(y|ies))/[^/?]+"], [r"\b(apply now|job title|job description|key responsibilities|qualifications)\b"]),
    ("careers_page", [r"/(careers?|jobs?|join-us|work-with-us|openings?|vacancies?)/?$"], [r"\b(careers|join our team|open positions|current openings|we are hiring|we're hiring)\b"]),
    ("contact_page", [r"/(contact|contact-us|get-in-touch|reach-us|connect|contacting)/?$"], [r"\b(contact us|get in touch|reach out|contact our team|send us a message)\b"]),
    ("team_page", [r"/(team|people|leadership|our-team|founders?|management|executives?)/?$", r"\b(our-people|meet-the-team|our-team|leadership-team|executive-team|management-team|founding-team)\b"], [r"\b(our team|meet the team|leadership team|our people|management team|our founders)\b"]),
    ("pricing_page", [r"/(pricing|plans?|price)/?$"], [r"\b(pricing|plans & pricing|our plans|packages|pricing plans)\b"]),
    ("about_page", [r"/(about|about-us|company|who-we-are|our-story|overview)/?$"], [r"\b(about us|who we are|our story|our company|about the company)\b"]),
    ("press_release", [r"/(press|press-releases?|media|newsroom)/", r"/(press|press-releases?|media|newsroom)/?$"], [r"\b(press release|for immediate release|media contact|newsroom)\b"]),
    ("blog_post", [r"/(blog|articles?|news|insights?|post)/[^/?]+"], [r"\b(published on|posted on|by [a-z0-9 ]+ \||author:)\b"]),
]
# Page kinds with contacts, and those where people are looked for.
CONTACT_ARCHETYPES = ["team_page", "careers_page", "job_posting", "contact_page"]
CONTACT_SOURCES = ["team_page", "contact_page", "about_page", "blog_post", "press_release"]

# Keyword lists of company text.
TECH_KEYWORDS = ["sap", "s/4hana", "erp", "crm", "cloud", "ai", "machine learning", "iot", "software"]
PRODUCT_KEYWORDS = ["solar panel", "solar module", "solar", "inverter", "renewable energy", "energy", "platform", "solution", "services"]
INDUSTRY_KEYWORDS = ["solar", "renewable energy", "energy", "manufacturing", "technology", "software"]

# E-mail, phone, shared mailboxes.
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"(?:\+?[0-9][0-9\s().-]{6,}[0-9])"
ROLE_MAILBOX = (
    "info|information|sales|support|contact|contactus|contact-us|hr|humanresources|careers|career|jobs|recruitment|recruiting|hello|office|admin|administration|marketing|press|media|billing|"
    "accounts?|accounts?payable|enquir(y|ies)|inquir(y|ies)|reception|frontdesk|business|team|general|help|service|services|partners?|privacy|legal|security|webmaster|postmaster|no.?reply|donotreply|"
    "apply|applications|customercare|customerservice|feedback|complaints?|abuse|investors?|investorrelations|advertising|editorial|newsroom|corporate|headquarters|info@"
)
ROLE_HINT = r"\b(ceo|cto|cfo|coo|cmo|cro|cio|founder|co[- ]?founder|president|vice president|director|manager|lead|head|chief|engineer|developer|marketing|sales|operations|revenue|growth|product|design|analyst|specialist|consultant|partner|principal|chair|executive|officer|communications|finance|people|legal|counsel|human resources)\b"
# Role categories in rule order.
ROLE_RULES = [
    ("cofounder", r"\bco[- ]?founder\b"),
    ("founder", r"\bfounder\b|\bfounding\b"),
    ("ceo", r"\bceo\b|chief executive"),
    ("technology_leader", r"\bcto\b|chief technology|cio\b|chief information|engineering|engineer|software|technical|vp engineering|head of engineering"),
    ("marketing_leader", r"\bcmo\b|chief marketing|\bmarketing\b|brand|communications|public relations|growth marketing"),
    ("revenue_leader", r"\bcro\b|chief revenue|\brevenue\b|\bcommercial\b|chief growth|\bgrowth\b"),
    ("sales_leader", r"\bsales\b|business development|account executive|account manager|partnerships"),
    ("operations_leader", r"\bcoo\b|chief operating|\boperations\b|\bpeople\b|human resources|\bhr\b|\bfinance\b|cfo\b|chief financial|\blegal\b|\bcounsel\b|customer success|\bsupport\b|\boffice\b|\badministration\b"),
    ("executive", r"\bpresident\b|vice president|\bvp\b|chief|director|managing director|chair|board|\bpartner\b|\bprincipal\b|general manager|head of|\bexecutive\b|\bsvp\b|\bevp\b|\bsme\b|\bleader\b"),
]
# Roles that count as leadership; labels of navigation lines.
LEADERSHIP_ROLES = ["founder", "cofounder", "ceo", "technology_leader", "marketing_leader", "revenue_leader", "sales_leader", "operations_leader", "executive"]
NAV_LINE = "home|about|about us|contact|contact us|team|our team|careers|jobs|services|products|solutions|pricing|menu|news|blog|privacy|terms|faq|faqs|login|sign in|sign up|register|support|help|next|previous|back|read more|learn more|view all|follow us"

# Words of person-name rules.
NAV_LABELS = [
    "home", "about", "about us", "contact", "contact us", "team", "our team", "meet the team", "leadership", "careers", "jobs", "services", "products", "solutions", "pricing",
    "login", "sign in", "sign up", "register", "menu", "search", "blog", "news", "privacy", "privacy policy", "terms", "terms of service", "faq", "faqs", "support", "help",
    "next", "previous", "back", "read more", "learn more", "view all", "get in touch", "subscribe", "follow us", "share", "email us", "call us", "phone", "address", "directions",
    "cookie policy", "sitemap", "accessibility",
]
ROLE_WORDS = [
    "ceo", "cto", "cfo", "coo", "cmo", "cro", "cio", "cso", "founder", "cofounder", "co-founder", "director", "manager", "head", "lead", "chief", "executive", "officer",
    "president", "vp", "svp", "evp", "chair", "chairman", "chairperson", "partner", "principal", "engineer", "developer", "consultant", "specialist", "analyst", "coordinator",
    "administrator", "team", "department", "sales", "marketing", "support", "operations", "engineering", "finance", "human", "resources", "hr", "legal", "counsel",
    "communications", "revenue", "growth", "product", "design", "customer", "success",
]
NAME_STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "for", "by", "with", "in", "on", "to", "from", "our", "their", "his", "her", "we", "us", "is", "are", "am", "be", "been", "being", "was",
    "were", "while", "when", "where", "what", "which", "who", "that", "this", "these", "those", "it", "you", "your", "they", "them", "can", "will", "would", "could", "should", "do",
    "does", "did", "have", "has", "had", "not", "as", "at", "grow", "numbers", "motto", "proactive", "collaborative", "purpose", "driven",
]
NAME_PARTICLES = ["da", "de", "del", "della", "der", "di", "dos", "du", "la", "le", "san", "st", "van", "von"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]

# Qualification.
NON_COMPANY = r"\b(directory|aggregator|marketplace|listicle|job board|review site|newsroom|magazine|publication|blog|wiki|tutorial|university|college|academy|forum|classifieds?|conference|event|summit|exhibition|expo)\b"
#: What every match of NON_COMPANY holds.
NON_COMPANY_STEMS = [re.sub(r".\?$", "", x) for x in re.search(r"\((.*)\)", NON_COMPANY).group(1).split("|")]
USAGE_PHRASES = r"\b(?:uses?|using|runs?\s+on|built\s+on|powered\s+by|deployed\s+on|migrated\s+to|adopted|rolled\s+out)\b"
ICP_STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "who", "which", "their", "your", "company", "companies", "business", "businesses", "based", "looking", "target", "customer", "customers"]
PLAN_STOP_WORDS = ["the", "a", "an", "and", "or", "of", "for", "by", "with", "in", "on", "to", "from", "find", "companies", "company", "that", "use", "using", "uses", "industry"]
EXCLUDED_TYPES = ["directory", "media", "article", "job_board", "review_site", "educational", "generic_info", "listicle", "person"]
LEGAL_SUFFIX = r"\b(private limited|private ltd|pvt\.?\s*ltd\.?|opc private limited|limited|llp|ltd\.?)\b"
IMPORTANT_PATHS = ["/about", "/company", "/product", "/products", "/service", "/services", "/solution", "/solutions", "/technology", "/industry", "/customer", "/client", "/case-study"]
SOURCE_ORDER = ["website", "github", "mca"]
RELATIONSHIPS = ["uses", "needs", "sells", "offers", "implements", "related_to", "unknown"]

# Harvesting of directory pages.
HARVEST_EXCLUDED = ["linkedin.com", "facebook.com", "instagram.com", "youtube.com", "x.com", "twitter.com", "wikipedia.org", "crunchbase.com", "zoominfo.com", "apollo.io", "g2.com", "capterra.com", "glassdoor.com", "indeed.com", "maps.google.com", "google.com", "play.google.com", "apps.apple.com", "amazon.com", "flipkart.com"]
HARVEST_INTERNAL = r"/(?:member|members|directory|companies|company|exhibitor|exhibitors|supplier|suppliers|vendor|vendors|listing|listings|profile|profiles|provider|providers)(?:/|$)|/page/\d+|[?&](?:page|p)=\d+"
HARVEST_PAGES, HARVEST_DOMAINS = 12, 500
HARVEST_SKIPPED = r"\.(?:jpg|jpeg|png|gif|webp|svg|pdf|css|js|zip|woff2?)(?:$|\?)|/login|/signup|/privacy|/terms"

# Content types of pages, and the largest body.
PAGE_TYPES = ["text/html", "text/plain", "application/xhtml"]
PAGE_BYTES = 2 << 20

# Columns of a target that a patch may set.
TARGET_PATCH = ["state", "attempts", "next_attempt_at", "last_error", "last_loaded_url", "last_status_code", "last_raw_page_id", "completed_at", "failed_at"]

# Search queries by what they need; {noise} is the list of excluded sites.
QUERY_TEMPLATES = {
    "query": ["{query} official website {noise}", '{query} company "about us" {noise}', "{query} customers company website {noise}"],
    "type": ['"{type}" {where} company "about us" {noise}', '"{type}" {where} official website {noise}'],
    "name": ['"{name}" {where} customers {noise}'],
}
QUERY_TYPES = 5
DORK_TEMPLATES = ['intitle:pricing "{industry}" {where} -site:g2.com -site:capterra.com', 'inurl:careers "{industry}" {where}', '{named} "{industry}" {where} company', '"{industry}" {where} "about us"', '"{industry}" {where} "official website"']

# Noise that search queries exclude.
EXCLUDED_SITES = ["linkedin.com", "facebook.com", "instagram.com", "clutch.co", "goodfirms.co", "g2.com", "justdial.com", "indiamart.com", "naukri.com", "wellfound.com", "glassdoor.com", "indeed.com", "yourstory.com", "inc42.com", "reddit.com", "medium.com", "quora.com"]

# Confidence bounds of the tiers, of promotion and of matches; sizes of a batch and of a plan.
TIER1, TIER2, PROMOTE, CONTACT_TIER1 = 0.8, 0.75, 0.6, 0.8
ACCEPT, MINIMUM = 0.8, 0.6
BATCH, SEARCH_QUERIES = 25, 8

# Domains that search results never become targets for.
SEARCH_EXCLUDED = ["linkedin.com", "facebook.com", "instagram.com", "youtube.com", "twitter.com", "x.com", "wikipedia.org", "g2.com", "capterra.com", "crunchbase.com", "glassdoor.com", "indeed.com"]

# Signals of the permanent profile, case-sensitive, first match wins.
NON_COMPANY_SIGNALS = [
    ("directory/aggregator/marketplace", r"\bdirectory\b|\baggregator\b|\bmarketplace\b"),
    ("listicle/listing", r"\blisticle\b|\blist(?:s)?\s+of\b|\btop\s+\d+\b|\bbest\s+\d+\b|\b\d+\s+(?:best|top|leading)\b"),
    ("job board", r"\bjob\s+(?:board|boards|listing|listings|openings|postings)\b|\bvacanc"),
    ("review/rating site", r"\breview\s+(?:site|platform|portal)\b|\bratings?\b|\bcomparison\b"),
    ("media/news/publication", r"\bnews\b|\bmagazine\b|\bpublication\b|\bnewsroom\b|\bpress\s+release\b|\bmedia\s+(?:brand|outlet|publication|coverage)\b"),
    ("blog/wiki/tutorial", r"\bblog\b|\bwiki\b|\btutorial\b"),
    ("educational site", r"\bacademy\b|\buniversity\b|\bcollege\b|\bcourses?\b|\btraining\s+provider\b"),
    ("forum/classifieds", r"\bforum\b|\bclassifieds?\b"),
    ("membership platform", r"\bmembership\s+platform\b"),
]
VENDOR_SIGNALS = [
    ("automation/ERP vendor", r"\b(?:we|our)\s+(?:provide|offer|sell|deliver|implement|build|develop)\b.*\b(?:erp|crm|automation|business\s+software|business\s+operating\s+system|workflow|rpa)\b"),
    ("automation/ERP services provider", r"\b(?:erp|crm|automation)\s+(?:solutions?|services?|provider|partner|consulting|consultancy|implementation)\b"),
    ("implementation/consulting partner", r"\b(?:implementation|consulting)\s+partner\b"),
    ("staffing/recruiting firm", r"\bstaff\s+augmentation\b|\brecruit(?:ment|ing)\b|\bstaffing\b"),
    ("IT services firm", r"\bit\s+services?\b|\bmanaged\s+services\b"),
]
BENEFIT_SIGNALS = [
    ("manufacturing", r"\bmanufactur"),
    ("operations", r"\boperations?\b"),
    ("business processes", r"\bprocess(?:es)?\b|\bworkflow"),
    ("supply chain", r"\bsupply\s+chain\b"),
    ("logistics", r"\blogistics\b"),
    ("inventory", r"\binventory\b"),
    ("finance/accounting/payroll", r"\bfinance\b|\baccounting\b|\bpayroll\b"),
    ("HR/workforce", r"\bhuman\s+resources\b|\bworkforce\b"),
    ("field service", r"\bfield\s+service\b"),
    ("asset management", r"\basset\b"),
    ("production", r"\bproduction\b"),
    ("quality/compliance", r"\bquality\b|\bcompliance\b"),
    ("procurement", r"\bprocurement\b"),
    ("distribution/wholesale/retail", r"\bdistribution\b|\bwholesale\b|\bretail\b"),
    ("enterprise", r"\benterprise\b"),
]

# Signals of the expert-services profile; case does not matter.
EXPERT_NON_COMPANY = r"\bdirectory\b|\baggregator\b|\bmarketplace\b|\blisticle\b|\bjob\s*board\b|\breview\s+(?:site|platform|portal)\b|\bnews(?:room)?\b|\bmagazine\b|\bpublication\b|\bblog\b|\bwiki\b|\btutorial\b|\buniversity\b|\bcollege\b|\bacademy\b|\bforum\b|\bclassifieds?\b"
EXPERT_BUSINESS = [
    ("B2B SaaS/software", r"\b(?:b2b\s+)?saas\b|\bsoftware\s+(?:company|platform|firm)\b"),
    ("agency", r"\bagency\b|\bagencies\b"),
    ("consulting", r"\bconsult(?:ing|ant|ancy)\b"),
    ("professional services", r"\bprofessional\s+services?\b"),
    ("coaching", r"\bcoach(?:ing)?\b"),
    ("IT/software services", r"\bit\s+services?\b|\bsoftware\s+services?\b"),
    ("recruitment", r"\brecruit(?:ment|ing)\b|\bstaffing\b"),
    ("marketing services", r"\bmarketing\s+(?:agency|firm|services?)\b"),
]
EXPERT_BUYERS = [
    ("founder-led", r"\bfounder\b|\bco[- ]founder\b|\bceo\b|\bowner\b"),
    ("expert-led", r"\bconsultant\b|\bcoach\b|\bfractional\b|\badvisor\b"),
]
