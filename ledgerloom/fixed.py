"""Fixed values of the domain: word lists, patterns, code tables and formats that results depend on."""

# All values below are fixed values: changing one changes results.

SECTION_TYPES = ["business", "risk_factors", "mda", "8k"]
FORM_TYPES = ["10-K", "10-K405", "10KSB", "10-KSB", "10KSB40"]
EVENT_FORM_TYPES = ["8-K", "8-K/A", "8-K12B", "8-K12G3", "8-K15D5"]

FORWARD_LOOKING = [
    r"\bwill\b", r"\bwould\b", r"\bexpect[s]?\b", r"\bexpected\b", r"\bexpecting\b", r"\banticipate[ds]?\b", r"\bbelieve[ds]?\b",
    r"\bintend[s]?\b", r"\bintended\b", r"\bplan[s]?\b", r"\bplanned\b", r"\bmay\b", r"\bmight\b", r"\bcould\b", r"\bshould\b",
    r"\bforecast[s]?\b", r"\bguidance\b", r"\boutlook\b", r"\bprojec(?:t|ts|ted|tion)\b", r"\bestimate[ds]?\b",
    r"\bforward.looking\b", r"\bsafe.harbour\b", r"\bsafe.harbor\b", r"we believe", r"we expect", r"we anticipate", r"we intend",
    r"in the future", r"going forward",
]
COMPANY_REFERENCES = [
    r"\bwe\b", r"\bour\b", r"\bours\b", r"\bus\b", r"\bthe company\b", r"\bthe corporation\b", r"\bthe registrant\b", r"\bthe firm\b",
]
SELF_REFERENCES = ["company", "corporation", "registrant", "we", "our", "us", "firm"]

BOILERPLATE = ["(?i)Table of Contents", "(?i)forward[- ]looking statements?", r"(?im)^\s*page\s+\d+\s*$", r"(?m)^\s*\d+\s*$"]

DEFINITION = r"([A-Za-z][A-Za-z0-9 \-]{1,50}?)\s+(?:means|refers to|is defined as|defined as|we define.*?as|shall mean)\s+([^.;]{10,200})"
ACRONYM = r"([A-Z][A-Za-z][A-Za-z0-9 \-]{2,50}?)\s*\(([A-Z]{2,8})\)"
QUOTED_TERM = r'"([A-Za-z][A-Za-z0-9 \-]{2,50}?)"'
MONEY = r"\$[\d,.]+ ?(?:million|billion|trillion)?"
PERCENT = r"\d+\.?\d*\s*%"
ITEM_CODE = r"^(\d+\.\d+)"

DOMAINS = {
    "financial": ["revenue", "profit", "loss", "ebitda", "margin", "cash", "debt", "equity", "income", "expense"],
    "risk": ["risk", "exposure", "uncertainty", "volatility"],
    "regulatory": ["regulat", "compliance", "law", "act", "sec", "fda", "ftc", "gdpr"],
    "technology": ["software", "platform", "cloud", "ai", "ml", "data", "cyber", "technology", "tech"],
    "market": ["market", "customer", "segment", "competitor", "industry", "demand"],
    "operational": ["operation", "supply chain", "logistics", "manufactur", "headcount"],
    "legal": ["contract", "agreement", "litigation", "lawsuit", "intellectual property"],
}

HIGH_SEVERITY = [
    r"going[\s\-]concern", r"material\s+weakness", r"\bcovenants?\b", r"\bbreach\b", r"\bdefault\b", r"liquidity\s+risk",
    r"\binsolvency\b", r"\bbankruptcy\b", r"regulatory\s+action", r"\brestatement\b", r"class[\s\-]action", r"securities\s+litigation",
    r"\bsanctions?\b", r"cyberattack", r"data\s+breach", r"material\s+adverse",
]
MEDIUM_SEVERITY = [
    r"\buncertain", r"significant\s+risk", r"material\s+risk", r"\bcybersecurity\b", r"intellectual\s+property", r"concentration\s+risk",
    r"key\s+personnel", r"market\s+risk", r"supply\s+chain", r"regulatory\s+compliance", r"competitive\s+pressur", r"interest\s+rate",
    r"foreign\s+currency", r"climate\s+change",
]
REASONS = [
    (r"going[\s\-]concern", "Going concern language — potential viability risk"),
    (r"material\s+weakness", "Material weakness in internal controls"),
    (r"\bcovenants?\b|\bbreach\b|\bdefault\b", "Covenant or credit facility risk"),
    (r"data\s+breach|cyberattack|cybersecurity", "Cybersecurity / data breach risk escalation"),
    (r"class[\s\-]action|securities\s+litigation", "Securities litigation risk"),
    (r"\bsanctions?\b", "Regulatory sanctions risk"),
    (r"\bliquidity\b", "Liquidity position or financing risk"),
    (r"supply\s+chain", "Supply chain disruption risk"),
    (r"\brestatement\b", "Financial restatement risk"),
    (r"material\s+adverse", "Material adverse change disclosed"),
]
REASON_ADDED, REASON_OTHER = "New risk disclosure added", "Risk disclosure removed or changed"

INCREASE_WORDS = ["increased", "grew", "higher", "growth", "improvement"]
DECREASE_WORDS = ["decreased", "declined", "lower", "reduction", "fell"]
POSITIVE_WORDS = ["expect growth", "confident", "strong", "opportunit", "positive", "increase", "expand"]
CAUTIOUS_WORDS = ["risk", "uncertain", "challenge", "headwind", "difficult", "pressure"]

SEMANTIC_SIGNALS = [
    "mda", "md&a", "management discussion", "management opinion", "outlook", "opinion", "narrative", "tone", "sentiment",
    "what did management say", "what does management think", "how did they describe", "what was said about", "supply chain risk",
    "risk mention", "risk factor",
]
GRAPH_SIGNALS = [
    "competitor", "competes with", "geographic", "market", "country", "metric", "revenue", "filing count", "how many",
    "which companies", "list", "most common", "top ", "compare",
]
FORBIDDEN_QUERY = r"(?i)\b(DELETE|DETACH|DROP|CREATE|MERGE|SET|REMOVE|CALL\s+apoc\.periodic)\b"
FORBIDDEN_SQL = r"(?i)\b(INSERT|UPDATE|ALTER|TRUNCATE|REPLACE|GRANT|REVOKE|LOAD|REFRESH|ADD|ANALYZE|CACHE|UNCACHE)\b"

ITEM_CATEGORIES = {
    "1.01": "material_agreement", "1.02": "agreement_termination", "1.03": "bankruptcy",
    "2.01": "asset_acquisition", "2.02": "earnings_results", "2.03": "direct_obligation", "2.04": "triggering_events",
    "2.05": "asset_disposal", "2.06": "material_impairment",
    "3.01": "delisting", "3.02": "unregistered_sales",
    "4.01": "auditor_change", "4.02": "non_reliance_financials",
    "5.01": "change_of_control", "5.02": "officer_director_change", "5.03": "charter_amendment", "5.04": "shareholder_rights",
    "5.05": "compensation_plan", "5.06": "shell_company_change", "5.07": "shareholder_vote", "5.08": "director_compensation",
    "6.01": "ats_notification", "7.01": "regulation_fd", "8.01": "other_events", "9.01": "financial_statements",
}

#: Relation types with the labels of their ends.
RELATIONS = {
    "FILED_BY": ("Filing", "Company"), "HAS_SECTION": ("Filing", "Section"), "FILED_IN": ("Filing", "FiscalYear"),
    "PRECEDES": ("FiscalYear", "FiscalYear"), "HAS_SEGMENT": ("Company", "BusinessSegment"), "OFFERS": ("Company", "Product"),
    "OPERATES_IN": ("Company", "GeographicMarket"), "TARGETS": ("Company", "CustomerSegment"), "COMPETES_WITH": ("Company", "Competitor"),
    "SUBJECT_TO": ("Company", "Regulation"), "INCLUDES": ("BusinessSegment", "Product"), "HAS_RISK": ("Company", "RiskFactor"),
    "CAUSED_BY": ("RiskFactor", "RiskDriver"), "MAY_RESULT_IN": ("RiskFactor", "RiskConsequence"), "MITIGATED_BY": ("RiskFactor", "Mitigation"),
    "RELATED_TO": ("RiskFactor", "RiskFactor"), "SUPERSEDES": ("RiskFactor", "RiskFactor"), "REPORTS": ("Company", "FinancialMetric"),
    "ATTRIBUTED_TO": ("FinancialMetric", "BusinessSegment"), "DRIVEN_BY": ("FinancialMetric", "Driver"), "IMPACTED_BY": ("FinancialMetric", "MacroFactor"),
    "HAS_OUTLOOK": ("Company", "ManagementOutlook"), "REFERENCES": ("ManagementOutlook", "FinancialMetric"), "AFFECTS": ("RiskFactor", "BusinessSegment"),
    "MATERIALISED_AS": ("RiskFactor", "FinancialMetric"), "CITED_IN": ("MacroFactor", "RiskFactor"), "REPORTED_IN": ("BusinessSegment", "FinancialMetric"),
}
FIRST_YEAR, LAST_YEAR = 1993, 2027
CONFIDENCE = 0.85
MITIGATION_TYPES = ["insurance", "hedging", "diversification", "policy", "contract", "other"]
DIRECTIONS = ["increase", "decrease", "flat", "not_stated"]
MACRO_DIRECTIONS = ["headwind", "tailwind", "neutral"]
SENTIMENTS = ["positive", "cautious", "negative", "neutral"]
HORIZONS = ["near_term", "full_year", "multi_year"]
BASES = ["GAAP", "non-GAAP"]
DRIVER_TYPES = ["revenue_driver", "cost_driver"]

MARKET_CODES = {
    "united states": "US", "us": "US", "usa": "US", "u.s.": "US", "united kingdom": "GB", "uk": "GB", "china": "CN", "prc": "CN",
    "germany": "DE", "japan": "JP", "india": "IN", "canada": "CA", "france": "FR", "south korea": "KR", "taiwan": "TW", "israel": "IL",
    "australia": "AU", "brazil": "BR", "mexico": "MX", "global": "GLOBAL", "worldwide": "GLOBAL", "international": "INTL",
}
COUNTRY_CODES = {
    "UNITED STATES": "USA", "U.S.": "USA", "US": "USA", "USA": "USA", "UNITED STATES OF AMERICA": "USA",
    "CHINA": "CHN", "PEOPLE'S REPUBLIC OF CHINA": "CHN", "PRC": "CHN", "MAINLAND CHINA": "CHN",
    "JAPAN": "JPN", "GERMANY": "DEU", "UNITED KINGDOM": "GBR", "UK": "GBR", "GREAT BRITAIN": "GBR", "ENGLAND": "GBR",
    "FRANCE": "FRA", "CANADA": "CAN", "AUSTRALIA": "AUS", "INDIA": "IND", "BRAZIL": "BRA", "MEXICO": "MEX",
    "SOUTH KOREA": "KOR", "KOREA": "KOR", "REPUBLIC OF KOREA": "KOR",
    "ITALY": "ITA", "SPAIN": "ESP", "NETHERLANDS": "NLD", "SWITZERLAND": "CHE", "SWEDEN": "SWE", "RUSSIA": "RUS", "RUSSIAN FEDERATION": "RUS",
    "TAIWAN": "TWN", "SINGAPORE": "SGP", "HONG KONG": "HKG", "MALAYSIA": "MYS", "INDONESIA": "IDN",
    "THAILAND": "THA", "VIETNAM": "VNM", "VIET NAM": "VNM", "ISRAEL": "ISR", "SAUDI ARABIA": "SAU", "UAE": "ARE", "UNITED ARAB EMIRATES": "ARE",
    "SOUTH AFRICA": "ZAF", "NIGERIA": "NGA", "EGYPT": "EGY", "TURKEY": "TUR", "POLAND": "POL", "CZECH REPUBLIC": "CZE", "CZECHIA": "CZE",
    "HUNGARY": "HUN", "ROMANIA": "ROU", "AUSTRIA": "AUT", "BELGIUM": "BEL", "DENMARK": "DNK", "FINLAND": "FIN", "NORWAY": "NOR", "PORTUGAL": "PRT",
    "GREECE": "GRC", "IRELAND": "IRL", "NEW ZEALAND": "NZL", "PHILIPPINES": "PHL", "ARGENTINA": "ARG", "CHILE": "CHL",
    "COLOMBIA": "COL", "PERU": "PER", "PAKISTAN": "PAK", "BANGLADESH": "BGD", "SRI LANKA": "LKA", "MYANMAR": "MMR",
    "CAMBODIA": "KHM", "LUXEMBOURG": "LUX", "CROATIA": "HRV", "SLOVAKIA": "SVK", "SLOVENIA": "SVN", "BULGARIA": "BGR",
    "SERBIA": "SRB", "UKRAINE": "UKR", "KENYA": "KEN", "GHANA": "GHA", "ETHIOPIA": "ETH", "MOROCCO": "MAR", "ALGERIA": "DZA", "TUNISIA": "TUN",
    "QATAR": "QAT", "KUWAIT": "KWT", "BAHRAIN": "BHR", "OMAN": "OMN", "JORDAN": "JOR", "IRAN": "IRN", "IRAQ": "IRQ", "CZECH": "CZE", "KOREA SOUTH": "KOR",
}
REGIONS = [
    "EUROPE", "ASIA", "ASIA PACIFIC", "ASIA-PACIFIC", "APAC", "LATIN AMERICA", "SOUTH AMERICA", "NORTH AMERICA", "CENTRAL AMERICA",
    "MIDDLE EAST", "AFRICA", "EMEA", "NORTH AFRICA", "SOUTHEAST ASIA", "CARIBBEAN", "WESTERN EUROPE", "EASTERN EUROPE", "PACIFIC RIM", "GREATER CHINA",
]

MARKET_ALIASES = {
    "U.S.": "the United States", "U.S": "the United States", "US": "the United States", "USA": "the United States",
    "United States": "the United States", "United States of America": "the United States",
    "U.K.": "UK", "U.K": "UK", "Great Britain": "UK", "United Kingdom": "UK",
    "E.U.": "EU", "European Union": "EU", "PRC": "China", "People's Republic of China": "China", "CA": "California",
}
MARKET_KEPT = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "GU", "VI",
    "UK", "EU", "UAE", "NZ", "HK", "SG", "JP", "KR", "AU", "FR", "CH", "NL", "SE", "NO", "FI", "DK",
    "BE", "IT", "ES", "PT", "PL", "CZ", "AT", "GR", "TR", "ZA", "NG", "EG", "AE",
    "BC", "ON", "QC", "AB", "MB", "SK", "NS", "NB", "PE", "NSW", "VIC", "QLD", "SA", "TAS", "ACT", "NT",
    "NYC", "DFW", "LAX", "SFO", "BOS", "KSA",
]
MARKET_NOISE_PHRASES = [
    "non-u.s.", "non-us", "non u.s", "non-u.s", "non-domestic", "ex-u.s", "u.s. federal", "u.s. state", "quarter",
    " q1 ", " q2 ", " q3 ", " q4 ", "segment", "division", "operations", "non-gaap", "stock exchange", "reporting unit",
]
MARKET_NOISE_PATTERNS = [r"^\d", r"^\W", r"\$\s*\d", r"\.{2,}", r"^\s*$", r"(?s).{150,}", r"(?i)^Q[1-4]$", r"\d{3,}", r"(?i)[a-z]\d[a-z]"]

METRIC_NOISE_PREFIXES = [
    "an ", "a ", "the ", "of ", "as ", "due to", "primarily", "partially", "offset", "compared", "million", "billion",
    "approximately", "including", "net of", "in addition", "together with", "in connection", "pursuant to", "representing",
    "consisting", "resulting", "relating", "reflecting", "certain", "various", "other ", "these ", "those ", "which ", "such ",
    "this ", "its ", "our ", "their ", "all ", "no ", "any ", "each ",
]
METRIC_NOISE_SUFFIXES = [
    " of", " by", " to", " a", " an", " the", " was", " were", " is", " are", " in", " and", " or", " for", " on", " at",
    " from", " with", " as", " than", " that", " which", " including", " approximately", " million", " billion", " thousand",
]
METRIC_NOISE_PATTERNS = [
    r"^\d", r"^[a-z]", r"\bactivities (was|were|of)\b", r"^(increase|decrease|change) (of|in)\b", r"\bcompared to\b",
    r"\boffset by\b", r"\bprimarily (due|driven|related)\b", r"^(total|aggregate) (of|amount)\b", r"\d+\s*(million|billion|thousand)",
]

COMPETITOR_NOISE_PHRASES = [
    "board of directors", "general counsel", "audit committee", "compensation committee", "nominating committee",
    "governance committee", "risk committee", "beneficial owners",
    "securities and exchange commission", "financial accounting standards board", "public company accounting oversight",
    "internal revenue service", "federal reserve", "department of justice", "department of defense", "department of health",
    "centers for medicare", "food and drug administration", "federal trade commission", "consumer financial protection",
    "office of the comptroller", "u.s. government", "u.s. congress", "u.s. senate", "u.s. house",
    "european union", "european commission", "european economic area", "world health organization", "world trade organization",
    "form s-3", "form s-1", "form s-4", "form 10-k", "form 10-q", "form 8-k", "form 4",
    "item 1a", "item 1b", "item 1", "item 2", "item 7", "annual report", "quarterly report", "proxy statement", "current reports",
    "cybersecurity risk management", "off-balance sheet", "independent registered public accounting",
    "note payable", "notes payable", "accounts receivable", "accounts payable", "income tax", "net income", "operating income",
    "gross profit", "total revenue", "total assets", "common stock", "preferred stock", "per share", "earnings per share",
    "net interest", "interest income", "interest expense", "capital resources", "capital expenditure", "financial instruments",
    "financial statements", "credit facility", "revolving credit", "adjusted ebitda", "adjusted ebit", "research and development",
    "selling, general",
    "chief executive officer", "chief financial officer", "chief operating officer", "chief technology officer",
    "chief information officer", "chief legal officer", "president and ceo", "vice president", "general partner", "limited partner",
    "management's discussion", "management discussion",
    "business combinations", "intellectual property", "anti kickback", "stark law", "affordable care act", "class a", "class b", "class c",
    "stock compensation", "stock-based compensation", "fair value",
    "management's", "regulation s-k", "regulation s-x", "regulation a", "accounting standards", "generally accepted", "stock exchange",
    "supplement", "supplementary data", "controls and procedures", "operations of the", "branch operations", "direct loan",
    "greenhouse gas", "net operating loss", "the toronto stock", "the london stock", "the new york stock",
    "consolidated financial", "intangibles", "inter partes", "qui tam", "business conduct", "good delivery", "national association",
    "loan servicing", "deferred tax", "staff accounting", "risk evaluation",
    "non-gaap", "information technology", "business combination", "initial public offering", "goodwill goodwill", "good manufacturing",
]
COMPETITOR_NOISE_PATTERNS = [
    r"^[\$\#\@\"\'\`]", r"^\d", r"^\W", r"\$\s*\d", r"^\s*\d[\d,\.]+\s", r"[\"“”]", r"\.{3,}", r"^\s*$", r".{200,}",
    r"(?i)^[A-Z][a-z]+'s$", r"(?i)^[Tt]he\s.*(exchange|commission|authority|bureau|authority|agency|board)$", r"^[A-Z]{1,2}$",
    r"[a-z]\d[a-z]?$", r"(?s).{120,}",
]

# Numbers of nodes that are told of, tries of a model, and seconds before the second try.
MILESTONES = (1000, 5000, 10000, 50000, 100000, 500000)
MODEL_TRIES = 5
MODEL_WAIT = 5.0
