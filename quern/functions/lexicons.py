"""Word lists, patterns, templates and thresholds. All are defaults of parameters."""

from __future__ import annotations

# Relevance scoring.
RELEVANCE_TERMS = ["mutual fund", "fund", "sip", "nav", "expense ratio", "exit load", "lock-in", "risk", "benchmark", "aum", "scheme", "elss", "direct growth", "fund manager", "portfolio", "minimum investment"]
NOISE_TERMS = ["stocks", "intraday", "ipo", "option chain", "demat", "f&o", "api trading", "brokerage calculator", "margin calculator", "share market today"]

# Parts of a lower-cased entity name and what stands for them in an alias; more aliases of names with a term.
ALIAS_REPLACEMENTS = [(" direct growth", ""), (" direct plan growth", ""), (" direct", ""), (" growth", ""), (" fund", ""), (" hdfc ", " "), ("hdfc ", "")]
ALIAS_TERMS = {
    "mid cap": ["mid cap", "midcap", "mid-cap"],
    "large cap": ["large cap", "largecap", "large-cap"],
    "equity": ["equity"],
    "focused": ["focused"],
    "elss": ["elss", "tax saver"],
    "tax saver": ["tax saver", "elss"],
}

# Lines that are boilerplate as a whole.
BOILERPLATE_LINES = ["download app", "open demat account", "invest now", "sign in", "sign up", "login", "read more", "view all"]

# Overlap chunker.
CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP = 600, 900, 150

# Tokens kept in queries and abbreviations with their expansions.
DOMAIN_TOKENS = [
    "elss", "sip", "nav", "aum", "etf", "liquid", "debt", "equity", "hybrid",
    "arbitrage", "index", "large-cap", "mid-cap", "small-cap", "multi-cap",
    "focused", "value", "growth", "dividend", "direct", "regular",
    "expense", "ratio", "exit", "load", "lock-in", "lockin", "tenure", "duration",
    "returns", "risk", "rating", "crisil", "amfi", "sebi", "amc",
    "1yr", "1y", "1year", "3yr", "3y", "3year", "5yr", "5y", "5year",
    "10yr", "10y", "10year", "ytd", "annual", "monthly", "weekly", "daily",
    "rs", "₹", "inr", "percent", "%", "basis", "points", "bps",
    "invest", "buy", "sell", "redeem", "switch", "withdraw", "deposit",
]
ABBREVIATIONS = {
    "elss": "equity linked savings scheme",
    "sip": "systematic investment plan",
    "nav": "net asset value",
    "aum": "assets under management",
    "etf": "exchange traded fund",
    "amc": "asset management company",
    "amfi": "association of mutual funds in india",
    "sebi": "securities and exchange board of india",
    "crisil": "credit rating information services of india limited",
}
PERIOD_TERMS = ["year", "month", "day", "ytd"]
FINANCIAL_TERMS = ["expense", "ratio", "exit", "load", "lockin", "returns"]
ENTITY_INDICATORS = ["mid cap", "large cap", "small cap", "focused", "equity", "debt", "hybrid", "elss", "tax saver", "liquid", "arbitrage", "index"]

# Section boosts.
SECTION_BOOSTS = {"expense": 1.3, "ratio": 1.3, "exit": 1.3, "load": 1.3, "sip": 1.2, "systematic": 1.2, "nav": 1.2, "asset": 1.2, "risk": 1.2, "rating": 1.2, "lockin": 1.3, "lock": 1.3, "period": 1.2}

# Intent patterns, case-insensitive.
INTENT_PATTERNS = {
    "advisory": [
        r"\b(should|would|could|recommend|suggest|advise)\b.*\b(invest|buy|sell|switch|choose|pick)\b",
        r"\b(is it|would it be)\s+(good|better|wise|smart|advisable)\s+to\s+(invest|buy)",
        r"\b(how much|what amount)\s+(should|would)\s+(i\s+)?(invest|allocate)",
        r"\b(best|top|recommended|ideal)\s+(mutual fund|scheme|investment)",
        r"\b(should i|can i)\s+(invest|put|allocate)\s+(money|rs|₹)",
        r"\b(is this|would this be)\s+(a\s+)?(good|bad|safe|risky)\s+(investment|choice)",
        r"\b(what|which)\s+(fund|scheme)\s+(should\s+)?(i\s+)?(choose|pick|select)",
        r"\b(are you|do you)\s+(think|believe|recommend)\s+(i\s+)?(should|should not)",
        r"\b(advice|guidance|suggestion)\b",
        r"\b(better than|worse than|outperform|underperform)\b",
        r"\b(will|would)\s+(likely|probably|definitely)\s+(perform|do|give)",
    ],
    "comparison": [
        r"\b(which|what)\s+(is\s+)?(better|worse|best|worst)",
        r"\b(compare|comparison|vs|versus)\b",
        r"\b(higher|lower|greater|less)\s+(return|performance|risk|expense)",
        r"\b(more|less)\s+(profitable|suitable|appropriate)",
        r"\b(top|bottom|rank|ranking)\b",
        r"\b(one|two|three|first|second)\s+(best|worst)",
        r"\b(between|among|across)\b.*\b(funds|schemes)",
    ],
    "prediction": [
        r"\b(will|would|could|might|may|expect|predict|forecast)\b.*\b(future|next|coming)",
        r"\b(how|what)\s+(will|would|might)\s+(perform|do|be)",
        r"\b(market|economy|interest rate)\s+(will|would|likely)\s+(go|do|change)",
        r"\b(price|nav|return)\s+(will|would|should)\s+(increase|decrease|rise|fall)",
        r"\b(next|upcoming|future)\s+(quarter|year|month)",
        r"\b(target|goal|expectation)\b.*\b(return|performance)",
    ],
    "unsupported": [
        r"\b(tax|legal|account|bank)\s+(advice|planning|guidance)",
        r"\b(contact|support|customer service)\b",
        r"\b(login|password|access|account)\s+(issue|problem|help)",
        r"\b(other|different|another)\s+(AMC|fund house|company)",
        r"\b(international|global|us|europe)\s+(market|fund)",
        r"\b(crypto|bitcoin|cryptocurrency)\b",
        r"\b(insurance|policy|claim)\b",
    ],
    "factual": [
        r"\b(what|how much|what is|what are)\s+(the\s+)?(nav|expense|ratio|aum)",
        r"\b(minimum|maximum|lock.?in|exit load|sip amount)",
        r"\b(risk|rating|category|type)\s+(level|category)",
        r"\b(scheme|fund)\s+(details|information|facts)",
        r"\b(when|how long)\s+(lock.?in|period|duration)",
        r"\b(where|how to)\s+(invest|buy|redeem)",
    ],
}

# Personal-data patterns by type, case-insensitive, and context-dependent ones.
PII_PATTERNS = {
    "pan": [r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\bpan\b.*\b\d{10}\b"],
    "aadhaar": [r"\b\d{4}\s?\d{4}\s?\d{4}\b", r"\b\d{12}\b", r"\baadhaar\b.*\b\d{12}\b"],
    "email": [r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", r"\bemail\b.*\b@\b"],
    "phone": [r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b", r"\b\d{10}\b", r"\b(?:0|91)?[-\s]?\d{10}\b"],
    "otp": [r"\botp\b.*\b\d{4,8}\b", r"\b(one time|one-time)\s+password\b", r"\bverification\s+code\b.*\b\d"],
    "account": [r"\baccount\s+(number|no|num)\b.*\b\d", r"\b(demat|folio|client)\s+(id|number)\b", r"\bportfolio\s+id\b"],
    "address": [r"\b\d+\s+[^,]+\s+[a-z]+\s+(street|road|nagar)\b", r"\b(pin|postal)\s+code\b.*\b\d", r"\baddress\b.*\b\d{6}\b"],
    "bank": [r"\b(ifsc|bank)\s+(code|branch)\b", r"\baccount\s+(number|no)\b.*\bbank\b", r"\b(neft|rtgs|imps)\s+details\b"],
    "financial_sensitive": [r"\b(income|salary|credit|debit)\s+(card|number)\b", r"\batm\s+(pin|password)\b", r"\bnet\s+banking\s+(password|pin)\b", r"\bcredit\s+card\s+(number|cvv)\b"],
}
PII_MEDIUM_PATTERNS = [r"\b\d{10,12}\b", r"\b\d{4}\s*-\s*\d{4}\s*-\s*\d{4}\b", r"\b[a-zA-Z]{2,}\d{2,4}\b"]
PII_HIGH_TYPES = ["pan", "aadhaar", "email", "phone", "otp", "address"]
PII_TEMPLATES = [
    ("pan", "I cannot process requests containing PAN card numbers for security and privacy reasons."),
    ("aadhaar", "I cannot process requests containing Aadhaar numbers for security and privacy reasons."),
    ("email", "I cannot process requests containing email addresses for security and privacy reasons."),
    ("phone", "I cannot process requests containing phone numbers for security and privacy reasons."),
    ("otp", "I cannot process requests containing OTP codes or verification codes for security reasons."),
    ("account", "I cannot process requests containing account numbers for security and privacy reasons."),
    ("bank", "I cannot process requests containing banking details for security and privacy reasons."),
]
PII_TEMPLATE_SURE = "I cannot process this request as it contains sensitive personal information for security and privacy reasons."
PII_TEMPLATE_UNSURE = "I cannot process this request as it may contain sensitive personal information for security and privacy reasons."

# Refusals.
EDUCATION_URLS = {
    "advisory": "https://www.amfiindia.com/mutual-funds-investor-education",
    "comparison": "https://www.amfiindia.com/mutual-funds-investor-education",
    "prediction": "https://www.sebi.gov.in/sebiweb/home/HomeActionAction?Q=investor%20education",
    "unsupported": "https://www.amfiindia.com/mutual-funds-investor-education",
}
REFUSAL_TEMPLATES = {
    "advisory": [
        "I can only provide factual information about mutual funds and cannot give investment advice or recommendations.",
        "For investment guidance, please consult a qualified financial advisor.",
        "I'm designed to answer factual questions about mutual fund information only.",
        "I cannot provide investment advice, but I can share factual details about fund performance and characteristics.",
    ],
    "comparison": [
        "I can provide individual fund information but cannot make comparisons or recommendations between funds.",
        "Each fund has different risk-return profiles suitable for different investor needs.",
        "For fund comparisons, please review the fact sheets or consult a financial advisor.",
        "I can share factual details about individual funds but cannot rank or compare them.",
    ],
    "prediction": [
        "I can provide historical information but cannot predict future performance or market movements.",
        "Past performance is not indicative of future results.",
        "For future outlook, please consult market research reports or financial advisors.",
        "I can share historical data and current facts but cannot make predictions about future performance.",
    ],
    "unsupported": ["This assistant supports only factual, source-backed mutual fund queries.\nInvestment advice, recommendations, comparisons, predictions, or unrelated queries are not supported."],
}
DONT_KNOW_TEMPLATES = [
    "I don't have enough information to answer this question accurately.",
    "I don't have specific information about that in my knowledge base.",
    "I'm not able to find relevant information to answer your question.",
    "I don't have sufficient details about that particular aspect.",
    "My knowledge base doesn't contain information to address your specific question.",
]
SAFE_TEMPLATE = "I apologize, but I'm unable to process your request at this time."
ADVISORY_TERMS = ["recommend", "suggest", "advise", "should", "better", "best", "worst"]
COMPARISON_TERMS = ["better than", "worse than", "compare", "vs", "versus"]

# Tokens that answers may not contain.
BANNED_TOKENS = [
    "recommend", "suggest", "advise", "should", "would", "could", "might",
    "better", "best", "worst", "top", "bottom", "higher", "lower",
    "will", "expect", "predict", "forecast", "outperform", "underperform",
    "good", "bad", "safe", "risky", "excellent", "poor",
]
FOOTER_PATTERN = r"Last updated from sources:\s*\d{4}-\d{2}-\d{2}"
URL_PATTERN = r"""https?://[^\s<>"'\)]+"""

# Patterns of the synthetic tables, for the driver's queries.
SYNTHETIC_PII = {"email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"], "phone": [r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"], "ip": [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"], "card": [r"[0-9]{16}"], "token": [r"token = \"[0-9a-f]+\""]}
SYNTHETIC_RELEVANCE, SYNTHETIC_NOISE = ["the", "and", "der", "que", "of", "les"], ["***", "!!", " | "]
