"""Fixed values of the lead domain: field lists, word lists, lookup tables, weights."""

# --- fixed values: canonical lead fields, in output order ---
CANONICAL_FIELDS = (
    "company_name", "agent_name", "website", "email", "phone", "location", "source",
    "confidence_score", "has_chatbot", "website_speed_score", "last_updated_signal",
    "contact_quality", "lead_score", "lead_reason",
)

# --- fixed values: fields whose value several sources may propose ---
TRACKED_FIELDS = ("website", "email", "phone", "location")

# --- fixed values: header aliases per canonical field, first present alias wins ---
HEADER_ALIASES = {
    "company_name": ("company_name", "company", "agency", "agency_name", "business", "business_name",
                     "businessname", "listing_context", "listingcontext"),
    "agent_name": ("agent_name", "agent", "contact_person", "person", "representative"),
    "website": ("website", "site", "url", "homepage", "domain"),
    "email": ("email", "agent_email", "emails", "contact_email", "contactemail", "mail"),
    "phone": ("phone", "phones", "mobile", "telephone", "tel"),
    "location": ("location", "city", "town", "region", "province", "state", "country"),
    "source": ("source", "origin", "lead_source", "data_source"),
}
FIELD_DEFAULTS = {"source": "input"}
REQUIRED_ANY = ("company_name",)

# --- fixed values: keys under which an enveloped JSON file may hold its record list ---
JSON_LIST_KEYS = ("leads", "data", "results", "items")
LISTING_LIST_KEYS = ("leads", "leadList", "data", "results", "items", "records")

# --- fixed values: shapes of contacts ---
LOOSE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
STRICT_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
EMAIL_IN_TEXT = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_IN_TEXT = r"\+?\d[\d\-\s()]{6,}\d"
MIN_PHONE_DIGITS = 7

# --- fixed values: e-mail grading lists ---
DISPOSABLE_DOMAINS = ("mailinator.com", "10minutemail.com", "guerrillamail.com", "tempmail.com", "yopmail.com")
ROLE_PREFIXES = ("info", "support", "admin", "sales", "contact")

# --- fixed values: chat-widget vendor markers searched in lower-cased html ---
CHAT_VENDOR_MARKERS = (
    "intercom.io", "intercom-", "drift.com", "driftt.com", "js.hs-scripts.com", "hubspotfeedback",
    "usemessages.com/conversations-embed", "tawk.to", "embed.tawk.to", "crisp.chat", "client.crisp.chat",
    "livechatinc.com", "cdn.livechatinc.com", "zendesk.com/embeddable", "static.zdassets.com", "olark.com",
    "snapengage.com", "tidiochat", "tidio.co", "purechat.com", "facebook.com/platform/chat",
    "whatsapp.com/send", "smartsuppchat", "userlike.com",
)
CHAT_KEYWORDS = ("chatbot", "live chat", "intercom", "drift", "tawk.to", "zendesk chat", "whatsapp chat")

# --- fixed values: wording and markup that shows a page is maintained (case-insensitive) ---
FRESHNESS_PATTERNS = (
    r"last\s+(updated|modified|revised|edited)",
    r"updated\s*:",
    r"article:modified_time",
    r"og:updated_time",
    r"datepublished|datemodified",
    r"<time[^>]+datetime=",
)
# every pattern above contains one of these
FRESHNESS_WORDS = ("updated", "modified", "revised", "edited", "datepublished", "<time")
FRESHNESS_MIN_CHARS = 200

# --- fixed values: links worth following for contacts, hosts never taken as a company site ---
CONTACT_LINK_WORDS = ("contact", "about", "team", "agents")
BLOCKED_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com")

# --- fixed values: response-time ladder (upper bound in ms, score) ---
SPEED_LADDER = ((400, 100), (900, 88), (1800, 72), (3500, 55), (6000, 35))

# --- fixed values: candidate confidences ---
INPUT_CONFIDENCE = 0.35
PAGE_EMAIL_CONFIDENCE = 0.82
PLACE_PHONE_CONFIDENCE = 0.9
STAGE_CONFIDENCE = 0.75
FAILED_STAGE_CONFIDENCE = 0.2

# --- fixed values: place matching ---
MIN_NAME_MATCH = 0.5
LOCATION_BONUS = 0.15
LOCATION_PENALTY = 0.05
MIN_LOCATION_CHARS = 3

# --- fixed values: scoring weights ---
BASE_SCORE = 45
SCORE_WEIGHTS = {
    "contact_quality_verified": 25.0,
    "contact_quality_likely": 10.0,
    "contact_quality_low": -15.0,
    "both_channels_bonus": 5.0,
    "chatbot_penalty": -10.0,
    "last_updated_bonus": 5.0,
    "last_updated_unknown_penalty": 0.0,
    "website_speed_high_threshold": 80.0,
    "website_speed_high_bonus": 4.0,
    "website_speed_mid_threshold": 55.0,
    "website_speed_mid_bonus": 2.0,
    "website_speed_low_threshold": 35.0,
    "website_speed_low_penalty": -5.0,
    "website_speed_unknown_penalty": 0.0,
    "has_website": 10.0,
    "google_maps_source_bonus": 5.0,
    "has_location_bonus": 3.0,
    "has_agent_name_bonus": 2.0,
}

# --- fixed values: dashboard score buckets (label, low, high), both ends included ---
SCORE_BUCKETS = (("0–20", 0, 20), ("21–40", 21, 40), ("41–60", 41, 60), ("61–80", 61, 80), ("81–100", 81, 100))

# --- fixed values: fields of the missing-data profile ---
PROFILE_FIELDS = ("email", "phone", "website", "agent_name", "location", "lead_reason", "website_speed_score")

# --- fixed values: public numbering plans by ranges of first digits, from general knowledge of the plans: region, calling code,
#     trunk prefix, international dialling prefix, and "from-to:fewest-most digits" of the national numbers; what no range holds is
#     not assigned. "areas/rest" puts each range of `rest` behind each of the areas.
PHONE_RANGES = (
    ("ZA", "27", "0", "00", "10-18:9 21-28:9 31-36:9 39:9 40-49:9 51:9 53-54:9 56-58:9 60-89:9"),
    ("US", "1", "1", "011", "200-289,300-369,380-389,400-489,500-589,600-689,700-789,800-889,900-959,970-989/2-9:10"),
    ("GB", "44", "0", "00", "1:9-10 20:10 23-24:10 28-29:10 3:10 55-56:10 7:10 80:9-10 82-85:10 87:10 9:10"),
    ("DE", "49", "0", "00", "15:11 16-17:10-11 18-19:7-12 2-9:7-11"),
    ("AU", "61", "0", "0011", "1300:10 1301-139:6 1800:10 2-4:9 7-8:9"),
    ("IN", "91", "0", "00", "11-19:10 2-9:10"),
    ("BR", "55", "0", "00", "11-19,21-22,24,27-28,31-35,37-38,41-49,51,53-55,61-69,71,73-75,77,79,81-89,91-99/2-5:10 11-19,21-22,24,27-28,31-35,37-38,41-49,51,53-55,61-69,71,73-75,77,79,81-89,91-99/9:11"),
    ("FR", "33", "0", "00", "1-9:9"),
    ("JP", "81", "0", "010", "1-4:9 50:10 51-69:9 70:10 71-79:9 80:10 81-89:9 90:10 91-99:9"),
    ("MX", "52", "01", "00", "2-9:10"),
    ("NG", "234", "0", "009", "1:8 2-6:7-8 70-71:10 80-81:10 90-91:10"),
    ("IT", "39", "", "00", "0:6-11 3:9-10 8:6-10"),
    ("ES", "34", "", "00", "6-9:9"),
    ("NL", "31", "0", "00", "1-7:9 800:7-10 85:9 88:9 900:7-10"),
    ("BE", "32", "0", "00", "1-3:8 42-43:8 45-49:9 5-9:8"),
    ("CH", "41", "0", "00", "2-9:9"),
    ("PT", "351", "", "00", "2:9 30:9 6-9:9"),
    ("IE", "353", "0", "00", "1:8 2-7:7-9 8:9 9:7-9"),
    ("DK", "45", "", "00", "2-9:8"),
    ("NO", "47", "", "00", "2-9:8"),
    ("CZ", "420", "", "00", "2-9:9"),
    ("GR", "30", "", "00", "2:10 6:10 80:10 90:10"),
    ("RU", "7", "8", "810", "3-4:10 6-9:10"),
    ("TR", "90", "0", "00", "2-5:10 8-9:10"),
    ("CN", "86", "0", "00", "10:10 13-19:11 2:10 3-9:10-11"),
    ("HK", "852", "", "001", "2-9:8"),
    ("SG", "65", "", "000", "1800:11 3:8 6:8 8-9:8"),
    ("MY", "60", "0", "00", "1:9-10 3:9 4-9:8"),
    ("AE", "971", "0", "00", "2-4:8 5:9 6-7:8 9:8"),
    ("IL", "972", "0", "00", "2-4:8 5:9 7:9 8-9:8"),
    ("KE", "254", "0", "000", "1:9 20:7-9 4-6:8-9 7:9"),
    ("GH", "233", "0", "00", "2-3:9 5:9"),
    ("MZ", "258", "", "00", "2:8 8:9"),
    ("NA", "264", "0", "00", "6:8-9 8:9"),
    ("LS", "266", "", "00", "2:8 5-6:8"),
    ("SZ", "268", "", "00", "2:8 7:8"),
    ("CL", "56", "", "00", "2-9:9"),
    ("PE", "51", "0", "00", "1:8 4-8:8 9:9"),
    ("NZ", "64", "0", "00", "2:8-10 3-4:8 6-7:8 9:8"),
)
# --- fixed values: length of national numbers under the other calling codes (trunk prefix, fewest digits, most digits, calling codes) ---
NATIONAL_LENGTHS = (
    ("", 4, 5, "290"), ("", 4, 7, "683 690"), ("", 4, 11, "352"), ("", 5, 5, "500 682"), ("", 5, 6, "247"), ("", 5, 7, "676 677 678 685 688"),
    ("", 5, 8, "686"), ("", 6, 6, "298 299 508 672 681 687"), ("", 6, 7, "597"), ("", 6, 8, "689"), ("", 6, 9, "376"), ("", 6, 10, "378"),
    ("", 6, 12, "39"), ("", 7, 7, "220 238 239 246 248 269 297 501 592 673 674 679 680 691 692"),
    ("", 7, 8, "230 241 267 372 503 507 599 670 675 968 974 975"), ("", 7, 9, "245 354 423"), ("", 7, 10, "960"),
    ("", 8, 8, "45 47 216 222 223 226 227 228 235 236 253 257 266 268 350 356 357 371 502 504 505 509 852 853 965 973"),
    ("", 8, 9, "224 237 250 258"), ("", 8, 10, "57 229 506"), ("", 8, 11, "65"), ("", 9, 9, "34 48 56 221 240 242 244 351 420"),
    ("", 10, 10, "30 225"),
    ("0", 4, 13, "43"), ("0", 5, 10, "263"), ("0", 5, 12, "358"), ("0", 6, 8, "53"), ("0", 6, 9, "252 355"), ("0", 7, 7, "291"),
    ("0", 7, 8, "961"), ("0", 7, 9, "231 243 265 359 595 967"), ("0", 7, 10, "46 95 254 353"), ("0", 7, 12, "62"),
    ("0", 8, 8, "232 370 373 374 386 389 598"),
    ("0", 8, 9, "32 51 66 213 218 264 377 382 383 385 387 591 593 855 886 962 963 970 971 972"),
    ("0", 8, 10, "20 60 63 64 82 381 850 856 880 964 976 977"),
    ("0", 9, 9, "31 40 41 93 94 211 212 233 249 251 255 256 260 261 262 380 421 590 594 596 966 992 994 995 996 998"),
    ("0", 9, 10, "84 92"), ("0", 9, 11, "86"), ("0", 10, 10, "58 90 98"), ("0", 10, 11, "54"),
    ("06", 8, 9, "36"), ("8", 8, 8, "993"), ("8", 9, 10, "375"), ("8", 10, 10, "7"),
)
# a plan known by its lengths alone is named by its calling code; without a trunk prefix a number may begin with 0
_WITH_RANGES = {code for _, code, _, _, _ in PHONE_RANGES}
PHONE_PLANS = PHONE_RANGES + tuple(
    (f"+{code}", code, trunk, "00", f"{1 if trunk else 0}-9:{least}-{most}")
    for trunk, least, most, codes in NATIONAL_LENGTHS
    for code in codes.split()
    if code not in _WITH_RANGES
)
DEFAULT_PHONE_REGION = "ZA"
MAX_NATIONAL_DIGITS = 17
