"""Word lists, cues and patterns of the name and contact rules.

Everything here is a fixed value: results depend on these exact lists.
"""

from __future__ import annotations

# ---- Fixed values ----
ENTITIES = ("fn", "mn1", "mn2", "ln", "em", "ph")
NAME_ENTITIES = ("fn", "mn1", "mn2", "ln")

EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?\d{1,3}[\s.\-+]*)?(?:\(?\d{3}\)?[\s.\-+]*)\d{3}[\s.\-+]*\d{4}(?!\w)"
WORD = r"[^\W\d_]+(?:['\-][^\W\d_]+)*"
PLAIN_WORD = r"[A-Za-z][A-Za-z'\-]*"

NON_NAME_WORDS = (
    "yes", "no", "we", "you", "i", "me", "my", "our", "ours", "us", "your", "yours", "their", "them", "they", "it", "its", "this", "that", "these",
    "those", "hello", "hi", "hey", "thanks", "thank", "and", "ok", "okay", "sure", "please", "either", "good", "list", "realtor", "agent", "office",
    "sale", "sales", "incentive", "incentives", "warranty", "prices", "pricing", "tour", "homes", "home", "email", "e-mail", "phone", "text", "call",
    "near", "around", "close", "outside", "under", "for", "already", "local", "ready", "talking", "working", "service", "property", "taxes",
    "homeowners", "insurance", "insureance", "condo", "condos", "townhome", "townhomes", "house", "houses", "here", "is", "can", "why", "if", "just",
    "great", "like", "monday", "va", "veteran", "vet", "military", "senior", "sorry", "teacher", "typo", "doctor", "nurse", "would",
)
LEADING_PREPOSITIONS = (
    "in", "on", "at", "from", "to", "for", "with", "by", "of", "the", "a", "an", "near", "around", "close", "outside", "under",
)
PLACE_AND_TOPIC_WORDS = (
    "agent", "realtor", "office", "homes", "home", "hills", "heights", "creek", "city", "village", "community", "communities", "street", "terrace",
    "st", "road", "rd", "avenue", "ave", "drive", "dr", "way", "park", "lot", "plan", "sale", "sales", "pricing", "tours", "tour", "availability",
    "hoa", "property", "tax", "taxes", "homeowner", "homeowners", "insurance", "insureance", "elevation", "bedroom", "bathroom", "county",
)
SERVICE_HINTS = (
    "local", "provide", "provides", "providing", "service", "services", "work", "works", "working", "offer", "offering", "complimentary", "cleaning",
    "community", "communities", "bid", "talking", "already", "property", "taxes", "homeowners", "insurance", "insureance",
)
DIRECTIONS = (
    "north", "northern", "south", "southern", "east", "eastern", "west", "western", "northeast", "northwest", "southeast", "southwest",
)
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS",
    "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV",
    "WI", "WY", "DC",
)
CA_PROVINCES = (
    "BC", "AB", "SK", "MN", "MB", "ON", "QC", "NL", "NB", "NS", "PE", "PEI", "YK", "NU", "NT", "NWT",
)
REGIONS = (
    "alabama", "alaska", "alberta", "arizona", "arkansas", "british columbia", "california", "colorado", "connecticut", "delaware",
    "district of columbia", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine",
    "manitoba", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new brunswick",
    "new hampshire", "new jersey", "jersey", "new mexico", "new york", "newfoundland", "newfoundland and labrador", "north carolina",
    "the carolinas", "north dakota", "northwest territories", "nova scotia", "nunavut", "ohio", "oklahoma", "ontario", "oregon", "pennsylvania",
    "penn state", "prince edward island", "quebec", "rhode island", "saskatchewan", "south carolina", "south dakota", "the dakotas", "tennessee",
    "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "yukon",
)
BUSINESS_WORDS = (
    "company", "companies", "corporation", "corporations", "corporate", "corp", "co", "inc", "incorporated", "llc", "limited", "ltd", "plc", "group",
    "team", "crew", "services", "service", "janitorial", "sanitation", "bins", "cleaning", "framing", "siding", "roofing", "contracting",
    "contractors", "mechanical", "plumbing", "heating", "cooling", "appliances", "landscaping", "construction", "builders", "homes", "profile",
    "profiles",
)

SIGNATURE_FIRMS = (
    "realtor", "realtors", "realty", "broker", "brokers", "brokerage", "c21", "century", "keller", "williams", "kw", "judge", "fite",
)
SIGNATURE_CONTEXT = (
    "good morning", "good afternoon", "good evening", "thank you", "thanks", "please", "confirm", "confirmed", "received", "receipt", "request",
    "question", "submitted", "follow up", "follow-up", "i ", " i'", "my ", " me ",
)
GREETINGS = (
    "hello", "hi", "hey",
)
ASSISTANT_NAMES = (
    "mia", "ava", "aurora", "blossom",
)
NON_NAME_TEXTS = ("blossom ai", "move in ready")
TRAILING_NOISE = (
    "and", "or", "but", "my", "email", "mail", "phone", "number", "contact", "is", "at", "with", "from", "via",
)
NAME_CUES = (
    "my name is", "my nae is", "my nme is", "name is", "first name", "last name", "i am", "i'm", "this is", "call me",
)
ASKS_NAME = (
    "what is your name", "what's your name", "your first name", "first name", "your last name", "last name", "full name", "may i have your name",
    "can i have your name", "share your name", "grab your name", "get your name", "have your name", "name please", "who am i speaking with",
    "what should i call you",
)
ASKS_FIRST = (
    "first name", "your first name", "what is your first name", "what's your first name", "first and last name", "first & last name",
)
ASKS_LAST = (
    "last name", "your last name", "what is your last name", "what's your last name", "surname", "family name",
)
ASKS_FULL = (
    "full name", "your full name", "what is your full name", "what's your full name", "first and last name", "first & last name",
)
ASKS_CONTACT = (
    "your contact info", "your contact information", "grab your contact info", "can i grab your contact info", "can i get your contact info",
    "share your contact info", "what can i use to reach you", "what should i use to reach you", "best way to reach you", "email or phone",
    "email or phone number", "name and phone", "name and best contact", "name and best contact info", "what's your name and best contact info",
    "what is your name and best contact info",
)
HAS_FIRST = (
    "have your first name", "got your first name", "i have your first name",
)
PLAN_CONTEXT = (
    "floor plan", "floor plans", "plan interests", "what floor plan", "which floor plan", "specific plan", "specific plans", "compare plans",
    "compare specific plans", "explore other plans", "available plans",
)
LOCATION_CONTEXT = (
    "which community", "what community", "which area", "what area", "which city", "what city", "location", "communities", "community", "relocating",
    "nearby", "where are you looking", "show you what we're building nearby",
)
PLAN_CODES = (
    "fe", "se", "ce", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "io",
)
COORDINATION_CUES = (
    "client", "clients", "buyer", "buyers", "customer", "customers", "spouse", "spouses", "partner", "partners",
)
CONTACT_LOOKUPS = (
    "email address for ", "e-mail address for ", "email for ", "phone number for ", "contact info for ", "contact information for ", "contact for ",
)
WEAK_STARTS = (
    "a", "an", "the", "just", "already", "currently", "still", "talking", "working", "looking", "searching", "interested", "local", "here",
    "calling", "texting", "emailing", "wondering", "checking", "trying", "doing", "limiting", "available", "asking", "following", "for", "with",
    "about", "told", "not", "sure",
)
LOCATION_CUES = (
    "near", "around", "close to", "just outside", "outside", "north of", "south of", "east of", "west of", "northeast of", "northwest of",
    "southeast of", "southwest of",
)
PROSE_BREAKS = (
    "i", "im", "i'm", "we", "my", "me", "you", "he", "she", "they", "work", "works", "working", "at", "for", "in", "on", "and", "or", "but", "who",
    "what", "where", "when", "why", "how", "can", "could", "would", "do", "does", "did", "is", "are", "was", "were", "have", "has", "had", "need",
    "just",
)
TITLES = ("mr", "mrs", "ms", "dr", "prof")
ACKNOWLEDGEMENTS = ("yes", "yeah", "yep", "yup", "sure", "ok", "okay")
LAST_NAME_LABELS = ("last name", "surname", "family name")
NAME_LABELS = ("last name", "surname", "family name", "first name")
INTRODUCTIONS = ("my name is", "my nae is", "my nme is", "i am", "i'm", "this is")
ALIAS_CUES = ("short for", "nickname")
AGENT_TITLES = ("realtor", "realtors", "agent", "agents", "broker", "brokers")
PLACEHOLDER_ALIASES = {
    "first": "fn", "first_name": "fn", "firstname": "fn", "fn": "fn",
    "middle_name_1": "mn1", "middle1": "mn1", "mn1": "mn1",
    "middle_name_2": "mn2", "middle2": "mn2", "mn2": "mn2",
    "last": "ln", "last_name": "ln", "lastname": "ln", "ln": "ln",
    "email": "em", "e-mail": "em", "em": "em",
    "phone": "ph", "phone_number": "ph", "mobile": "ph", "ph": "ph",
}
WHOLE_NAME_ALIASES = (
    "name", "full_name", "person", "customer_name",
)
MODEL_ENTITIES = {"EMAIL_ADDRESS": "em", "PHONE_NUMBER": "ph"}
MODEL_LABELS = ("name", "first name", "last name", "full name")
# ---- End of the fixed values ----

REGION_CODES = sorted({x.lower() for x in US_STATES + CA_PROVINCES})
REGION_WORDS = [r for r in REGIONS if " " not in r]
